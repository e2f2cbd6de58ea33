"""Named tests over a set of tables. A name maps to a function of the tables; unknown names are inconclusive."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_named(tests: Mapping[str, Callable[[object], DataFrame]], names, tables, reference: DataFrame) -> DataFrame:
    """Rows (name, detection, status) of the named tests, stacked.

    Each test returns one row with ``detection``. Names nobody registered give one
    inconclusive row; ``reference`` only supplies the session and a one-row frame for them.
    """
    one = reference.agg(F.count("*").alias("_n"))
    parts = []
    for name in names:
        if name in tests:
            df = tests[name](tables).select(F.col("detection").cast("double").alias("detection"))
            status = F.when(F.col("detection") > 0.5, "UNEXPLAINED").otherwise("INCONCLUSIVE")
        else:
            df, status = one.select(F.lit(None).cast("double").alias("detection")), F.lit("INCONCLUSIVE")
        parts.append(df.select(F.lit(name).alias("name"), "detection", status.alias("status")))
    return reduce(DataFrame.unionByName, parts)
