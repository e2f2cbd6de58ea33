"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
#: Rows whose texts a task holds as Python objects.
SLICE = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are. Pure ASCII takes the quicker built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def map_text(docs: DataFrame, text: str, keep: list[str], fields: list[tuple[str, str]], factory: Callable, also: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` as they are, plus ``fields`` computed from the text in Arrow batches.

    ``factory()`` runs once a task and gives a function from a list of UTF-8 texts (None for null), and
    lists of the columns ``also``, to one list per field. No shuffle; a batch is all that a task holds.
    """
    types = [ARROW[kind] for _, kind in fields]
    extra = len(also or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            made = compute(*(batch.column(i).to_pylist() for i in range(extra + 1)))
            arrays = [batch.column(i) for i in range(extra + 1, batch.num_columns)]
            arrays += [pa.array(values, kind) for values, kind in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(name for name, _ in fields)])

    chosen = docs.select(F.col(text).cast("binary").alias("_text_bytes"), *(F.col(c).alias(f"_also{i}") for i, c in enumerate(also or ())), *(F.col(c) for c in keep))
    schema = T.StructType([*chosen.schema.fields[extra + 1 :], *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields)])
    return chosen.mapInArrow(run, schema)
