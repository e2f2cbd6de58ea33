"""Joins of two series in time, without pairing every point with every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators.ordered import running, with_position


def _stack(key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Series (key, t, v) stacked with a kind number in the given order."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        rows = df.select(key, F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"), F.lit(i).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _around(rows: DataFrame, key: str, kinds: dict[str, int]) -> DataFrame:
    """For every row the last point at or before it and the first one after it, per kind."""
    point = F.struct("t", "v")
    picks = {n: F.when(F.col("kind") == k, point) for n, k in kinds.items()}
    rows = running(rows, [key], {f"before_{n}": (c, "max") for n, c in picks.items()})
    return running(rows, [key], {f"after_{n}": (c, "min") for n, c in picks.items()}, reverse=True)


def nearest_in_time(base: DataFrame, other: DataFrame, key: str, max_lag: float) -> DataFrame:
    """Each base point (key, t, v) with the closest other point not further than ``max_lag``; ties go to the earlier."""
    rows = with_position(_stack(key, {"other": other, "base": base}), key, "t", "kind", "v")
    rows = _around(rows, key, {"o": 0}).filter("kind = 1")
    back, ahead = F.col("t") - F.col("before_o.t"), F.col("after_o.t") - F.col("t")
    use_back = ahead.isNull() | (back <= ahead)
    pick = F.when(back.isNotNull() & use_back, F.col("before_o")).otherwise(F.col("after_o"))
    out = rows.withColumn("pick", pick).filter(F.abs(F.col("pick.t") - F.col("t")) <= max_lag)
    return out.select(key, "t", "v", F.col("pick.t").alias("other_t"), F.col("pick.v").alias("other_v"))


def _line(t: Column, before: str, after: str) -> Column:
    b, a = F.col(before), F.col(after)
    slope = (a["v"] - b["v"]) / (a["t"] - b["t"])
    return F.when(b["t"] == t, b["v"]).when(a.isNotNull() & b.isNotNull(), b["v"] + slope * (t - b["t"]))


def on_common_grid(first: DataFrame, second: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Both series interpolated on one even grid over their overlap, min(most, n1, 5*n2) points per key."""
    s1 = first.groupBy(key).agg(F.count("*").alias("n1"), F.min("t").alias("a1"), F.max("t").alias("b1"))
    s2 = second.groupBy(key).agg(F.count("*").alias("n2"), F.min("t").alias("a2"), F.max("t").alias("b2"))
    span = s1.join(s2, key).withColumn("a", F.greatest("a1", "a2")).withColumn("b", F.least("b1", "b2"))
    span = span.filter("b > a AND n1 >= 10 AND n2 >= 5").withColumn("n", F.least(F.lit(most), F.col("n1"), F.col("n2") * 5))
    grid = span.select(key, "a", "b", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    grid = grid.select(key, (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (F.col("n") - 1)).alias("t"), F.lit(None).cast("double").alias("v"))
    rows = with_position(_stack(key, {"first": first, "second": second, "grid": grid}), key, "t", "kind", "v")
    rows = _around(rows, key, {"f": 0, "s": 1}).filter("kind = 2")
    t = F.col("t")
    out = rows.select(key, "t", _line(t, "before_f", "after_f").alias("v1"), _line(t, "before_s", "after_s").alias("v2"))
    return out.filter("v1 IS NOT NULL AND v2 IS NOT NULL")


def correlation_summary(grid: DataFrame, key: str, sigma: float = 3.0) -> DataFrame:
    r = F.coalesce(N.correlation("v1", "v2"), F.lit(0.0))
    agg = grid.groupBy(key).agg(F.count("*").alias("n"), r.alias("r")).filter("n >= 5")
    t = F.when(F.abs("r") < 1, F.abs("r") * F.sqrt(F.col("n") - 2.0) / F.sqrt(1.0 - F.col("r") * F.col("r"))).otherwise(F.lit(0.0))
    return agg.withColumn("t_stat", t).withColumn("is_anticorrelated", (F.col("r") < -0.3) & (F.col("t_stat") > sigma))
