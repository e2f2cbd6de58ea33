"""Ordered computation that no single key can overload.

Rows get a global position from one range shuffle on the full sort order, so a key that
holds a third of all rows is spread over many tasks. Ranks, quantiles, neighbour access and
running totals are then read off positions in chunks of bounded size, with the carry from
chunk to chunk computed on one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.session import cut

CHUNK = 1 << 18
_LOCAL = (1 << 33) - 1


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Add the zero-based position of every row in the total order.

    All columns but maps break ties, so rows that still tie are the same row.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [o for o in order if isinstance(o, str)]
    order = [*order, *(c for c, t in df.dtypes if "map<" not in t and c not in named)]
    # The range bounds are sampled, so the sorted rows are written once before they are counted.
    rows = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    rows = rows.withColumn("_slice", F.shiftright("_id", 33))
    # One row per range partition, so this window and this broadcast are bounded by `parts`.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_slice").agg(F.count("*").alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        rows.join(F.broadcast(starts), "_slice")
        .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit(_LOCAL)))
        .drop("_id", "_slice", "_start")
    )


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null; the right side's keys are dropped. Without keys the right side is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _direct(order):
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
           rank: str = "rank", size: str | None = "n") -> DataFrame:
    """Rank 1..n of every row inside its key, and the size of the key."""
    rows = with_position(df, *keys, *_direct(order), name="_pos")
    if not keys:
        out = rows.withColumn(rank, F.col("_pos") + 1)
        if size:
            total = rows.agg(F.count("*").alias(size))
            out = out.crossJoin(F.broadcast(total))  # one row
        return out.drop("_pos")
    spans = rows.groupBy(*keys).agg(F.min("_pos").alias("_first"), F.count("*").alias(size or "_n"))
    out = join_keys(rows, spans, keys).withColumn(rank, F.col("_pos") - F.col("_first") + 1)
    return out.drop("_pos", "_first", *([] if size else ["_n"]))


def running(df: DataFrame, keys: Sequence[str], totals: dict[str, tuple[Column, str]],
            position: str = "pos", reverse: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Running sum, max or min per key in position order, the row itself included; null until there is a value.

    ``totals`` maps an output name to (column, 'sum' | 'max' | 'min').
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    merge = {
        "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": F.greatest,
        "min": F.least,
    }
    keys = list(keys)
    direction = (lambda c: F.col(c).desc()) if reverse else F.col
    rows = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)))
    for name, (value, _) in totals.items():
        rows = rows.withColumn(f"_v_{name}", value)
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(direction(position))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(*keys).orderBy(direction("_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_chunk = rows.groupBy(*keys, "_chunk").agg(
        *[fold[how](f"_v_{name}").alias(f"_t_{name}") for name, (_, how) in totals.items()]
    )
    carry = per_chunk.select(
        *keys, "_chunk",
        *[fold[how](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (_, how) in totals.items()],
    )
    out = join_keys(rows, carry, [*keys, "_chunk"])
    for name, (_, how) in totals.items():
        out = out.withColumn(name, merge[how](F.col(f"_c_{name}"), fold[how](f"_v_{name}").over(inside)))
    drop = [f"_{k}_{n}" for n in totals for k in "vc"]
    return out.drop("_chunk", *drop)


def neighbours(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, int]],
               position: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Values of rows a fixed number of steps away inside the same key (null past its ends).

    ``wanted`` maps an output name to (column, step); a negative step looks back. Rows near a
    chunk edge are copied into the next chunk, so each window holds a bounded number of rows.
    """
    back = max([0, *(-s for _, s in wanted.values())])
    ahead = max([0, *(s for _, s in wanted.values())])
    home = F.floor(F.col(position) / F.lit(chunk))
    inner = F.col(position) - home * F.lit(chunk)
    targets = F.array_compact(F.array(
        home,
        F.when(inner >= chunk - back, home + 1) if back else F.lit(None).cast("bigint"),
        F.when((inner < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("bigint"),
    ))
    rows = df.withColumn("_home", home).withColumn("_chunk", F.explode(targets))
    w = Window.partitionBy("_chunk").orderBy(position)
    for name, (value, step) in wanted.items():
        there = F.lag if step < 0 else F.lead
        k = abs(step)
        same = reduce(
            lambda a, b: a & b, [there(key, k).over(w).eqNullSafe(F.col(key)) for key in keys],
            there(F.lit(True), k, False).over(w),
        )
        rows = rows.withColumn(name, F.when(same, there(value, k).over(w)))
    return rows.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str,
              probabilities: dict[str, float], size: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per key; one output row per key."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    data = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # Equal values are counted first, so a frequent value is one row; its neighbours in order are found by running counts.
    rows = value_counts(data, keys, "_v", {"_c": F.lit(1)})
    rows = join_keys(rows, rows.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys)
    last = F.col("_n") - 1

    def at(index: Column) -> Column:
        return F.max(F.when((index >= F.col("cum__c") - F.col("_c")) & (index < F.col("cum__c")), F.col("_v")))

    low = {n: F.floor(last * F.lit(float(p))) for n, p in probabilities.items()}
    found = rows.groupBy(*keys).agg(
        F.max("_n").alias(size or "_n"),
        *[x for n, i in low.items() for x in (at(i).alias(f"_lo_{n}"), at(F.least(i + 1, last)).alias(f"_hi_{n}"))],
    )
    n = F.col(size or "_n")
    if not keys:
        found = found.filter(n.isNotNull())

    def between(name: str, p: float) -> Column:
        part = (n - 1) * F.lit(float(p)) - F.floor((n - 1) * F.lit(float(p)))
        return (F.col(f"_lo_{name}") * (1.0 - part) + F.col(f"_hi_{name}") * part).alias(name)

    return found.select(*keys, *([size] if size else []), *[between(name, p) for name, p in probabilities.items()])


def median(df: DataFrame, keys: Sequence[str], value: Column | str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def value_counts(df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """Distinct values per key with weights, added up before the shuffle, and running weights."""
    small = df.groupBy(*keys, value).agg(*[F.sum(c).alias(name) for name, c in counts.items()])
    rows = with_position(small, *keys, value)
    return running(rows, keys, {f"cum_{n}": (F.col(n), "sum") for n in counts})


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Average rank of every row inside its key; ties share one rank."""
    keys = list(keys)
    counted = value_counts(df, keys, value, {"_ties": F.lit(1)})
    shared = counted.select(
        *keys, value, (F.col("cum__ties") - F.col("_ties") + (F.col("_ties") + 1) / 2.0).alias(rank),
        F.col("_ties").alias(f"{rank}_ties"),
    )
    return join_keys(df, shared, [*keys, value])
