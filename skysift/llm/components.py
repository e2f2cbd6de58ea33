"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.session import cut

#: Links that one task settles by itself, some 100 MB.
LOCAL = 1 << 18


def settled(batches):
    """``node`` and ``root`` from the links ``hi``, ``lo``: roots hook to the least root next to them, at least halving the open ones each time."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(2)]
    names, numbers = np.unique(np.concatenate(ends), return_inverse=True)
    one, two = numbers[: len(ends[0])], numbers[len(ends[0]) :]
    up = np.arange(len(names))
    while (up[one] != up[two]).any():
        a, b = up[one], up[two]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (top := up[up]).tobytes() != up.tobytes():
            up = top
    below = np.flatnonzero(up != np.arange(len(names)))
    kind = held[0].schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array(names[below], kind), pa.array(names[up[below]], kind)], ["node", "root"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component, other than itself) for links ``a``, ``b``.

    Each round hooks every node's larger neighbours, then its smaller ones, to the least of them. Lists of
    neighbours are never gathered: only minima per node are. These are written down before they are joined, so both sides of
    each join are plain shuffles, in which Spark can split a hub's rows. It ends when a round changes nothing, or when no more
    than LOCAL links are left, which one task settles: few links don't take a shuffle and a checkpoint for each step of each round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    n, before = edges.count(), None
    if n > LOCAL:
        edges = cut(edges.distinct())
        n = edges.count()
    for _ in range(rounds):
        if n <= LOCAL:
            schema = T.StructType([T.StructField(c, edges.schema["hi"].dataType) for c in ("node", "root")])
            return cut(edges.coalesce(1).mapInArrow(settled, schema))
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = cut(large)
        down = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        edges = cut(small.where("hi <> lo").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        n, before = now[0], now
    raise RuntimeError("star contraction did not settle")
