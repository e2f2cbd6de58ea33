"""Isolation forest: trees are grown on small hashed samples in parallel, rows are scored where they lie."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.ordered import quantiles
from skysift.operators.stats import z_scores
from skysift.session import cut


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int):
    if depth >= limit or len(x) <= 1 or (np.ptp(x, axis=0) == 0).all():
        return float(depth + _average_path(len(x)))
    usable = np.flatnonzero(np.ptp(x, axis=0) > 0)
    f = int(rng.choice(usable))
    at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < at
    if left.all() or not left.any():
        return float(depth + _average_path(len(x)))
    return [f, at, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def _flat(tree) -> tuple[np.ndarray, ...]:
    """Feature, threshold, lower and upper child of each node, and its value; a leaf is its own child."""
    nodes: list[list] = []

    def add(part) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, part])
        if isinstance(part, list):
            nodes[at] = [part[0], part[1], add(part[2]), add(part[3]), 0.0]
        return at

    add(tree)
    kinds = (np.int64, float, np.int64, np.int64, float)
    return tuple(np.array(c, kind) for c, kind in zip(zip(*nodes), kinds))


def _depths(flat: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Where each row ends: all rows go down a level at a time."""
    feature, at, low, high, value = flat
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        below = np.where(x[rows, feature[node]] < at[node], low[node], high[node])
        if (below == node).all():
            return value[node]
        node = below


def isolation_scores(df: DataFrame, key: str, features: Sequence[str], trees: int = 200, seed: int = 42,
                     contamination: float | None = None, sample: int = 256) -> DataFrame:
    """Anomaly score of every row (near 1 is isolated), and the flag of the top ``contamination`` share.

    Each tree grows on ``sample`` rows (the method's usual subsample), those with the smallest hashes for it; all rows are scored.
    """
    # Read once for the scales, once for their use, and again for the count, the samples and the scores.
    scaled = cut(z_scores(cut(df.select(key, *features)), features))
    zs = [f"z_{c}" for c in features]
    # Only rows below a bound on the hash travel: four times as many as a tree takes are expected below it.
    share = min(1.0, 4.0 * sample / max(1, scaled.count()))
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    trees_of = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.col(key), t, F.lit(seed)) <= F.lit(bound))
    near = scaled.withColumn("tree", F.explode(trees_of)).withColumn("_h", F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)))
    w = Window.partitionBy("tree").orderBy("_h", key)
    picked = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(key)[zs].to_numpy(float)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        grown = _grow(x, np.random.default_rng([seed, tree]), 0, limit)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "model": [json.dumps(grown)]})

    grown = picked.select("tree", key, *zs).groupBy("tree").applyInPandas(build, "tree int, size int, model string")
    # A forest is `trees` rows of at most ``sample`` leaves each, whatever the size of the data.
    forest = [(r["size"], _flat(json.loads(r["model"]))) for r in grown.orderBy("tree").limit(trees).collect()]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    names = [key, *zs]
    key_type = dict(df.dtypes)[key]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[zs].to_numpy(float)
            ratio = sum(_depths(tree, x) / max(_average_path(size), 1e-9) for size, tree in shared.value) / max(len(shared.value), 1)
            yield pd.DataFrame({key: batch[key], "isolation": 2.0 ** -ratio})

    out = scaled.select(*names).mapInPandas(score, f"{key} {key_type}, isolation double")
    if contamination is None:
        return out
    out = cut(out)
    limit = quantiles(out, [], "isolation", {"_limit": 1.0 - contamination})
    marked = out.crossJoin(F.broadcast(limit))  # one row
    over = F.greatest(F.col("isolation") - F.col("_limit"), F.lit(0.0))
    return marked.withColumn("is_outlier", F.col("isolation") > F.col("_limit")).withColumn("excess", over).drop("_limit")
