"""Document quality by hierarchical empirical Bayes: a text classifier's evidence, shrunken with that of its path and host."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import map_text
from skysift.session import cut

N_FEATURES = 14
LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
DIGITS, CAPITALS = bytes(range(48, 58)), bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b".,'-"))
ENDS = re.compile(rb"[.!?](?=\s|$)")


def features(text: bytes | None) -> list[float]:
    """Numbers that tell running prose from junk: lengths, shares of kinds of characters, repetition, sentences."""
    t = text or b""
    n, words = len(t) + 1, t.lower().split()
    w = len(words) + 1
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = t.split(b"\n")
    marks = len(t) - len(t.translate(None, MARKS))
    return [
        math.log(n), math.log(w), float(lengths.mean()), float(lengths.std()), len(t.translate(None, LETTERS)) / n, (len(t) - len(t.translate(None, DIGITS))) / n,
        (len(t) - len(t.translate(None, CAPITALS))) / n, marks / n, math.log1p(100 * marks / w), len(set(words)) / w, sum(map(bytes.__eq__, words[1:], words)) / w,
        len(ENDS.findall(t)) / w, len(set(lines)) / len(lines), len(lines) / w,
    ]


def fit(rows: list[tuple[bytes | None, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights of a logistic regression on features, their squares and a constant; the log odds of the labels without both labels."""
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([math.log(share / (1 - share)), *[0.0] * (2 * N_FEATURES)])
    x = np.array([features(t) for t, _ in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    m = design(x, mean, spread)
    weights = np.zeros(m.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ weights, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.eye(m.shape[1]), m.T @ (y - p) - weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, spread, weights


def design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -8, 8)
    return np.c_[np.ones(len(z)), z, z * z]


def evidence(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1400) -> DataFrame:
    """Columns ``keep`` plus ``evidence``, the classifier's probability of good quality from the whole text.

    It is fitted on at most ``per_class`` labelled documents of each class, those of the smallest id hashes. An id
    labelled both ways counts as bad. Null and empty texts are judged like any other, by their features.
    """
    spark = docs.sparkSession
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    chosen = named.where("_label = 1").orderBy(*order).limit(per_class).unionByName(named.where("_label = 0").orderBy(*order).limit(per_class))
    sample = docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), id_col).collect()
    rows = sorted(((r[id_col], bytes(r["_text"] or b""), r["_label"]) for r in sample), key=lambda r: (r[0], r[1]))
    model = spark.sparkContext.broadcast(fit([(t, label) for _, t, label in rows]))

    def factory():
        mean, spread, weights = model.value

        def run(texts):
            x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
            return (1 / (1 + np.exp(-np.clip(design(x, mean, spread) @ weights, -30, 30))),)

        return run

    return map_text(docs, text_col, keep, [("evidence", "double")], factory)


def concentration(n: str, total: str, mean: Column) -> Column:
    """Pseudo-documents of a prior, by the method of moments: many if the groups' means differ no more than chance has them differ."""
    m = F.col(total) / F.col(n)
    between = F.sum(F.col(n) * (m - mean) * (m - mean)) - F.sum(mean * (1 - mean))
    variance = between / (F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n))
    middle = F.sum(F.col(n) * mean * (1 - mean)) / F.sum(n)
    return F.least(F.lit(10_000.0), F.greatest(F.lit(1.0), F.coalesce(middle / F.greatest(variance, F.lit(1e-9)) - 1, F.lit(10_000.0))))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_quality(judged: DataFrame, host: str, path: str, evidence_col: str = "evidence", label_col: str | None = None) -> DataFrame:
    """All columns plus ``host_posterior``, ``path_posterior`` and ``quality``.

    Each document counts for its path and host with its label where it has one, else with its evidence. Sums per path are made first,
    hosts and the whole from them. Priors' strengths come from the data; a host's mean shrinks toward the whole's, a path's toward
    its host's, each without the document itself. The quality is the evidence with the odds that the path's
    posterior has over the whole's. Null hosts and paths are sites of their own; an empty table gives an empty result.
    """
    own = F.coalesce(F.col(label_col).cast("double"), F.col(evidence_col)) if label_col else F.col(evidence_col)
    counted = judged.select(F.col(host).alias("_host"), F.col(path).alias("_path"), own.alias("_own"))
    # a hot host's rows are added up before the shuffle; rounding makes sums independent of their order
    paths = cut(counted.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.round(F.sum("_own"), 6).alias("_sum")))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.round(F.sum("_sum"), 6).alias("_hsum"))
    whole = hosts.agg(F.round(F.sum("_hsum") / F.sum("_hn"), 9).alias("_mean"))
    k_host = hosts.crossJoin(F.broadcast(whole)).agg(concentration("_hn", "_hsum", F.col("_mean")).alias("_k0"), F.first("_mean").alias("_mean"))  # one row
    both = paths.join(hosts.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of"))).select("_host", "_path", "_n", "_sum", "_hn", "_hsum")
    k_path = both.agg(concentration("_n", "_sum", F.col("_hsum") / F.col("_hn")).alias("_k1"))
    sites = cut(both.crossJoin(F.broadcast(k_host)).crossJoin(F.broadcast(k_path)))
    sites = sites.withColumnsRenamed({"_host": "_site_host", "_path": "_site_path"})
    joined = judged.join(sites, F.col(host).eqNullSafe(F.col("_site_host")) & F.col(path).eqNullSafe(F.col("_site_path")))
    host_mean = (F.col("_k0") * F.col("_mean") + F.col("_hsum") - own) / (F.col("_k0") + F.col("_hn") - 1)
    path_mean = (F.col("_k1") * F.col("host_posterior") + F.col("_sum") - own) / (F.col("_k1") + F.col("_n") - 1)
    total = logit(F.col(evidence_col)) + logit(F.col("path_posterior")) - logit(F.col("_mean"))
    return joined.withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean).withColumn("quality", 1 / (1 + F.exp(-total))).select(*judged.columns, "host_posterior", "path_posterior", "quality")
