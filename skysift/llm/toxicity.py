"""Toxicity by compression: windows of a text against a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from heapq import nlargest
from zlib import crc32

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import map_text

WINDOW = 96
LEVEL, LEAST_MATCH = 5, 5
#: Steps of saved bytes whose windows are counted.
STEPS = (1, 2, 3, 4, 6, 9)
ORDINARY_WORDS = 3000
#: Numbers of toxic pieces that are tried.
SIZES = (8, 16, 32, 64)


@dataclass
class Model:
    """Two dictionaries and the calibration of their window differences. ``prior`` is the score without windows' evidence."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text in pieces of at most ``size`` bytes that end at blanks where they can."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            blank = text.rfind(b" ", at + size // 2, end)
            end = blank if blank > 0 else end
        out.append(text[at:end])
        at = end
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


def saved(text: bytes, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
    pieces = windows(text.lower())
    return np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in pieces], np.int64)


def features(text: bytes, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[float]:
    d = saved(text, toxic, ordinary)
    if not len(d):
        return [0.0] * (2 + 2 * len(STEPS))
    over = [int((d >= k).sum()) for k in STEPS]
    return [float(d.mean()), float(d.max()), *(n / len(d) for n in over), *(math.log1p(n) for n in over)]


def word_starts(text: bytes) -> tuple[Counter, int]:
    """How often each word and its first 4 to 12 bytes start a word of the text, in lower case, and the number of words."""
    words, out = Counter(text.lower().split()), Counter()
    for w, n in words.items():
        for piece in {w, *(w[:k] for k in range(4, min(len(w), 13)))}:
            out[piece] += n
    return out, words.total()


def piece_counts(texts: list[bytes]) -> tuple[Counter, int]:
    """Summed counts of the pieces, and the number of words. Repeats in a text count by their logarithm, so that one text's topic is not taken for vocabulary."""
    total, words = Counter(), 0
    for t in texts:
        found, n = word_starts(t)
        words += n
        for piece, c in found.items():
            total[piece] += math.log2(1 + c)
    return total, words


def rank_pieces(toxic: tuple[Counter, int], ordinary: tuple[Counter, int], most: int) -> list[bytes]:
    """The ``most`` pieces with the strongest evidence (log-likelihood ratio) that toxic text has them more often per word.

    Neither a piece's share of the documents nor its absence from ordinary ones is asked for, so the words of a small language
    and those that ordinary text has now and then count too. Pieces that begin a stronger one are left out, as it holds them.
    """
    share = toxic[1] / max(1, toxic[1] + ordinary[1])

    def gain(piece: bytes) -> float:
        n, m = toxic[0][piece], ordinary[0][piece]
        if n <= (n + m) * share:
            return 0.0
        return n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0.0)

    out: list[bytes] = []
    for piece in nlargest(16 * most, toxic[0], key=lambda p: (gain(p), len(p), p)):
        if gain(piece) > 0 and not any(x.startswith(piece) for x in out):
            out.append(piece)
    return out[:most]


def train_dictionaries(ranked: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries.

    The ordinary one holds the most frequent words of ordinary text. The toxic one puts the ranked pieces of toxic text before
    them. As the shared part is at the same distance from a window in both, windows without such pieces compress alike.
    """
    marks = set(ranked)
    whole = Counter(w for t in ordinary for w in set(t.lower().split()))
    common = [w for w, n in sorted(whole.items(), key=lambda x: (-x[1], x[0])) if n > 1 and w not in marks and not any(w[:k] in marks for k in range(4, 13))]
    shared = b" ".join([b"", *reversed(common[:ORDINARY_WORDS]), b""]) + b"." * 8
    return b" ".join([b"", *reversed(ranked)]) + shared, shared


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log loss, and the means, spreads and weights of a logistic regression by Newton's steps, with a small ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    m = np.c_[np.ones(len(x)), (x - mean) / spread]
    weights = np.zeros(m.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ weights, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 0.5 * np.eye(m.shape[1]), m.T @ (y - p) - 0.5 * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(np.logaddexp(0, (1 - 2 * y) * (m @ weights)).mean()), mean, spread, weights


def fit(rows: list[tuple[object, bytes, int]]) -> Model:
    """A model from (id, text, 0 or 1).

    Rows are dealt by id into two folds. Windows of each are compressed with dictionaries of the other, and the calibration
    is fitted on both; the number of toxic pieces is the one with the least log loss. The final dictionaries are of all rows.
    """
    fold = np.array([crc32(f"d{i}".encode()) % 2 for i, _, _ in rows])
    y = np.array([label for _, _, label in rows], float)
    prior = float(y.mean()) if rows else 0.0
    width = 2 + 2 * len(STEPS)
    if len(set(zip(fold.tolist(), y.tolist()))) < 4:
        return Model(b"." * 8, b"." * 8, np.zeros(width), np.ones(width), np.array([math.log((prior + 1e-6) / (1 - prior + 1e-6)), *[0.0] * width]), prior)

    texts = {(f, label): [t for (_, t, y), g in zip(rows, fold) if g == f and y == label] for f in (0, 1) for label in (0, 1)}
    counts = {key: piece_counts(found) for key, found in texts.items()}
    learned = [(rank_pieces(counts[1 - f, 1], counts[1 - f, 0], max(SIZES)), texts[1 - f, 0]) for f in (0, 1)]
    best = None
    for size in SIZES:
        x = np.zeros((len(rows), width))
        for f, (pieces, ordinary) in enumerate(learned):
            compress = tuple(map(compressor, train_dictionaries(pieces[:size], ordinary)))
            for at in np.flatnonzero(fold == f):
                x[at] = features(rows[at][1], *compress)
        found = calibrate(x, y)
        if best is None or found[0] < best[1][0]:
            best = size, found
    both = [(counts[0, label][0] + counts[1, label][0], counts[0, label][1] + counts[1, label][1]) for label in (1, 0)]
    return Model(*train_dictionaries(rank_pieces(*both, best[0]), texts[0, 0] + texts[1, 0]), *best[1][1:], prior)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``per_class`` labelled documents of each class, those of the smallest id hashes.

    Rows of ``labels`` without an id or with another label than 0 and 1 are left out; an id labelled both ways counts as toxic.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    chosen = named.where("_label = 1").orderBy(*order).limit(per_class).unionByName(named.where("_label = 0").orderBy(*order).limit(per_class))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).join(F.broadcast(chosen), id_col).collect()
    return fit(sorted(((r[id_col], bytes(r["_text"]), r["_label"]) for r in rows), key=lambda r: (r[0], r[1])))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """Columns ``keep`` plus the probability of toxicity, from whole texts. Null and empty texts have no windows and get the calibrated base score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value
        compress = compressor(m.toxic), compressor(m.ordinary)

        def run(texts):
            x = np.array([features(t or b"", *compress) for t in texts]).reshape(len(texts), -1)
            total = m.weights[0] + ((x - m.mean) / m.spread) @ m.weights[1:]
            return (1 / (1 + np.exp(-np.clip(total, -30, 30))),)

        return run

    return map_text(docs, text_col, keep, [(name, "double")], factory)
