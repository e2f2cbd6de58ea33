"""Groups of documents whose sets of word shingles are alike: candidates by SimHash groups and by min-hash bands, verified by exact Jaccard likeness."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skysift.llm.common import map_text
from skysift.llm.components import components
from skysift.llm.simhash import fingerprint, groups, shingle_hashes
from skysift.session import cut

#: A pair at a likeness of 0.8 shares no band with a chance of (1 - 0.8^5)^24, 7 in 100 000; more alike pairs with less.
BANDS, ROWS = 24, 5
#: Members and shingles of a block that a task compares at once; larger groups are cut into blocks.
MEMBERS, SHINGLES = 1024, 1 << 20
#: A shingle of more members of a block is counted by matrix products, the others by their pairs.
FREQUENT, COLUMNS = 32, 4096
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def bands(found: np.ndarray) -> list[int]:
    """Hashes of BANDS groups of ROWS least values, each under permutations and with a seed of its own; none for the empty set."""
    if not len(found):
        return []
    least = np.min([(found[at : at + 2048, None] * FACTORS).min(axis=0) for at in range(0, len(found), 2048)], axis=0)
    return [int(np.uint64(xxh64_intdigest(part.tobytes(), seed=band)).view(np.int64)) for band, part in enumerate(least.reshape(BANDS, ROWS))]


def sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sorted sets share."""
    n = len(sets)
    rows, values = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sizes = np.diff(np.append(starts, len(values)))
    total = np.zeros(n * n)
    often = np.repeat(sizes > FREQUENT, sizes)
    rare_rows, rare = rows[~often], values[~often]
    for step in range(1, FREQUENT):
        same = np.flatnonzero(rare[step:] == rare[:-step])
        if not len(same):
            break
        total += np.bincount(rare_rows[same] * n + rare_rows[same + step], minlength=n * n)
    total = total.reshape(n, n)
    total += total.T
    column = np.repeat(np.arange((sizes > FREQUENT).sum()), sizes[sizes > FREQUENT])
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        held = np.zeros((n, COLUMNS), np.float32)
        held[rows[often][here], column[here] - at] = 1
        total += held @ held.T
    return total


def with_hub(likeness: float):
    """A hub's set against its members': rows ``hub`` (whether it is the hub), ``node``, ``shingles``."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sets, hubs = table.column("node").to_pylist(), sets_of(table.column("shingles")), table.column("hub").to_pylist()
        sizes, values, found = np.array([len(s) for s in sets]), np.concatenate(sets), []
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for a, hub in [(nodes[i], sets[i]) for i, is_hub in enumerate(hubs) if is_hub]:
            at = np.minimum(np.searchsorted(hub, values), len(hub) - 1)
            both = np.add.reduceat((hub[at] == values).astype(np.int64), starts)
            near = both >= likeness * (sizes + len(hub) - both)
            found += [(a, b) for b, ok in zip(nodes, near.tolist()) if ok and b != a]
        return pa.table({c: pa.array([pair[k] for pair in found], pa.string()) for k, c in enumerate("ab")})

    return run


def within_blocks(likeness: float):
    """Links between members of different roots: rows ``lo``, ``hi``, ``block``, ``node``, ``root``, ``shingles`` of a bucket. Links that join nothing new in their block are left out."""

    def run(table: pa.Table) -> pa.Table:
        nodes, roots, sets = table.column("node").to_pylist(), table.column("root").to_pylist(), sets_of(table.column("shingles"))
        block = table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sizes = np.array([len(s) for s in sets])
        both = common(sets)
        near = np.triu(both >= likeness * (sizes[:, None] + sizes[None, :] - both), 1)
        if lo != hi:
            near &= block[:, None] != block[None, :]
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        of, up, found = np.array([number[r] for r in roots]), list(range(len(number))), []
        near &= of[:, None] != of[None, :]

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            one, two = top(of[i]), top(of[j])
            if one != two:
                up[one] = two
                found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.string()), "b": pa.array([x for _, x in found], pa.string())})

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, likeness: float = 0.8, min_hashes: bool = True) -> DataFrame:
    """``doc_id``, ``node`` (MD5 of the shingle set) and ``component_id``, the smallest id reachable over pairs of the given likeness.

    One row per row of ``docs``; null ids and repeated ids included, each row by its own text. Equal sets are one node; texts without words,
    null ones too, have the empty set. A null id is a component's id only where the component has no other.

    Candidates are the groups that ``simhash`` forms of fingerprints at most three bits apart, and texts that share a min-hash band, as pairs at
    ``likeness`` often differ by more bits (``min_hashes=False``: the groups alone). Both are buckets of texts below.

    Every pair that shares a bucket is verified, except where both are linked already: first each bucket's least member against
    the others, so a large group of near copies costs a row each; then, in buckets whose other members are still of several
    groups, all pairs between groups, in blocks of bounded size. A bucket of very many texts that are alike but below
    ``likeness`` is therefore quadratic, spread over tasks. Candidates are moved as 64-bit tags of nodes; where tags of two nodes are
    equal both are compared. Only texts in shared buckets are shingled again, and of these hashes alone are moved, a hub's once a block.
    """

    def banded(texts):
        sets = [shingle_set(t, shingle) for t in texts]
        least = [bands(s) if min_hashes else [] for s in sets]
        return [hashlib.md5(s.tobytes()).hexdigest() for s in sets], [len(s) for s in sets], least, [fingerprint(t) for t in texts]

    def hashes(texts):
        sets = [shingle_set(t, shingle).tobytes() for t in texts]
        return [hashlib.md5(s).hexdigest() for s in sets], sets

    tag = F.xxhash64("node").alias("tag")
    made = cut(map_text(docs.select(id_col, text_col), text_col, [id_col], [("node", "string"), ("n", "bigint"), ("bands", "array<bigint>"), ("fp", "bigint")], lambda: banded))
    named = cut(made.groupBy("node").agg(F.min(id_col).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    marks = cut(made.where("n > 0").select("node", "n", "fp").distinct())
    grouped = marks.join(cut(groups(cut(marks.select("fp").distinct()))), "fp")
    alike_bits = grouped.select(tag, "n", F.xxhash64(F.lit("simhash"), "root").alias("value")).distinct()
    spread = named.select(tag, "n", F.explode("bands").alias("value")).unionByName(alike_bits)
    buckets = spread.groupBy("value").agg(F.min(F.struct("tag", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    buckets = cut(buckets.select("value", "members", F.col("c.tag").alias("a"), F.col("c.n").alias("n_a")))
    members = cut(spread.join(buckets, "value"))
    ids = named.select("first", tag).join(members.select("tag").distinct(), "tag", "left_semi").select(F.col("first").alias("_first")).distinct()
    chosen = docs.select(id_col, text_col).join(cut(ids), F.col(id_col).eqNullSafe(F.col("_first")), "left_semi")
    sets = map_text(chosen, text_col, [], [("node", "string"), ("shingles", "binary")], lambda: hashes)
    sets = cut(sets.dropDuplicates(["node"]).select(tag, "node", "shingles"))

    alike = F.least("n", "n_a") >= likeness * F.greatest("n", "n_a")
    pairs = cut(members.where("tag <> a").where(alike).select("a", "tag", "n").distinct())
    parts = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    around = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int").alias("part"), "tag", F.lit(False).alias("hub"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("tag"), F.lit(True).alias("hub"))
    links = around.unionAll(hubs).join(sets, "tag").groupBy("a", "part").applyInArrow(with_hub(likeness), "a string, b string")
    roots = components(links)

    rooted = sets.select("tag", "node").join(roots, "node", "left").select("tag", "node", F.coalesce("root", "node").alias("root"))
    rest = members.where("tag <> a and members > 2").select("value", "tag", "n").join(cut(rooted), "tag")
    several = rest.groupBy("value").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k"), F.sum("n").alias("total"),
        F.sum(F.col("tag").cast("decimal(38,0)")).alias("same"), F.sum(F.xxhash64("tag").cast("decimal(38,0)")).alias("also"),
    ).where("low <> high")
    # bands often give the same bucket: one of each is enough
    blocks = F.greatest(F.ceil(F.col("k") / MEMBERS), F.ceil(F.col("total") / SHINGLES)).cast("int").alias("blocks")
    open_ = cut(several.groupBy("k", "total", "same", "also").agg(F.min("value").alias("value")).select("value", blocks))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("lo"), F.greatest(i, F.col("block")).alias("hi")))
    dealt = rest.join(open_, "value").withColumn("block", block).select("value", "block", "node", "root", F.explode(both).alias("p")).select("value", "p.lo", "p.hi", "block", "node", "root")
    more = cut(dealt.join(sets, "node").groupBy("value", "lo", "hi").applyInArrow(within_blocks(likeness), "a string, b string"))
    for c in "ab":
        more = more.join(roots.withColumnsRenamed({"node": c, "root": f"root_{c}"}), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    joined = components(more.select("a", "b"))

    nodes = named.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("near"))
    nodes = cut(nodes.join(joined.withColumnsRenamed({"node": "near"}), "near", "left").select("node", "first", F.coalesce("root", "near").alias("root")))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    found = cut(nodes.join(least, "root").select("node", "component_id"))
    return made.select(id_col, "node").join(found, "node").select(F.col(id_col), "node", "component_id")
