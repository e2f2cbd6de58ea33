"""SimHash fingerprints and the groups that near fingerprints form."""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skysift.llm.common import map_text
from skysift.llm.components import components
from skysift.session import cut

BITS = 64
#: Members of a probe bucket that one task compares at once; larger buckets are cut into blocks.
BUCKET = 4096
digest = partial(xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 values of the text's shingles of words in lower case; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    pieces = map(joined.__getitem__, map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.fromiter(map(digest, pieces), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bits set in over half the XXH64 values of the text's shingles, as a signed 64-bit number; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int32) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Columns ``keep`` plus ``fp`` (long). Null, empty and blank texts have fingerprint 0."""
    return map_text(docs, text_col, keep, [("fp", "bigint")], lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]])


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of like size, correlated bits together. Needs 64 x 64 sums, whatever the input."""

    def sums(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    n = max(1, distinct.count())
    both = np.zeros(BITS * BITS)
    for row in distinct.select("fp").mapInArrow(sums, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[row["cell"]] = row["n"] / n
    both = both.reshape(BITS, BITS)
    share = both.diagonal()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    relation = np.abs((both - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(relation, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        left = sorted(free)
        first = left[int(relation[np.ix_(left, left)].sum(axis=1).argmax())]
        group = [first]
        free.remove(first)
        while len(group) < (BITS + g) // parts and free:
            rest = sorted(free)
            group.append(rest[int(relation[np.ix_(rest, group)].sum(axis=1).argmax())])
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def part_value(bits: list[int]):
    """The bits of one group of the fingerprint, packed into a long."""
    value = F.lit(0).cast("long")
    for at, bit in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")), at))
    return value


def allocate(costs: list[dict[int, float]], total: int) -> list[int]:
    """A threshold for each group, together ``total``, of the least summed cost. -1 leaves a group out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for (spent, (paid, chosen)), (t, price) in product(best.items(), cost.items()):
            if spent + t not in after or paid + price < after[spent + t][0]:
                after[spent + t] = (paid + price, [*chosen, t])
        best = after
    return best[total][1]


def near_pairs(batches, distance: int):
    """Links within each bucket of rows sorted by bucket, thinned to those that join what wasn't joined in the bucket.

    Rows: bucket key columns, ``fp``.
    """
    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0))
        done = change[-1] + 1 if len(change) else 0
        held = [c[done:] for c in columns]
        yield from _linked([c[:done] for c in columns], distance)
    if held is not None:
        yield from _linked(held, distance)


def _linked(columns: list[np.ndarray], distance: int):
    keys, fp = columns[:-1], columns[-1]
    if len(fp) < 2:
        return
    new = np.any([c[1:] != c[:-1] for c in keys], axis=0)
    bucket = np.concatenate(([0], np.cumsum(new)))
    last = np.searchsorted(bucket, bucket, side="right")
    value, parent = fp.view(np.uint64), np.arange(len(fp))
    at, out_a, out_b = np.arange(len(fp)), [], []
    for step in range(1, len(fp)):
        at = at[at + step < last[at]]
        if not len(at):
            break
        to = at + step
        near = np.flatnonzero(np.bitwise_count(value[at] ^ value[to]) <= distance)
        if len(near) > 64:  # leave out at once what is joined already
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            near = near[parent[at[near]] != parent[to[near]]]
        for i, j in zip(at[near].tolist(), to[near].tolist()):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out_a.append(i)
                out_b.append(j)
    yield pa.RecordBatch.from_arrays([pa.array(fp[out_a]), pa.array(fp[out_b])], ["a", "b"])


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that, with chains of them, join all within ``distance`` bits.

    Generalised pigeonhole: with thresholds that add up to ``distance`` - parts + 1, two near fingerprints are
    within its threshold in at least one group of bits. Groups hold correlated bits; thresholds (-1, 0 or 1) are
    chosen by dynamic programming on the pairs that the groups' value counts predict. Fingerprints probe the values
    within the threshold, and candidates are verified on all bits.

    A bucket with more than BUCKET members is cut into blocks, and each pair of blocks is a bucket of its own, so a
    task holds a bounded number of rows. Only links that join something new in a bucket are returned, not all pairs.
    """
    n = distinct.count()
    # so many bits a group that a value is expected to have at most 64 fingerprints
    parts = int(np.clip(BITS // max(1.0, np.log2(max(n, 2) / 64)), 2, distance + 1))
    groups = bit_groups(distinct, parts)
    total = distance - parts + 1
    values = F.array(*(F.struct(F.lit(i).alias("part"), part_value(g).alias("value")) for i, g in enumerate(groups)))
    spread = distinct.select("fp", F.explode(values).alias("x")).select("x.part", "x.value", "fp")
    counts = cut(spread.groupBy("part", "value").agg(F.count("*").alias("n")))
    flips = F.array(*(F.lit(1 << b).cast("long") for b in range(max(map(len, groups)))))
    width = F.element_at(F.array(*(F.lit(len(g)) for g in groups)), F.col("part") + 1)
    around = counts.select("part", F.explode(F.slice(flips, F.lit(1), width)).alias("flip"), "value", F.col("n").alias("n1")).withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    same = {r["part"]: r["x"] for r in counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("x")).collect()}
    next_to = {r["part"]: r["x"] for r in around.join(counts, ["part", "value"]).groupBy("part").agg(F.sum(F.col("n1").cast("double") * F.col("n")).alias("x")).collect()}
    costs = [{-1: 0.0, 0: n + same.get(i, 0.0), 1: n * (1 + len(groups[i])) + same.get(i, 0.0) + next_to.get(i, 0.0)} for i in range(parts)]
    thresholds = allocate(costs, total)

    own = spread.where(F.element_at(F.array(*(F.lit(t) for t in thresholds)), F.col("part") + 1) >= 0)
    wide = [i for i, t in enumerate(thresholds) if t == 1]
    probes = own
    if wide:
        other = spread.where(F.col("part").isin(wide)).select("part", "value", "fp", F.explode(F.slice(flips, F.lit(1), width)).alias("flip"))
        probes = own.unionByName(other.select("part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "fp"))
        counts = cut(probes.groupBy("part", "value").agg(F.count("*").alias("n")))
    large = counts.where(F.col("n") > BUCKET).select("part", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("lo"), F.greatest(x, block).alias("hi")))
    )
    dealt = probes.join(large, ["part", "value"], "left").select("part", "value", F.explode(pairs).alias("p"), "fp").select("part", "value", "p.lo", "p.hi", "fp")
    keys = ["part", "value", "lo", "hi"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(lambda batches: near_pairs(batches, distance), "a bigint, b bigint")


def groups(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """``distinct`` with the ``root`` of each ``fp``, one and the same for all fingerprints that links of at most ``distance`` differing bits join."""
    roots = components(links(distinct, distance))
    return distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links of at most ``distance`` differing bits.

    One row per row of ``docs``. Equal fingerprints (exact copies among them) are one node, so a group of copies
    costs one row in the search. Null, empty and blank texts have fingerprint 0 and are linked like any other.
    A null id is never a component's id unless the whole component has none.
    """
    found = cut(fingerprints(docs.select(id_col, text_col), [id_col], text_col, shingle))
    nodes = found.groupBy("fp").agg(F.min(id_col).alias("first"))
    distinct = cut(nodes)
    grouped = groups(distinct, distance)
    # only components of several fingerprints need a second minimum
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    # written down, so that Spark can split the rows of a fingerprint that very many documents have
    named = cut(grouped.join(least, "root").select("fp", "component_id"))
    return found.join(named, "fp").select(F.col(id_col), "fp", "component_id")
