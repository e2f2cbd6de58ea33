"""Long repeated byte strings across a corpus: every byte of a later occurrence is removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from skysift.llm.common import map_text
from skysift.session import cut

#: Bytes of the short strings whose least hash in a window is the window's sample, and bits of a place in a block.
GRAM, PLACE_BITS = 24, 28
#: Bytes of text that a task looks at together.
BLOCK = 4_000_000
#: Runs of a bucket that one task looks at together; larger buckets are dealt out by the suffixes' windows.
LARGE = 10_000
COLUMNS = ["kind", "key", "name", "id", "tie", "start", "end"]
ROWS = "kind int, key bigint, name bigint, id bigint, tie bigint, start bigint, end bigint"
#: Kinds of rows: a stretch of suffixes to resolve, one known to have come earlier, one that needs a look at each suffix.
OPEN, EARLIER, MIXED = 0, 1, 2


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, by doubling."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    h4 = h8 = text.astype(np.uint64) + np.uint64(1)
    for n in (1, 2):
        h4 = h4[:-n] * power(n) + h4[n:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    h = h16[: len(text) - 23] * power(8) + h8[16:]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(joined: bytes, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one sample: text's number, first and end place in the text, the sample's hash, the run's name.

    The sample of a suffix is the GRAM bytes of least hash, the first of them, within its first ``window`` bytes. It depends on these
    bytes alone, so suffixes that agree on them have the same sample at the same distance. A run's name is a hash of all bytes
    that its suffixes' windows cover: runs with the same hash of the sample and the same name hold the same windows in the same order.
    """
    text = np.frombuffer(joined, np.uint8)
    if len(text) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = gram_hashes(text)
    low = np.uint64((1 << PLACE_BITS) - 1)
    sample = window_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - GRAM + 1) & low
    ends = np.cumsum(sizes)
    begins = ends - sizes
    whole = np.zeros(len(sample) + 1, np.int8)
    long = sizes >= window
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - window + 1, -1)
    inside = np.cumsum(whole[:-1], dtype=np.int8) > 0
    change = np.ones(len(sample), bool)
    change[1:] = (sample[1:] != sample[:-1]) | ~inside[:-1]
    change[begins[long]] = True
    first = np.flatnonzero(inside & change)
    stop = np.ones(len(sample), bool)
    stop[:-1] = change[1:] | ~inside[1:]
    end = np.flatnonzero(inside & stop) + 1
    of = np.searchsorted(ends, first, side="right")
    names = np.fromiter(map(xxh3_64_intdigest, map(joined.__getitem__, map(slice, first.tolist(), (end + window - 1).tolist()))), np.uint64, len(first))
    return of, first - begins[of], end - begins[of], hashes[sample[first].astype(np.int64)].view(np.int64), names.view(np.int64)


def first_here(ids: np.ndarray, ties: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """Of equal (key, name) the first, in order of document and place, stays open; later ones came earlier, and runs of them are joined.

    So a group of copies sends one row a block, and what came earlier is dealt by document, not by key.
    """
    id_, tie = ids[of], ties[of]
    order = np.lexsort((start, tie, id_, name, key))
    id_, tie, start, end, key, name, of = (x[order] for x in (id_, tie, start, end, key, name, of))
    head = np.ones(len(order), bool)
    head[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    of_head = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    again = ~head & ((id_ != id_[of_head]) | (tie != tie[of_head]) | (start != start[of_head]))
    later = np.flatnonzero(again)
    later = later[np.lexsort((start[later], of[later]))]
    a, b, o = start[later], end[later], of[later]
    apart = np.ones(len(later), bool)
    apart[1:] = (a[1:] > b[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(apart)
    last = np.append(begin[1:], len(later))[: len(begin)] - 1
    some = later[begin]
    kind = np.repeat(np.array([OPEN, EARLIER], np.int32), (int(head.sum()), len(begin)))
    columns = [
        kind,
        np.concatenate((key[head], id_[some] ^ tie[some])),
        np.concatenate((name[head], np.zeros(len(begin), np.int64))),
        np.concatenate((id_[head], id_[some])),
        np.concatenate((tie[head], tie[some])),
        np.concatenate((start[head], a[begin])),
        np.concatenate((end[head], b[last])),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=COLUMNS)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, name, document and place: which came earlier, and which keys have several names.

    Only the open group's state is held from batch to batch, so a group may have any number of rows.
    """
    key = name = None  # of the row before
    head = pending = None  # (id, tie, start) of the name's first row; the first row of a key with one name so far
    several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, keys, names, ids, ties, starts, ends = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        done = kinds == EARLIER
        yield batch.filter(pa.array(done))
        keys, names, ids, ties, starts, ends = (x[~done] for x in (keys, names, ids, ties, starts, ends))
        n = len(keys)
        if not n:
            continue
        new_key, new_name = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = keys[1:] != keys[:-1]
        new_name[1:] = new_key[1:] | (names[1:] != names[:-1])
        new_key[0] = key is None or keys[0] != key
        new_name[0] = new_key[0] or names[0] != name
        at = np.maximum.accumulate(np.where(new_name, np.arange(n), -1))
        same = np.where(at >= 0, (ids == ids[at]) & (ties == ties[at]) & (starts == starts[at]), False)
        if not new_name[0]:
            carried = at < 0
            same |= carried & (ids == head[0]) & (ties == head[1]) & (starts == head[2])
        group = np.cumsum(new_key) - (1 if new_key[0] else 0)
        counts = np.bincount(group[new_name], minlength=int(group[-1]) + 1)
        if not new_key[0]:
            counts[0] += 2 if several else 1
            if counts[0] > 1 and pending is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((MIXED, *pending), batch.schema.types)], names=COLUMNS)
                pending = None
        mixed = new_name & (counts[group] > 1)
        earlier = ~new_name & ~same
        for which, kind in ((mixed, MIXED), (earlier, EARLIER)):
            if which.any():
                chosen = [np.full(int(which.sum()), kind, np.int32), *(x[which] for x in (keys, names, ids, ties, starts, ends))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in chosen], names=COLUMNS)
        several = bool(counts[-1] > 1)
        if new_key.any():
            first = int(np.flatnonzero(new_key)[-1])
            pending = None if several else tuple(int(x[first]) for x in (keys, names, ids, ties, starts, ends))
        key, name = keys[-1], names[-1]
        if at[-1] >= 0:
            head = ids[at[-1]], ties[at[-1]], starts[at[-1]]


def whole_runs(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, ties, size = [], [], [], 0

        def flush():
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield first_here(np.array(ids, np.int64), np.array(ties, np.int64), *stretches(b"".join(texts), sizes, window))

        for batch in batches:
            for text, id_, tie in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text.as_py()
                texts.append(text)
                ids.append(id_)
                ties.append(tie)
                size += len(text)
                if size >= BLOCK:
                    yield from flush()
                    texts, ids, ties, size = [], [], [], 0
        if texts:
            yield from flush()

    return scan


def mixed_runs(window: int):
    """Mixed runs with their bytes, for their bucket; those of large buckets as single suffixes, each by a 128-bit hash of its window."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, places, names, rows = [], [], [], []
                ids, ties = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                for i, (text, runs) in enumerate(zip(part.column(0), part.column(3).to_pylist())):
                    text = text.as_py()
                    for run in runs:
                        a, b = run["start"], run["end"]
                        if not run["large"]:
                            rows.append((run["key"], ids[i], ties[i], a, b, text[a : b + window - 1]))
                            continue
                        of += [i] * (b - a)
                        places += range(a, b)
                        names += [xxh3_128_digest(text[p : p + window]) for p in range(a, b)]
                if names:
                    both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                    place = np.array(places, np.int64)
                    single = first_here(ids, ties, np.array(of, np.int64), place, place + 1, both[:, 0].copy(), both[:, 1].copy())
                    yield single.append_column("bytes", pa.nulls(single.num_rows, pa.binary()))
                if rows:
                    key, id_, tie, start, end, seen = zip(*rows)
                    columns = [np.zeros(len(rows), np.int32), np.array(key, np.int64), np.zeros(len(rows), np.int64), *(np.array(x, np.int64) for x in (id_, tie, start, end))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(seen, pa.binary())], names=[*COLUMNS, "bytes"])

    return scan


def settle(window: int):
    """Rows in order of bucket, document and place: suffixes whose window the bucket has had before. Single suffixes are resolved as in the first round."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, had, before = None, set(), None

        def singles():
            nonlocal bucket, had, before
            for batch in batches:
                with_bytes = batch.column(7).is_valid()
                out = []
                for row in batch.filter(with_bytes).to_pylist():
                    if before == (before := (row["key"], row["id"], row["tie"], row["start"])):
                        continue  # a repeated row
                    if row["key"] != bucket:
                        bucket, had = row["key"], set()
                    seen, start = row["bytes"], row["start"]
                    for k in range(row["end"] - start):
                        name = xxh3_128_digest(seen[k : k + window])
                        if name not in had:
                            had.add(name)
                        elif out and out[-1][6] == start + k and out[-1][3:5] == (row["id"], row["tie"]):
                            out[-1] = (*out[-1][:6], start + k + 1)
                        else:
                            out.append((EARLIER, bucket, 0, row["id"], row["tie"], start + k, start + k + 1))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.int64()] * 6))], names=COLUMNS)
                yield batch.filter(pc.invert(with_bytes)).select(COLUMNS)

        return resolve(singles())

    return scan


def resolved(rows: DataFrame, one_pass=resolve) -> DataFrame:
    """One shuffle by key, a sort within each part, and a pass."""
    return rows.repartition("key").sortWithinPartitions(*COLUMNS[1:6]).mapInArrow(one_pass, ROWS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left), one row per row of ``docs``.

    A byte is removed if a string of ``window`` bytes that covers it also starts earlier: in a document of smaller id, or further
    left in the same one. Strings are compared on the input, never across documents.

    Suffixes are dealt into buckets by a sample of their first ``window`` bytes, and one bucket is sorted at a time. Neighbouring suffixes with one
    sample go as one row with the name of all bytes that they see, so long ties - copies - are settled by names
    and positions, without the bytes. Only runs whose bucket has other names too are sent with their bytes, and their bucket's suffixes are
    gone through in order; a bucket of more than LARGE such runs is dealt out by the windows of its suffixes instead, in a second
    round of the first kind. Equal runs within a block of text send one row.

    Ids are longs. Null texts are empty. Rows that share an id are in order of their texts' hashes; equal rows are one document and
    get the same result. Rows with a null id stay whole and don't count as earlier. Other columns are not looked at.
    """
    # rows are told apart by their texts' hashes too, where ids repeat
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    named = docs.select(F.col(id_col).cast("long").alias("_id"), (F.xxhash64(text_col) if repeated else F.lit(0).cast("long")).alias("_tie"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    texts = named.where("_id IS NOT NULL")
    runs = cut(resolved(texts.select("_text", "_id", "_tie").mapInArrow(whole_runs(window), ROWS)))
    mixed = runs.where(F.col("kind") == MIXED)
    # written down, so that both sides of the join are plain shuffles and Spark can split a hot key's rows
    large = cut(mixed.groupBy("key").count().where(F.col("count") > LARGE).select("key", F.lit(True).alias("_large")))
    sized = mixed.join(large, "key", "left").withColumn("large", F.coalesce("_large", F.lit(False)))
    asked = sized.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("start", "end", "key", "large")).alias("_runs"))
    looked = texts.join(asked, ["_id", "_tie"]).select("_text", "_id", "_tie", "_runs").mapInArrow(mixed_runs(window), f"{ROWS}, bytes binary")
    earlier = runs.where(F.col("kind") == EARLIER).unionByName(resolved(looked, settle(window)).where(F.col("kind") == EARLIER))
    spans = earlier.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    joined = texts.join(spans, ["_id", "_tie"], "left").unionByName(named.where("_id IS NULL").withColumn("_spans", F.lit(None).cast("array<struct<start:bigint,end:bigint>>")))

    def factory():
        def run(rows, every):
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(rows, every):
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"] + window - 1) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in merged))
                counts.append(len(merged))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(text)])))
            return sizes, removed, counts, kept

        return run

    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept", "binary")]
    return map_text(joined, "_text", ["_id"], fields, factory, ["_spans"]).withColumnRenamed("_id", id_col)
