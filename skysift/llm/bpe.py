"""Byte-level BPE over a corpus: every distinct word is encoded once, ids come back by position."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import map_text

#: Words of one block; the positions in a block, its words and their ids are held by one task at a time.
BLOCK_WORDS = 2_000_000
#: Words whose ids are put together at once.
STRETCH = 250_000
#: For texts of these characters alone the quicker matcher of the standard library gives the same words as the pattern.
PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-ÿ]*")
PLAIN_WORDS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: The pattern that PLAIN_WORDS stands in for.
PLAIN_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, which is of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(1)
def token_table(path: str) -> dict[int, bytes]:
    """Bytes of each token, once a process."""
    return {rank: token for token, rank in read_ranks(path).items()}


def decoded_bytes(packed: bytes | None, table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist())) if packed else b""


def splitter(pattern: str):
    """A function from a text to its words, each a match of the pattern."""
    whole = regex.compile(pattern)
    if pattern != PLAIN_FOR:
        return whole.findall
    return lambda text: PLAIN_WORDS.findall(text) if PLAIN.fullmatch(text) else whole.findall(text)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte planes apart, as a compressed string."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Distinct words of some documents and, for each word in order of place, the word's number."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.places: list[np.ndarray] = []
        self.ids: list = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, id_, words: list[str]) -> None:
        numbers = self.numbers
        self.places.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.ids.append(id_)
        self.sizes.append(len(words))
        self.n += len(words)

    def rows(self, block: int, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row a word bucket: its words, how often each occurs, and the places as differences."""
        words = [w.encode() for w in self.numbers]
        bucket = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[by_bucket] = np.arange(len(words), dtype=np.int32)
        of_place = rank[np.concatenate(self.places)] if self.n else np.zeros(0, np.int32)
        places = np.argsort(of_place, kind="stable").astype(np.int64)
        counts = np.bincount(of_place, minlength=len(words))
        ends = np.cumsum(counts)
        starts = (ends - counts).astype(np.int64)
        cut = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = int(cut[b]), int(cut[b + 1])
            if lo == hi and b:
                continue
            of_bucket = places[starts[lo] if lo < hi else 0 : ends[hi - 1] if lo < hi else 0]
            # words are in order of their first place, so first places are small steps too
            first = starts[lo:hi] - (starts[lo] if lo < hi else 0)
            later = np.ones(len(of_bucket), bool)
            later[first] = False
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([b], pa.int32()),
                    pa.array([None if b else self.ids], pa.list_(id_type)),
                    pa.array([b"" if b else pack(np.array(self.sizes))], pa.binary()),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(b"\0".join(words[i].replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") for i in by_bucket[lo:hi]))], pa.binary()),
                    pa.array([pack(counts[lo:hi])], pa.binary()),
                    pa.array([pack(np.diff(of_bucket[first], prepend=0))], pa.binary()),
                    pa.array([pack(np.diff(of_bucket, prepend=0)[later])], pa.binary()),
                ],
                names=["block", "bucket", "row_ids", "sizes", "words", "counts", "firsts", "steps"],
            )


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers), one row per row of ``docs``; with ``round_trip`` also
    ``decoded``, the bytes that `decode` makes of the ids, without another pass to Python.

    Texts are split into words by ``pattern`` and the words exploded with their positions, grouped by block of
    documents: a row holds the words of one hash bucket that occur in the block and their positions. These rows are
    shuffled by bucket, so that each distinct word of the corpus is encoded in one place, once; the ids go back to the
    block with the positions, and the documents are put together by position. A word's rows grow with the number
    of blocks, not with its occurrences, so frequent words don't make hot keys; blocks are of bounded size. Blocks
    are numbered by partition and order within it, so a repeated task gives the same blocks.

    Null and empty texts have no tokens. Special tokens are never used: their strings are ordinary text. Rows that share an
    id or repeat are encoded each.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_field = docs.select(id_col).schema.fields[0]

    def explode(batches):
        from pyspark import TaskContext

        number, made = TaskContext.get().partitionId() << 32, 0
        words_of, block = splitter(pattern), Block()
        kind = None
        for batch in batches:
            kind = batch.column(1).type
            for text, id_ in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                block.add(id_, words_of(text) if text else [])
                if block.n >= BLOCK_WORDS or len(block.ids) >= BLOCK_WORDS:
                    block.ids = [x.as_py() for x in block.ids]
                    yield from block.rows(number + made, buckets, kind)
                    made, block = made + 1, Block()
        if block.ids:
            block.ids = [x.as_py() for x in block.ids]
            yield from block.rows(number + made, buckets, kind)

    def encode_words(batches):
        ranks = read_ranks(ranks_path)
        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        known: dict[bytes, list[int]] = {}
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current:
                    known, current = {}, row["bucket"]
                packed = zstandard.ZstdDecompressor().decompress(row["words"])
                found = []
                for word in packed.split(b"\0") if packed else []:
                    ids = known.get(word)
                    if ids is None:
                        plain = word.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in word else word
                        ids = known[word] = codec._encode_single_piece(plain)
                    found.append(ids)
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.int64, int(lengths.sum()))
                row["words"] = pack(np.concatenate((lengths, flat)))
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    def assemble(group: pa.Table) -> pa.Table:
        head = next(i for i in range(group.num_rows) if group.column("row_ids")[i].is_valid)
        doc_ends = np.cumsum(unpack(group.column("sizes")[head].as_py()))
        word_at = np.empty(doc_ends[-1], np.int32)
        lengths, flat, words = [], [], 0
        for i in range(group.num_rows):
            counts, firsts, steps, ids = (unpack(group.column(c)[i].as_py()) for c in ("counts", "firsts", "steps", "words"))
            n = len(counts)
            lengths.append(ids[:n].astype(np.int32))
            flat.append(ids[n:].astype("<u4"))
            starts = np.cumsum(counts) - counts
            places = np.zeros(counts.sum(), np.int64)
            later = np.ones(len(places), bool)
            later[starts] = False
            places[later] = steps
            places[starts] = firsts = np.cumsum(firsts)
            places = np.cumsum(places)
            places -= np.repeat(places[starts] - firsts, counts)
            word_at[places] = np.repeat(np.arange(words, words + n, dtype=np.int32), counts)
            words += n
        lengths, flat = np.concatenate(lengths), np.concatenate(flat)
        begins = np.cumsum(lengths, dtype=np.int64) - lengths
        pieces, totals = [], np.zeros(len(doc_ends) + 1, np.int64)
        totals[1:] = doc_ends
        token_ends = np.zeros(len(word_at) + 1, np.int32)
        np.cumsum(lengths[word_at], out=token_ends[1:])
        for at in range(0, len(word_at), STRETCH):
            some = word_at[at : at + STRETCH]
            pieces.append(flat[ragged(begins[some], lengths[some])].tobytes())
        bounds = token_ends[totals].astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(doc_ends), [None, pa.py_buffer((4 * bounds).tobytes()), pa.py_buffer(b"".join(pieces))])
        columns = {id_col: group.column("row_ids")[head].values, "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids": ids}
        if round_trip:
            table = token_table(ranks_path)
            columns["decoded"] = pa.array((decoded_bytes(x.as_py(), table) for x in ids), pa.binary(), size=len(ids))
        return pa.table(columns)

    row_schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("row_ids", T.ArrayType(id_field.dataType)),
            *(T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "counts", "firsts", "steps")),
        ]
    )
    out_schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.BinaryType())] if round_trip else [])])
    exploded = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id")).mapInArrow(explode, row_schema)
    encoded = exploded.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_words, row_schema)
    return encoded.groupBy("block").applyInArrow(assemble, out_schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns plus ``decoded`` (bytes): every id joined with the token table, which is of the vocabulary's size.

    Null ids decode to no bytes; an id that the table lacks raises an error.
    """

    def factory():
        table = token_table(ranks_path)
        return lambda rows: [[decoded_bytes(r, table) for r in rows]]

    return map_text(encoded, ids_col, encoded.columns, [("decoded", "binary")], factory)
