"""Tries of turn sequences, built as adaptive radix trees over sorted parts of the corpus and merged along their edges."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.operators.ordered import ranked, with_position
from skysift.session import cut

#: Bytes of a turn's id.
WIDTH = 16
#: Turns that a task's tree holds before finished subtrees are taken out, and parts that one merge puts together.
HARVEST, FAN_IN = 1 << 16, 64
#: A conversation's class of equal sequences gets its list of ids hashed in pieces of so many.
PIECE = 8192
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
PATH = "key binary, n array<bigint>, least array<bigint>, n_bytes array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, parent_ref string, ref string, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


class Sparse:
    """Up to ``size`` children, their bytes sorted."""

    def __init__(self, size: int):
        self.size, self.bytes, self.nodes = size, bytearray(), []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node) -> bool:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        elif len(self.bytes) == self.size:
            return False
        else:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        return True

    def items(self):
        return list(zip(self.bytes, self.nodes))


class Indexed:
    """Up to 48 children, found through a table of 256 places."""

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int):
        return self.nodes[self.places[byte] - 1] if self.places[byte] else None

    def put(self, byte: int, node) -> bool:
        if self.places[byte]:
            self.nodes[self.places[byte] - 1] = node
        elif len(self.nodes) == 48:
            return False
        else:
            self.nodes.append(node)
            self.places[byte] = len(self.nodes)
        return True

    def items(self):
        return [(b, self.nodes[p - 1]) for b, p in enumerate(self.places) if p]


class Direct:
    """A child or nothing for each of 256 bytes."""

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self):
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


def layout(items: list):
    """The smallest layout that holds the children."""
    made = Sparse(4) if len(items) <= 4 else Sparse(16) if len(items) <= 16 else Indexed() if len(items) <= 48 else Direct()
    for byte, node in items:
        made.put(byte, node)
    return made


class Turn:
    """What is known of one turn-aligned prefix; totals below hold only subtrees that were taken out already."""

    __slots__ = ("n", "least", "n_bytes", "kids", "leaves", "saved", "ends", "ref")

    def __init__(self, n=0, least=None, n_bytes=0, kids=0, leaves=0, saved=0, ends=None):
        self.n, self.least, self.n_bytes, self.kids, self.leaves, self.saved, self.ends, self.ref = n, least, n_bytes, kids, leaves, saved, ends, None

    def merge(self, other: Turn) -> None:
        self.n += other.n
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.n_bytes = max(self.n_bytes, other.n_bytes)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.ends = self.ends or other.ends


class Node:
    """A compressed edge: bytes ``start`` to ``start + len(label)`` of its keys, the turns that end on it, and children behind it."""

    __slots__ = ("start", "label", "turns", "below")

    def __init__(self, start: int, label: bytes, turns: list[Turn], below=None):
        self.start, self.label, self.turns, self.below = start, label, turns, below or Sparse(4)

    def child(self, byte: int, node: Node) -> None:
        if not self.below.put(byte, node):
            self.below = layout([*self.below.items(), (byte, node)])

    def split(self, at: int) -> None:
        """Ends this edge before its byte ``at``; the rest becomes its only child."""
        upper = (self.start + at) // WIDTH - self.start // WIDTH
        rest = Node(self.start + at, self.label[at:], self.turns[upper:], self.below)
        self.label, self.turns, self.below = self.label[:at], self.turns[:upper], Sparse(4)
        self.below.put(rest.label[0], rest)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    limit = min(len(a), len(b))
    if a[:limit] == b[:limit]:
        return limit
    low, high = 0, limit
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


class Tree:
    """An adaptive radix tree of turn sequences.

    Keys come in order, so whatever is off the paths of the first and the last key is complete: it is taken out, and its totals are
    added to the turn above. What is left is at most two paths.
    """

    def __init__(self, merging: bool):
        self.root, self.top, self.merging = Node(0, b"", []), Turn(), merging
        self.first, self.last, self.held = None, b"", 0

    def insert(self, key: bytes, turns: list[Turn]) -> None:
        """Adds a path: ``turns[0]`` belongs to the root, ``turns[d]`` to the first d ids."""
        if self.merging:
            for turn, ref in zip(turns, refs(key)):
                turn.ref = ref
            self.top.ref = turns[0].ref
        self.first, self.last = key if self.first is None else self.first, key
        self.held += len(turns)
        self.top.merge(turns[0])
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                node.child(key[at], Node(at, key[at:], turns[at // WIDTH + 1 :]))
                return
            same = shared(child.label, key[at : at + len(child.label)])
            if same < len(child.label):
                child.split(same)
            for d, turn in enumerate(child.turns, at // WIDTH + 1):
                turn.merge(turns[d])
            node, at = child, at + same

    def path(self, key: bytes) -> list[Node]:
        """The nodes of a key that is in the tree, behind the root; it ends where a node does."""
        nodes, at = [], 0
        node = self.root
        while at < len(key):
            node = node.below.get(key[at])
            nodes.append(node)
            at += len(node.label)
        return nodes

    def harvest(self, final: bool = False) -> Iterator[tuple]:
        """Takes out complete turns: each with its depth, the turn above and whether that one may still change."""
        paths = [] if final or self.first is None else [self.path(self.first), self.path(self.last)]
        kept = {id(node) for path in paths for node in path}
        seen = set()
        for key, path in zip((self.first, self.last), paths or [[]]):
            digest, done, above = hashlib.blake2b(digest_size=WIDTH), 0, self.top
            for node in [self.root, *path]:
                above = node.turns[-1] if node.turns else above
                end = (node.start + len(node.label)) // WIDTH * WIDTH
                digest.update(key[done:end])
                done = end
                if id(node) in seen:
                    continue
                seen.add(id(node))
                children = node.below.items()
                complete = [child for _, child in children if id(child) not in kept]
                if complete:
                    above.ref = digest.copy().hexdigest()
                    node.below = layout([(b, child) for b, child in children if id(child) in kept])
                for child in complete:
                    yield from finish(child, above, not final)
        if final and self.first is not None:
            close(self.top)
            yield self.top, 0, None, False
        self.held = sum(len(node.turns) for path in paths for node in path)

    def spines(self) -> Iterator[tuple[bytes, list[Turn]]]:
        """The paths that other parts of the corpus may share, each turn in one of them only."""
        if self.first is None:
            return
        seen = set()
        for key in [self.first] if self.first == self.last else [self.first, self.last]:
            turns = [self.top, *(t for node in self.path(key) for t in node.turns)]
            yield key, [Turn() if id(t) in seen else t for t in turns]
            seen.update(id(t) for t in turns)


def refs(key: bytes) -> list[str]:
    """Names of a key's turn-aligned prefixes, the empty one first."""
    digest, out = hashlib.blake2b(digest_size=WIDTH), []
    for at in range(0, len(key) + 1, WIDTH):
        out.append(digest.copy().hexdigest())
        digest.update(key[at : at + WIDTH])
    return out


def close(turn: Turn) -> None:
    turn.leaves = turn.leaves if turn.kids else 1
    turn.saved += (turn.n - 1) * turn.n_bytes


def finish(node: Node, above: Turn, open_: bool) -> Iterator[tuple]:
    """All turns of a subtree, each after those below it, as ``Tree.harvest`` yields them."""
    order, stack = [], [(node, above, open_)]
    while stack:
        node, above, open_ = stack.pop()
        order.append((node, above, open_))
        last, still = (node.turns[-1], False) if node.turns else (above, open_)
        stack.extend((child, last, still) for _, child in node.below.items())
    for node, above, open_ in reversed(order):
        for i in range(len(node.turns) - 1, -1, -1):
            turn, over = node.turns[i], node.turns[i - 1] if i else above
            close(turn)
            over.kids, over.leaves, over.saved = over.kids + 1, over.leaves + turn.leaves, over.saved + turn.saved
            yield turn, node.start // WIDTH + 1 + i, over, open_ and not i


LISTS = ("n", "least", "n_bytes", "kids", "leaves", "saved", "ends")
SCHEMA = pa.schema([
    ("part", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_ref", pa.string()), ("ref", pa.string()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("key", pa.binary()), *((name, pa.list_(pa.string() if name == "ends" else pa.int64())) for name in LISTS),
])


def batch_of(part: int, nodes: list[tuple], paths: list[tuple[bytes, list[Turn]]]) -> pa.RecordBatch:
    rows = [
        (part, t.least, depth, None if open_ or over is None else over.least, over.ref if open_ else None, t.ref, t.n, t.kids, t.leaves, t.saved, t.ends or EMPTY_HASH, *[None] * 8)
        for t, depth, over, open_ in nodes
    ]
    rows += [(part, *[None] * 10, key, *([getattr(t, name) for t in turns] for name in LISTS)) for key, turns in paths]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(SCHEMA)], schema=SCHEMA)


def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of one sorted part: rows ``key``, ``n``, ``least``, ``n_bytes`` (one a turn), ``ends``."""
    tree, part = Tree(merging=False), TaskContext.get().partitionId()
    for batch in batches:
        for key, n, least, sizes, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
            turns = [Turn(n, least, size) for size in (0, *sizes)]
            turns[-1].ends = ends
            tree.insert(key, turns)
            if tree.held > HARVEST:
                yield batch_of(part, list(tree.harvest()), [])
    yield batch_of(part, list(tree.harvest()), [])
    yield batch_of(part, [], list(tree.spines()))


def merged(final: bool):
    """Trees of neighbouring parts' paths: rows ``part``, ``key`` and LISTS, sorted by part and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part = None, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(2 + len(LISTS)))):
                if tree is None or row[0] != part:
                    if tree is not None:
                        yield batch_of(part, list(tree.harvest(final)), [])
                        yield batch_of(part, [], [] if final else list(tree.spines()))
                    tree, part = Tree(merging=True), row[0]
                tree.insert(row[1], [Turn(*values) for values in zip(*row[2:])])
                if tree.held > HARVEST:
                    yield batch_of(part, list(tree.harvest()), [])
        if tree is not None:
            yield batch_of(part, list(tree.harvest(final)), [])
            yield batch_of(part, [], [] if final else list(tree.spines()))

    return run


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per class from its joined ids' pieces in order: rows ``class``, ``ids``."""
    name, digest, out = None, None, []
    for batch in batches:
        for c, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if c != name:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = c, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], ["class", "ends"])
        out = []
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, digest.hexdigest())], ["class", "ends"])


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 1), ``turn_id`` (hex of a 128-bit hash of role and text) and ``n_bytes`` of the text, by turn, nulls first.

    Null roles and texts are empty. Rows of one turn are ordered by their turn id. Rows without a conversation's id are in no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), turn_id.alias("turn_id"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_id")], rank="at", size=None).select("conv_id", F.col("at").cast("bigint").alias("at"), "turn_id", "n_bytes")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations with shared beginnings: ``conv_id``, ``part``, ``at``, ``turn_id``, ``n_bytes``; one row without a turn for each besides.

    The first h turns come from conversation c - c % 5, the others, after the first h, from c itself; h is a hash of the id, modulo 9.
    """
    turns = cut(turn_sequences(conversations))
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).where("at > h").select("conv_id", F.lit(1).alias("part"), "at", "turn_id", "n_bytes")
    heads = turns.where("at <= 8").withColumnRenamed("conv_id", "donor")
    lent = convs.join(heads, "donor").where("at <= h").select("conv_id", F.lit(0).alias("part"), "at", "turn_id", "n_bytes")
    none = convs.select("conv_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("bigint").alias("n_bytes"))
    return own.unionAll(lent).unionAll(none)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct beginning of a conversation: a node of the trie of turn sequences, the empty one included.

    ``turns``: ``conv_id`` (long, not null), ``part``, ``at`` (their order in the conversation), ``turn_id`` (32 hex digits), ``n_bytes``;
    rows with a null ``turn_id`` only say that the conversation exists. Result: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Equal sequences are one key with a count. Keys, 16 bytes a turn, are sorted by ranges; each range is one adaptive radix tree
    with path compression, of which turn-aligned depths alone become nodes. A node that no other range can share is complete at
    once. Those on the paths of a range's first and last key are merged with their neighbours', 64 ranges at a time. A hot first turn is
    therefore spread over ranges, and a task holds two paths and the keys since the last harvest. One conversation's ids are one row,
    16 bytes a turn. An empty table has no nodes.
    """
    entry = F.when(F.col("turn_id").isNotNull(), F.struct("part", "at", "turn_id", "n_bytes"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    key = F.unhex(F.array_join(F.col("x.turn_id"), ""))
    convs = cut(listed.select("conv_id", key.alias("key"), F.col("x.n_bytes").alias("n_bytes")).withColumn("class", F.md5("key")))

    placed = with_position(convs.select("class", "conv_id"), "class", "conv_id")
    pieces = placed.groupBy("class", F.floor(F.col("pos") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    ends = pieces.repartition("class").sortWithinPartitions("class", "piece").select("class", "ids").mapInArrow(hashed, "class string, ends string")
    classes = convs.groupBy("class").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("n_bytes").alias("n_bytes")).join(ends, "class")

    schema = f"part bigint, {NODE}, {PATH}"
    ordered = classes.repartitionByRange("key").sortWithinPartitions("key")
    found = cut(ordered.select("key", "n", "least", "n_bytes", "ends").mapInArrow(planted, schema))
    nodes = found.where("key IS NULL")
    while (last := found.where("key IS NOT NULL").agg(F.max("part")).first()[0]) is not None:
        paths = found.where("key IS NOT NULL").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        ready = paths.repartition("part").sortWithinPartitions("part", "key").select("part", "key", *LISTS)
        found = cut(ready.mapInArrow(merged(last < FAN_IN), schema))
        nodes = nodes.unionAll(found.where("key IS NULL"))
    names = [c.split()[0] for c in NODE.split(", ")]
    result = [c for c in names if c not in ("parent_ref", "ref")]
    known = nodes.where("parent_ref IS NULL").select(*result)
    above = cut(nodes.where("ref IS NOT NULL").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("above")))
    waiting = nodes.where("parent_ref IS NOT NULL").drop("parent_conv_id").join(above, "parent_ref").withColumnRenamed("above", "parent_conv_id")
    return known.unionAll(waiting.select(*result))
