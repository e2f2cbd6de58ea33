"""Faults of conversations, and the cheapest edits that give each one a legal order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.operators.ordered import join_keys, with_position

SPACE = " \t\n\u000b\u000c\r"
#: Rows of a conversation whose back pointers, a byte each, are written as one row.
BLOCK = 1 << 16
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
#: What may follow: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
FOLLOWING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Edits in the order in which ties are settled, the same as that of their initials.
EDITS = b"DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired binary"


def kept_as(state: int, initial: str) -> int | None:
    """The state after a row is kept as it is, or None where its role can't stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def step(after: tuple[int, ...], fault: int, initial: str) -> tuple[tuple[int, ...], int]:
    """Least costs from each state at a row, given those behind it, and the edits chosen: two bits a state."""
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    choices: list[list[tuple[int, int]]] = []
    for state in range(4):
        found = [(DELETE_COST + after[state], DELETE)]
        if fault in (OK, TRUNCATED):
            found.append((REROLE_COST + extra + after[FOLLOWING[state]], REROLE))
            if (then := kept_as(state, initial)) is not None:
                found.append((extra + after[then], KEEP))
        choices.append(found)
    plain = [min(found)[0] for found in choices]
    # inserting twice leads back to the same state, so one insertion before a plain edit, or two from the first states, is all
    best = list(plain)
    for state in (USER, ASSISTANT, START, SYSTEM):
        then = FOLLOWING[state]
        ahead = INSERT_COST + (plain[then] if state in (USER, ASSISTANT) else best[then])
        choices[state].append((ahead, INSERT))
        best[state] = min(plain[state], ahead)
    packed = 0
    for state in range(4):
        packed |= min(choices[state])[1] << (2 * state)
    return tuple(best), packed


#: Costs behind the last row: an unfinished exchange is filled up.
LAST = (0, INSERT_COST * 2, INSERT_COST, 0)


def pointers(size: int):
    """Back pointers of conversations whose rows come last first: ``conv_id``, ``block``, ``cost`` (at the first block), ``edits``.

    Only the costs of four states and one block of pointers are held from batch to batch. Costs are carried relative to the
    least one, so that there are few different steps, and each is worked out once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        conv, block, costs, base, held, first = None, None, LAST, 0, bytearray(), True
        out: list[tuple] = []
        for batch in batches:
            for c, pos, fault, initial in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if first or c != conv or pos // size != block:
                    new = first or c != conv
                    if held:
                        out.append((conv, block, base + costs[START] if new else None, bytes(reversed(held))))
                        held.clear()
                    if new:
                        conv, costs, base, first = c, LAST, 0, False
                    block = pos // size
                key = (costs, fault, initial)
                if key not in known:
                    best, packed = step(*key)
                    low = min(best)
                    known[key] = (tuple(x - low for x in best), low, packed)
                costs, low, packed = known[key]
                base += low
                held.append(packed)
            yield _rows(out, POINTER_SCHEMA)
            out.clear()
        yield _rows([(conv, block, base + costs[START], bytes(reversed(held)))] if held else [], POINTER_SCHEMA)

    return run


POINTER_SCHEMA = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("cost", pa.int64()), ("edits", pa.binary())])
RESULT_SCHEMA = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Trace:
    """Walks one conversation forward along its back pointers; what it holds doesn't grow with the texts."""

    def __init__(self, conv):
        self.conv, self.state, self.edits, self.at, self.cost = conv, START, b"", 0, 0
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.low = self.high = self.last = None
        self.turns, self.audit, self.digest, self.written = 0, bytearray(), hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.written else b"") + f"{role}:{text}".encode())
        self.written = True

    def insert(self) -> None:
        self.audit.append(EDITS[INSERT])
        self.write(ROLES[self.state], "")
        self.state = FOLLOWING[self.state]

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial
        if turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        packed = self.edits[self.at]
        self.at += 1
        while (edit := packed >> (2 * self.state) & 3) == INSERT:
            self.insert()
        self.audit.append(EDITS[edit])
        if edit == KEEP:
            self.write(role, text)
            self.state = kept_as(self.state, initial)
        elif edit == REROLE:
            self.write(ROLES[self.state], text)
            self.state = FOLLOWING[self.state]

    def result(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, self.audit.decode(), self.digest.digest()


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result per conversation, from its rows in order, each block's back pointers before the block's rows."""
    trace, out = None, []
    for batch in batches:
        for conv, edits, cost, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if trace is None or conv != trace.conv:
                if trace is not None:
                    out.append(trace.result())
                trace = Trace(conv)
            if edits is not None:
                trace.edits, trace.at = edits, 0
                trace.cost = cost if cost is not None else trace.cost
            elif fault is not None:
                trace.row(turn, role, text, fault)
        yield _rows(out, RESULT_SCHEMA)
        out = []
    yield _rows([trace.result()] if trace is not None else [], RESULT_SCHEMA)


def faults(placed: DataFrame) -> DataFrame:
    """Rows with their position and ``fault``: blank, else seen earlier in the conversation, else cut short, else none."""
    same = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = placed.withColumn("same", same)
    first = rows.groupBy("conv_id", "same").agg(F.min("pos").alias("first"))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    return join_keys(rows, first, ["conv_id", "same"]).select("conv_id", "pos", "turn", "role", "text", fault.alias("fault"))


def repair(turns: DataFrame, ids: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """``conv_id``, its counts of faults and ``gaps``, the ``cost`` and ``audit`` of its cheapest repair, and ``repaired``, the SHA-256 of that.

    ``turns``: ``conv_id``, ``turn`` (longs), ``role``, ``text`` (not null); ``ids``: ``conv_id``, further conversations that may have no rows.

    A conversation's rows are taken by turn, nulls first; rows of one turn by role, then text. Rows that are the same in all of
    that are neighbours, and all but the first are duplicates. A row's first fault counts: blank, duplicate (role and text seen
    earlier in the conversation), truncated. Roles count by their first character; an empty role can't be kept. Edits are
    Delete 4, Insert 3 (empty text), Keep 0, Rerole 3; truncated rows that stay add 3; blank ones and duplicates must go. The result's
    roles read ``(s?(ua)+)?``. Among the cheapest edits the ones with the least initials win. A null id is a conversation like any
    other. Without rows all is zero or empty; an empty table gives no rows.

    Rows are dealt by conversation and sorted twice, first backward for the costs, with back pointers written out as blocks of
    bytes, then forward along these. A task holds four costs, one block and, as the result needs it, the audit. Faults are
    found before, on shuffles in which a giant conversation is spread out.
    """
    placed = faults(with_position(turns.select("conv_id", "turn", "role", "text"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"))
    backward = placed.select("conv_id", "pos", "fault", F.left("role", F.lit(1)).alias("initial"))
    back = backward.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc(), F.col("pos").desc()).mapInArrow(pointers(block_rows), "conv_id bigint, block bigint, cost bigint, edits binary")
    none = {"edits": "binary", "cost": "bigint", "turn": "bigint", "role": "string", "text": "string", "fault": "int"}
    block = F.floor(F.col("pos") / block_rows).cast("bigint")

    def shaped(df: DataFrame, at: Column, pos: Column) -> DataFrame:
        return df.select("conv_id", at.alias("at"), pos.alias("pos"), *(F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in none.items()))

    known = shaped(ids.select("conv_id").distinct(), F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))
    forward = known.unionAll(shaped(back, F.col("block"), F.lit(-1).cast("bigint"))).unionAll(shaped(placed, block, F.col("pos")))
    ordered = forward.repartition("conv_id").sortWithinPartitions("conv_id", "at", "pos")
    return ordered.select("conv_id", *none).mapInArrow(traced, f"conv_id bigint, {RESULT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage by a hash of ``conv_id:turn``: rows dropped, emptied, without their ends of sentences, repeated, or said by the user. Nulls are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("_role"), text.alias("_text"), kind.alias("_kind")).where("_kind <> 0")
    changed = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"), changed.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
