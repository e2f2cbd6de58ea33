"""The conversation trie and conversation repair against plain Python versions."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from skysift.llm import conversation_repair, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part string, n_bytes int"


def some_conversations(seed, n=60):
    """Few different turns, so that beginnings repeat; nulls, gaps, negative ids, equal and empty conversations, repeated rows, one long one."""
    rng = random.Random(seed)
    said = ["Yes.", "no", "Why?", "", None, "  \t", "Übel!", "and so on", "fine. "]
    rows = []
    for c in [*range(n), 1003, 1004, -7]:
        length = 300 if c == 1003 else rng.choice([0, 1, 2, 3, 4, 6, 12])
        for t in range(length):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("system" if t == 0 and c % 2 else ["user", "assistant"][t % 2])
            rows.append((c, None if rng.random() < 0.02 and not t else t + (t > 3), rng.choice([None, "tool", ""]) if rng.random() < 0.03 else role, rng.choice(said)))
    rows += [(2000 + 5 * k, t, "user", f"hot {t}") for k in range(70) for t in range(4)]
    return [(*r, "x", 1) for r in rows]


def crc(text):
    return zlib.crc32(text.encode())


def plain_trie(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members = {}
    made = {}
    for c, own in turns.items():
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = crc(str(c)) % 9
        made[c] = tuple(turns.get(donor, [])[:h] + own[h:])
        for d in range(len(made[c]) + 1):
            members.setdefault(made[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below, stack = [], [p]
        while stack:
            below.append(stack.pop())
            stack += kids.get(below[-1], [])
        ends = sorted(c for c in m if made[c] == p)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(df)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    rows = some_conversations(seed) + [(None, 1, "user", "nowhere", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert trie_of(df) == plain_trie(rows)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(df) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing(spark):
    assert trie_of(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_tree_parts_merge(parts):
    """Sorted keys in any number of parts give the same totals; nodes grow through all layouts."""
    rng = random.Random(parts)
    ids = [rng.randbytes(16) for _ in range(300)]
    keys = sorted({b"".join(rng.choice(ids[: 300 if not d else 3]) for d in range(rng.randint(0, 4))) for _ in range(700)})
    bounds = [len(keys) * i // parts for i in range(parts + 1)]
    done, paths = [], []
    for a, b in zip(bounds, bounds[1:]):
        tree = prefix_trie.Tree(False)
        for i in range(a, b):
            tree.insert(keys[i], [prefix_trie.Turn(2, i, 3 if d else 0) for d in range(len(keys[i]) // 16 + 1)])
            if rng.random() < 0.05:
                done += tree.harvest()
        done += tree.harvest()
        paths += [(k, [prefix_trie.Turn(*(getattr(t, x) for x in prefix_trie.LISTS)) for t in turns]) for k, turns in tree.spines()]
    tree = prefix_trie.Tree(True)
    for key, turns in paths:
        tree.insert(key, turns)
    done += tree.harvest(True)
    prefixes = {k[: 16 * d] for k in keys for d in range(len(k) // 16 + 1)}
    assert sorted((t.least, depth, t.n, t.kids) for t, depth, _, _ in done) == sorted(
        (min(i for i, k in enumerate(keys) if k.startswith(p)), len(p) // 16, 2 * sum(k.startswith(p) for k in keys), sum(q[:-16] == p and len(q) == len(p) + 16 for q in prefixes)) for p in prefixes
    )
    top = next(t for t, depth, _, _ in done if not depth)
    assert top.leaves == sum(not any(q != p and q.startswith(p) for q in prefixes) for p in prefixes)
    assert top.saved == sum(3 * (2 * sum(k.startswith(p) for k in keys) - 1) for p in prefixes if p)


def plain_damage(rows):
    out = {}
    for c, t, role, text, *_ in rows:
        kind = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = out.setdefault(c, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        here += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def plain_repair(conv):
    space = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, _, role, text in conv:
        body = text.strip(space)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def after(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role))

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(conv) and state in ("", "a") else []
        want = "a" if state == "u" else "u"
        if inserted < 2:
            cost, audit, rest = best(i, want, inserted + 1)
            found.append((cost + 3, "I" + audit, ("+" + want, *rest)))
        if i < len(conv):
            cost, audit, rest = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, ("-", *rest)))
            if faults[i] not in ("b", "d"):
                extra = 3 if faults[i] == "t" else 0
                cost, audit, rest = best(i + 1, want, 0)
                found.append((cost + 3 + extra, "R" + audit, (want, *rest)))
                if (then := after(state, conv[i][2][:1])) is not None:
                    cost, audit, rest = best(i + 1, then, 0)
                    found.append((cost + extra, "K" + audit, ("=", *rest)))
        return min(found) if found else (10**9, "", ())

    import sys
    sys.setrecursionlimit(20000)
    cost, audit, moves = best(0, "", 0)
    lines, i = [], 0
    for m in moves:
        if m[0] == "+":
            lines.append({"u": "user", "a": "assistant"}[m[1]] + ":")
            continue
        if m != "-":
            lines.append((conv[i][2] if m == "=" else {"u": "user", "a": "assistant"}[m]) + ":" + conv[i][3])
        i += 1
    numbers = [t for known, t, *_ in conv if known]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(conv, conv[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).digest()


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_repair(spark, block):
    rows = some_conversations(3) + [(None, t, "user", "Is it?", "x", 1) for t in range(5)] + [(3000, t, "user", "Go.", "x", 1) for t in (1, 1, 2)]
    rows += [(4000, next(t for t in range(999) if crc(f"4000:{t}") % 20 == 0), "user", "gone", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damaged(df), df, block).collect()}
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items()}
    assert found == {c: (*v[:-1], v[-1]) for c, v in want.items()}
    assert found[4000][-3:-1] == (0, "") and found[1003][-3] > 0


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damaged(df), df).collect() == []
