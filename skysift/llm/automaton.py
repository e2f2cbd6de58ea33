"""Benchmark passages in documents, found with a suffix automaton over the words of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import fresh, map_text
from skysift.session import cut

#: Words are runs of 0-9, a-z and bytes beyond ASCII, after A-Z are lower-cased; every other byte ends a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT_WORDS, BLOCK_WORDS = 5_000, 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, each with an id.

    After each word of a stream it holds the longest match that ends there. A window is ``window``
    consecutive words of an item; an item of fewer words is one window.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int):
        self.window, self.step, self.link, self.length = window, [{}], [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: ids of the items that hold the window a state stands for, and per state the shorter items that end in it
        self.holders: dict[int, set] = {}
        self.shorter: dict[int, dict] = {}
        top: dict[int, int] = {}
        for name, words in items:
            state = 0
            for n, word in enumerate(words, 1):
                state = self.step[state][word]
                if n >= window:
                    self.holders.setdefault(self._window_state(state, top), set()).add(name)
            if n < window:
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                self.shorter.setdefault(state, {}).setdefault(n, set()).add(name)
        #: per state, its window's state, or 0
        self.at = [self._window_state(s, top) if s and self.length[s] >= window else 0 for s in range(len(self.step))]
        ends = [False] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            ends[s] = s in self.shorter or ends[self.link[s]]
        self.ends_shorter = ends if self.shorter else None

    def _extend(self, last: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, word, known)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    def _window_state(self, state: int, top: dict[int, int]) -> int:
        """The suffix of ``window`` words of a state's strings, as a state."""
        path = []
        while state not in top and self.length[self.link[state]] >= self.window:
            path.append(state)
            state = self.link[state]
        found = top.get(state, state)
        for s in (*path, state):
            top[s] = found
        return found

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged runs [first, end) of words inside an occurrence of a window, and the ids of the items found."""
        step, link, lengths, at, window, ends = self.step, self.link, self.length, self.at, self.window, self.ends_shorter
        spans: list[list[int]] = []
        states, found = set(), set()
        state = n = 0
        root = step[0]
        here = root
        for i, word in enumerate(words):
            to = here.get(word)
            if to is None:
                while state:
                    state = link[state]
                    to = step[state].get(word)
                    if to is not None:
                        n = lengths[state]
                        break
                else:
                    n, here = 0, root
                    continue
            state, n = to, n + 1
            here = step[to]
            if n >= window:
                states.add(at[to])
                add_span(spans, i + 1 - n, i + 1)
            if ends and ends[to]:
                self._shorter(to, n, i, spans, found)
        for s in states:
            found |= self.holders.get(s, set())
        return spans, found

    def _shorter(self, state: int, n: int, i: int, spans: list, found: set) -> None:
        while state > 0:
            for k, names in self.shorter.get(state, {}).items():
                if k <= n:
                    found |= names
                    add_span(spans, i + 1 - k, i + 1)
            state = self.link[state]


def add_span(spans: list[list[int]], first: int, end: int) -> None:
    """Add a run that ends no earlier than all before it; runs that touch become one."""
    while spans and spans[-1][1] >= first:
        first = min(first, spans.pop()[0])
    spans.append([first, end])


def item_segments(items: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    """Items as segments of at most SEGMENT_WORDS words that overlap by a window less one word, so that no window is lost."""

    def factory():
        def cut(texts):
            ahead = SEGMENT_WORDS - window + 1
            every = [words_of(t) for t in texts]
            return ([[b" ".join(w[k : k + SEGMENT_WORDS]).decode() for k in range(0, max(1, len(w) - window + 1), ahead)] if w else [] for w in every],)

        return cut

    named = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text_col).alias("item_text"))
    return map_text(named, "item_text", ["item"], [("segments", "array<string>")], factory).select("item", F.explode("segments").alias("segment"))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, limits: tuple[int, float] | None = None) -> DataFrame:
    """Columns ``keep`` plus ``n_words``, ``spans`` (flat first, end pairs of hit word runs), ``hit_items`` and, with ``limits``, ``clean_text``.

    A document word inside any occurrence of a window of an item is hit. The items' words are counted first;
    they are dealt by hash into blocks of about BLOCK_WORDS words, and each block becomes one automaton of bounded
    size that the documents stream past, without a shuffle. With several blocks each pass is checkpointed, so that
    no task holds two automata.

    ``limits=(words, share)`` removes hit runs of at least that many words from the text; where hit words make
    up more than that share of a document, ``clean_text`` is null. Null and empty texts have no words; items with a
    null id or no words are left out; items that share an id are one item with several texts.
    """
    spark = docs.sparkSession
    segments = item_segments(items, item_id, item_text, window).withColumn("words", F.size(F.split("segment", " ")))
    total = segments.agg(F.sum("words")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    dealt = segments.withColumn("block", F.pmod(F.xxhash64("item", "segment"), F.lit(blocks)))
    runs, names = fresh(docs, "spans"), fresh(docs, "hit_items")
    docs = docs.select(*dict.fromkeys([*keep, text_col]))

    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item", "segment").collect()
        built = spark.sparkContext.broadcast(Automaton([(r["item"], r["segment"].encode().split()) for r in rows], window))
        last = block == blocks - 1
        fields = [(fresh(docs, "n_words"), "bigint"), (runs, "array<bigint>"), (names, "array<string>")] if last else [(f"_spans{block}", "array<bigint>"), (f"_items{block}", "array<string>")]
        if last and limits:
            fields.append((fresh(docs, "clean_text"), "string"))
        before = [f"_{what}{b}" for b in range(block) for what in ("spans", "items")]
        scan = _scanner(built, last, limits)
        if last:
            return map_text(docs, text_col, keep, fields, scan, before)
        docs = cut(map_text(docs, text_col, docs.columns, fields, scan))


def _scanner(built, last: bool, limits: tuple[int, float] | None):
    def factory():
        automaton = built.value

        def scan(texts, *before):
            counts, runs, names, left = [], [], [], []
            for i, text in enumerate(texts):
                words = words_of(text)
                spans, found = automaton.matches(words)
                if last and before:
                    found = found.union(*(b[i] for b in before[1::2]))
                    every = sorted([*spans, *(pair for b in before[::2] for pair in zip(b[i][::2], b[i][1::2]))], key=lambda p: p[1])
                    spans = []
                    for first, end in every:
                        add_span(spans, first, end)
                counts.append(len(words))
                runs.append([x for span in spans for x in span])
                names.append(sorted(found))
                if last and limits:
                    left.append(without_runs(text, spans, len(words), *limits))
            return [counts, runs, names, left][not last :] if limits else [counts, runs, names][not last :]

        return scan

    return factory


def without_runs(text: bytes | None, runs: list[list[int]], n_words: int, least: int, share: float) -> str | None:
    """The text without hit runs of ``least`` words or more; None where over ``share`` of its words are hit, or for None."""
    if not runs:
        return None if text is None else text.decode()
    if sum(b - a for a, b in runs) > share * n_words:
        return None
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    out, at = [], 0
    for a, b in runs:
        if b - a >= least:
            out.append(text[at : places[a][0]])
            at = places[b - 1][1]
    return b"".join([*out, text[at:]]).decode()
