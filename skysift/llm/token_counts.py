"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from skysift.llm.common import map_text

#: Code points beyond which a text is encoded in chunks, of a chunk, and of the overlap at first.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
#: Distinct words whose counts a task keeps.
CACHE = 400_000
SPACE = " \t\n\r\x0b\x0c"


def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def starts(tokenizer: Tokenizer, text: str, at: int) -> list[int]:
    """Where each token of the text starts, in code points, moved by ``at``."""
    return [at + first for first, _ in tokenizer.encode(text, add_special_tokens=False).offsets]


def spliced_count(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of a huge text, its chunks, and how often an overlap had to be widened.

    A chunk is encoded with offsets, the next one from ``overlap`` before its end. A place in the overlap where both
    start a token after white space is stable: white space ends every word of the tokenizer and no step of it looks
    beyond, so the tokens before it are right in the first chunk and those from it on in the second. The chunks
    are spliced there. Where there is no such place both are encoded again with a doubled overlap, at last to the end.
    """
    total = chunks = widened = 0
    begin, end = 0, min(len(text), chunk)
    here = starts(tokenizer, text[begin:end], begin)
    while end < len(text):
        chunks += 1
        reach = overlap
        while True:
            next_begin = max(begin + 1, end - reach)
            next_end = min(len(text), max(end + chunk, next_begin + 2 * reach))
            there = starts(tokenizer, text[next_begin:next_end], next_begin)
            common = sorted(p for p in set(here).intersection(there) if next_begin < p < end and text[p - 1] in SPACE)
            if common or end == len(text):
                break
            widened += 1
            reach *= 2
            end = min(len(text), end + reach)
            here = starts(tokenizer, text[begin:end], begin)
        if not common:
            break
        stable = common[len(common) // 2]
        total += sum(p < stable for p in here)
        here, begin, end = [p for p in there if p >= stable], stable, next_end
    return total + len(here), chunks + 1, widened


class Counter:
    """Counts tokens of texts; words between white space are counted once and remembered.

    Words are taken through the library's own steps (normalise, split, merge), many at a time, so that equal parts
    of words are merged once. Words with strings of added tokens or other white space go through ``encode`` whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.parts = load(path), {}, {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if len(t.split()) == 1 and not any(a in t for a in self.added)]
        normal = self.tokenizer.normalizer.normalize_str("\n".join(texts[i] for i in plain)).split(" ")
        if len(normal) != len(plain):
            plain, normal = [], []
        ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(normal))
        known, merge = self.parts, self.tokenizer.model.tokenize
        if len(known) > CACHE:
            known.clear()
        sizes = []
        for part, _ in parts:
            n = known.get(part)
            if n is None:
                n = known[part] = len(merge(part))
            sizes.append(n)
        at = np.searchsorted(ends, np.fromiter((place[0] for _, place in parts), np.int64, len(parts)), side="right")
        counts = np.bincount(at, weights=sizes, minlength=len(normal)).astype(int).tolist() if parts else []
        self.known.update(zip((words[i] for i in plain), counts))
        for i in sorted(set(range(len(words))).difference(plain)):
            self.known[words[i]] = len(self.tokenizer.encode(texts[i], add_special_tokens=False))

    def count(self, texts: list[bytes | None], huge: int = HUGE) -> tuple[list[int], list[int], list[int]]:
        counts, chunks, widened = [], [], []
        words = [[] if not t or self._huge(t, huge) else t.split() for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        new = list({w for ws in words for w in ws}.difference(known))
        for i in range(0, len(new), 4096):
            self.learn(new[i : i + 4096])
        for text, ws in zip(texts, words):
            if text and self._huge(text, huge):
                n, c, w = spliced_count(self.tokenizer, text.decode())
            else:
                n, c, w = sum(map(known.__getitem__, ws)), 1, 0
            counts.append(n)
            chunks.append(c)
            widened.append(w)
        return counts, chunks, widened

    @staticmethod
    def _huge(text: bytes, huge: int) -> bool:
        return len(text) > huge and len(text.decode()) > huge


def count_tokens(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """Columns ``keep`` plus ``n_bytes``, ``n_tokens``, ``n_chunks`` and ``n_widened``, one row per row of ``docs``.

    Counts are those of the tokenizers library for the whole text, without added special tokens, truncation or
    padding; strings of special tokens inside a text count as the library's default has it. The tokenizer must
    end words at white space, as those with a white-space pre-tokenizer do. Null and empty texts have no tokens.
    """

    def factory():
        counter = Counter(path)

        def run(texts):
            counts, chunks, widened = [], [], []
            for i in range(0, len(texts), 256):  # so that the words of some documents are held, not of a batch
                for whole, part in zip((counts, chunks, widened), counter.count(texts[i : i + 256], huge)):
                    whole.extend(part)
            return [len(t or b"") for t in texts], counts, chunks, widened

        return run

    return map_text(docs, text_col, keep, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("n_chunks", "bigint"), ("n_widened", "bigint")], factory)
