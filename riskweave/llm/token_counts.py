"""Exact token counts of every prefix, for budgets and truncation without encoding again.

A text is cut into the words of the byte-level tokenizer. Within a word the prefix table counts the tokens
of each prefix; over the words the counts add up. So one pass per text answers how many tokens it has, how
many any prefix that ends with a token has, and where a budget of tokens is used up.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskweave.llm.common import LATIN, map_texts
from riskweave.llm.prefix_table import PrefixTable, Recent

#: The characters that Unicode calls white space, and the tokenizer's word pattern.
WHITE = "\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"



def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary: itself where it is printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteCounts:
    """Counts of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs = byte_signs()
        raw = lambda t: "".join(chr(signs[c]) for c in t)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.table = PrefixTable(tokens, lambda a, b: ranks.get((a, b)))
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(WORDS).findall
        # A row of Latin letters that no other letter follows is a word; else white space and what follows stay together.
        self.cuts = re.compile(rf" ?[{LATIN}]++(?![^\W\d_])|[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+").findall
        self.cache = Recent(lambda cut: sum(map(self.word_cache.__getitem__, self.words(cut))))
        self.word_cache = Recent(lambda word: self.prefix_counts(word)[-1])

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of every prefix of a word, by bytes."""
        return self.table.fill(word.encode().decode("latin-1"))[2]

    def _counts(self, text: str) -> tuple[list[str], list[int]]:
        """The cuts of a text without special strings, and the tokens of each."""
        cuts = self.cuts(text)
        return cuts, list(map(self.cache.__getitem__, cuts))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string is one."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return sum(sum(self._counts(p)[1]) for p in parts) + len(parts) - 1
        return sum(self._counts(text)[1])

    def cut_at(self, text: str, budget: int) -> int:
        """Bytes of the longest row of whole tokens from the start of ``text`` that keeps within ``budget`` tokens."""
        left, size = budget, 0
        at = 0
        marks = [*(self.special.finditer(text) if self.special else ()), None]
        for mark in marks:
            part = text[at : mark.start() if mark else len(text)]
            cuts, counts = self._counts(part)
            ends = np.cumsum(np.asarray(counts, dtype=np.int64))
            whole = int(np.searchsorted(ends, left, side="right"))
            size += len("".join(cuts[:whole]).encode())
            left -= int(ends[whole - 1]) if whole else 0
            if whole < len(cuts):
                return size + self._within(cuts[whole], left)
            if mark:
                if not left:
                    return size
                left, size, at = left - 1, size + len(mark[0].encode()), mark.end()
        return size

    def _within(self, cut: str, left: int) -> int:
        """The same within one cut: the first word that doesn't fit is read backwards from its end."""
        size = 0
        for word in self.words(cut):
            raw = word.encode()
            _, start, count = self.table.fill(raw.decode("latin-1"))
            if count[-1] <= left:
                left, size = left - count[-1], size + len(raw)
                continue
            at = len(raw)
            while count[at] > left:
                at = start[at]
            return size + at
        return size


@lru_cache(maxsize=4)
def byte_counts(path: str) -> ByteCounts:
    """The counter of a file, once per Python process."""
    return ByteCounts(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every text: (doc_id, n_bytes, n_tokens, over_limit, fit_bytes).

    ``fit_bytes`` is the size of the longest row of whole tokens within ``limit``. One row per row of
    ``docs``, in one pass without a shuffle; a null text counts as empty.
    """

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        model = byte_counts(path)
        sizes = [len(t.encode()) for t in texts]
        counts = [model.count(t) for t in texts]
        fit = [s if n <= limit else model.cut_at(t, limit) for t, s, n in zip(texts, sizes, counts, strict=True)]
        return {
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array([n > limit for n in counts]),
            "fit_bytes": pa.array(fit, pa.int64()),
        }

    return map_texts(docs, rows, "n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
