"""Merge tokenizers by a table of prefixes instead of merges.

A merge tokenizer joins, again and again, the adjacent pair of lowest rank (the leftmost of equals). A
row of tokens is its result exactly if each adjacent pair of them is: a merge that crosses a border
needs only what stands on both sides of it. So every prefix of a text ends in one token only, and that
token can be found from left to right: of the tokens that end here (an automaton finds them), it is the
one that is compatible with the last token of the prefix before it. The ids of any prefix are then read
backwards, and their number is that of the shorter prefix plus one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import ahocorasick

#: Stands for a symbol that no token covers, and for the start of the text.
UNKNOWN, START = -1, -2


#: Bytes of each half of what a worker remembers, with what Python needs for an entry, the longest word that is
#: remembered, and pairs of tokens whose compatibility is.
REMEMBERED, ENTRY, LONGEST, PAIRS = 24 << 20, 200, 1000, 200_000


class Recent(dict):
    """Results of ``make`` by argument. It is bounded: what wasn't asked for since it was last emptied is made anew."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make
        self.older: dict = {}
        self.size = 0

    def __missing__(self, key: str):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        # Up to four bytes a character, here and in what is made of it.
        self.size += ENTRY + 4 * (len(key) + (len(value) if isinstance(value, str) else 0))
        if self.size > REMEMBERED:
            self.older = dict(self)
            self.clear()
            self.size = 0
        return value


class PrefixTable:
    """``tokens`` gives the id of each token; ``pair_rank`` the rank at which two neighbours are merged, or None."""

    def __init__(self, tokens: dict[str, int], pair_rank: Callable[[str, str], float | None]):
        self.pair_rank = pair_rank
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.born: dict[str, float] = {}
        self.text = {i: t for t, i in tokens.items()}
        self.automaton = ahocorasick.Automaton()
        self.left: dict[int, list[tuple[str, float, float]]] = {}
        self.right: dict[int, list[tuple[str, float, float]]] = {}
        self.fits: dict[int, bool] = {}
        self.width = max(tokens.values(), default=0) + 1
        for token in sorted(tokens, key=len):
            if self._derive(token):
                self.automaton.add_word(token, (tokens[token], len(token)))
        self.automaton.make_automaton()

    def _derive(self, token: str) -> bool:
        """Find the last merge that makes ``token``; False if merging its symbols makes something else."""
        if len(token) == 1:
            self.parts[token], self.born[token] = None, -1.0
            return True
        symbols = list(token)
        while len(symbols) > 2:
            ranked = [(r, i) for i in range(len(symbols) - 1) if (r := self.pair_rank(symbols[i], symbols[i + 1])) is not None]
            if not ranked:
                return False
            _, i = min(ranked)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        rank = self.pair_rank(*symbols)
        if rank is None or any(s not in self.born for s in symbols):
            return False
        self.parts[token] = (symbols[0], symbols[1])
        # A merge can't come before those of its parts.
        self.born[token] = max(rank, *(self.born[s] for s in symbols))
        return True

    def _edge(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """The symbols that stood at one edge of ``token`` while it was made: (symbol, born, gone)."""
        found, gone = [], math.inf
        while True:
            found.append((token, self.born[token], gone))
            gone = self.born[token]
            if (parts := self.parts[token]) is None:
                return found
            token = parts[side]

    def compatible(self, first: int, second: int) -> bool:
        """Whether two tokens stay as they are when they stand side by side."""
        key = first * self.width + second
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[key] = not self._crossed(first, second)
        return known

    def _crossed(self, first: int, second: int) -> bool:
        if first not in self.right:
            self.right[first] = self._edge(self.text[first], 1)
        if second not in self.left:
            self.left[second] = self._edge(self.text[second], 0)
        for a, a_born, a_gone in self.right[first]:
            for b, b_born, b_gone in self.left[second]:
                # Of equal ranks the merge further left comes first.
                if b_born < a_gone and a_born <= b_gone and (rank := self.pair_rank(a, b)) is not None:
                    when = max(rank, a_born, b_born)
                    if when < a_gone and when <= b_gone:
                        return True
        return False

    def fill(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Per prefix of ``text``, the empty one included: its last token, where that starts, and the number of tokens.

        A symbol outside the vocabulary counts as one token, ``UNKNOWN``.
        """
        size = len(text)
        last, start, count = [START] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        fits, width, done = self.fits, self.width, 0
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # positions where no token ends
                done += 1
                if last[done] == START:
                    last[done], start[done], count[done] = UNKNOWN, done - 1, count[done - 1] + 1
            done = end - 1
            begin = end - length
            before = last[begin]
            if last[end] == START and (before < 0 or ((f := fits.get(before * width + token)) is None and self.compatible(before, token)) or f):
                last[end], start[end], count[end] = token, begin, count[begin] + 1
        while done < size:
            done += 1
            if last[done] == START:
                last[done], start[done], count[done] = UNKNOWN, done - 1, count[done - 1] + 1
        return last, start, count

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """The tokens of ``text`` as (id, start, end), recovered from the end of the table."""
        last, start, _ = self.fill(text)
        found, at = [], len(text)
        while at:
            found.append((last[at], start[at], at))
            at = start[at]
        return found[::-1]
