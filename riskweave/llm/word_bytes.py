"""The words of a batch of texts, found on their bytes.

Signs of ASCII separate words here and all others belong to words, so the bytes of UTF-8 tell where words are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from riskweave.llm.common import flat_bytes

#: What a byte is: part of a word, a sign between words, or a sign that no phrase reaches across.
PART, BETWEEN, BREAK = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """A row of 256 kinds: the bytes named, all others are parts of words."""
    kinds = np.full(256, PART, dtype=np.uint8)
    kinds[list(between)] = BETWEEN
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    """``words`` in order, the row of the batch and the piece each is in; pieces have numbers of their own in every text."""

    words: pa.Array
    row: np.ndarray
    piece: np.ndarray


def words_of(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of ``texts`` (null: none), A-Z in lower case."""
    raw, starts = flat_bytes(texts)
    raw = _LOWER[raw]
    kind = kinds[raw]
    inside = kind == PART
    opens = np.zeros(len(raw) + 1, dtype=bool)  # where a text starts or the last one ends
    opens[starts] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | opens[1:-1]
    end[:-1] &= ~inside[1:] | opens[1:-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    ends = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(last - first, out=ends[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    row = np.searchsorted(starts[1:], first, side="right")
    borders = np.flatnonzero(opens[:-1] | (kind == BREAK))
    return Words(words, row, np.searchsorted(borders, first, side="right"))
