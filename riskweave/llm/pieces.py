"""SentencePiece ids of texts by a prefix table, and texts of ids.

The model file is read for its pieces, scores and kinds only; the ids come from
:class:`~riskweave.llm.prefix_table.PrefixTable`. Pieces hold the sign for a space at their start only,
and no line breaks; a text is cut where no piece can reach across, and each cut is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.common import LATIN, map_texts
from riskweave.llm.prefix_table import UNKNOWN, PrefixTable, Recent

SPACE_SIGN = "▁"
_BYTE = re.compile("[\udc80-\udcff]+")


def _cut_pattern(plain: dict[str, int]) -> str:
    """What cuts a text where no piece reaches across; wider cuts if the pieces allow fewer."""
    if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) or "\n" in p for p in plain):
        return r"(?s:.+)"
    if any(re.search(f"[{LATIN}][^{LATIN}]", p) for p in plain):
        return rf"{SPACE_SIGN}+[^{SPACE_SIGN}\n]*|[^{SPACE_SIGN}\n]+|\n"
    return rf"{SPACE_SIGN}*[{LATIN}]+|{SPACE_SIGN}*[^{LATIN}{SPACE_SIGN}\n]+[{LATIN}]*|{SPACE_SIGN}+|\n"


class Pieces:
    """Encoder and decoder of one model file of the merge kind with byte fallback and without normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        self.bytes = [0] * 256
        plain = {}
        self.surface: dict[str, str] = {}
        self.spaced: set[str] = set()
        scores: dict[str, float] = {}
        for i in every:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                # Bytes outside ASCII wait as stand-ins until their neighbours are known.
                self.surface[str(i)] = chr(value) if value < 128 else chr(0xDC00 + value)
            elif model.is_control(i):
                self.surface[str(i)] = ""
            elif model.is_unknown(i):
                self.surface[str(i)] = " ⁇ "
            else:
                self.surface[str(i)] = piece.replace(SPACE_SIGN, " ")
                if piece.startswith(SPACE_SIGN):
                    self.spaced.add(str(i))
                if not model.is_unused(i):
                    plain[piece] = i
                    scores[piece] = -model.get_score(i)
        self.table = PrefixTable(plain, lambda a, b: scores.get(a + b))
        self.cuts = re.compile(_cut_pattern(plain)).findall
        self.cache = Recent(self._encode_cut)

    def _encode_cut(self, cut: str) -> str:
        ids: list[int] = []
        for token, start, end in self.table.encode(cut):
            if token == UNKNOWN:
                ids.extend(self.bytes[b] for b in cut[start:end].encode())
            else:
                ids.append(token)
        return ",".join(map(str, ids))

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal, joined by commas."""
        if not text:
            return ""
        return ",".join(map(self.cache.__getitem__, self.cuts(SPACE_SIGN + text.replace(" ", SPACE_SIGN))))

    def decode(self, ids: str) -> str:
        """The text of ids as ``encode`` gives them."""
        if not ids:
            return ""
        surface = self.surface
        text = "".join([surface[i] for i in ids.split(",")])
        if text[:1] == " ":  # the sign before the first word stands for no space of the text
            first = next(i for i in _each(ids) if surface[i])
            text = text[1:] if first in self.spaced else text
        return text if text.isascii() else _BYTE.sub(_from_bytes, text)


def _each(ids: str) -> Iterator[str]:
    """The ids one by one, without splitting them all."""
    at = 0
    while at <= len(ids):
        end = ids.find(",", at)
        end = len(ids) if end < 0 else end
        yield ids[at:end]
        at = end + 1


def _from_bytes(found: re.Match) -> str:
    """The characters of a run of stand-ins; a byte that belongs to none becomes U+FFFD."""
    raw, text, at = bytes(ord(c) - 0xDC00 for c in found[0]), [], 0
    while at < len(raw):
        for size in (2, 3, 4, 1):
            try:
                text.append(raw[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            text.append("�")
            size = 1
        at += size
    return "".join(text)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The tokenizer of a file, once per Python process."""
    return Pieces(path)


def encode_texts(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Ids of every text and what they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    One row per row of ``docs``, in one pass without a shuffle; a null text counts as empty and has no ids.
    """

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        model = pieces(path)
        ids = [model.encode(t) for t in texts]
        decoded = [model.decode(i) for i in ids]
        made = {
            "n_tokens": pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
        }
        if with_ids:
            made["ids"] = pa.array([[int(x) for x in i.split(",")] if i else [] for i in ids], pa.list_(pa.int32()))
            made["decoded"] = pa.array(decoded)
        return made

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return map_texts(docs, rows, schema)
