"""Language identification by error-correcting output codes.

Each language has a codeword of bits. Per bit, a binary classifier over hashed byte trigrams tells on which
side of the code a text is; the language whose codeword loses least against all classifiers is chosen, and
a text on which two codewords come close is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import flat_bytes, held_out, map_column, small_batches, sums

#: Training sample: documents per language and characters per document; longer documents teach nothing.
SAMPLE, LONGEST = 400, 20_000
SLOTS_BITS = 15
#: Evidence counts as that of so many trigrams at most, so that a long text isn't judged as beyond doubt.
EVIDENCE = 30.0
#: Below this difference in loss to the next language a text is ambiguous.
MARGIN = 2.0
UNDECIDED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Weights that lie side by side at a time, and letters of a text that are looked at together.
_CELLS, _FEWEST = 1 << 20, 1 << 12

# ASCII letters are lower-cased, other ASCII signs count as a space; bytes of other letters stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


@dataclass
class LanguageModel:
    """``codes`` has a row of +1 and -1 per language, ``weights`` a row per trigram slot and a column per bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray


def codewords(count: int) -> np.ndarray:
    """Codes of ``count`` languages: every split in two where those are few, else the best of some random codes."""
    if count < 2:
        return np.ones((count, 0))
    if count <= 7:
        splits = [s for size in range(1, count) for s in combinations(range(count), size) if 0 in s]
        return np.array([[1.0 if k in s else -1.0 for s in splits] for k in range(count)])
    bits, best, apart = int(np.ceil(10 * np.log2(count))), None, -1.0
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (count, bits))
        near = code @ code.T - 2 * bits * np.eye(count)
        distance = (bits - near.max()) / 2
        if np.abs(code.sum(axis=0)).max() < count and distance > apart:
            best, apart = code, distance
    return best


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of the joined texts, and where each text starts and the last one ends."""
    raw, starts = flat_bytes(pa.array([f" {t.lower()}  " for t in texts], pa.large_string()))
    return _FOLD[raw], starts


def trigrams(signs: np.ndarray, at: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the trigram at each of ``step`` places from ``at`` on, and whether it counts."""
    some = signs[at : at + step + 2]
    wide = some.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    # Each letter counts once, in the trigram around it. The last two places of a text hold spaces, so no trigram
    # that counts reaches into the next one.
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS_BITS), some[1:-1] != 32


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model of (language, text) rows: per bit, smoothed log odds of each slot."""
    languages = sorted({r[0] for r in rows})
    codes = codewords(len(languages))
    seen = np.zeros((len(languages), 1 << SLOTS_BITS))
    for k, language in enumerate(languages):
        signs, _ = folded([t for name, t in rows if name == language])
        for at in range(0, len(signs) - 2, _CELLS):
            slots, counts = trigrams(signs, at, _CELLS)
            seen[k] += np.bincount(slots[counts], minlength=1 << SLOTS_BITS)
    share = (seen + 0.05) / (seen + 0.05).sum(axis=1, keepdims=True)  # languages count alike
    weights = np.zeros((1 << SLOTS_BITS, codes.shape[1]), dtype=np.float32)
    for bit in range(codes.shape[1]):
        up, down = codes[:, bit] > 0, codes[:, bit] < 0
        weights[:, bit] = np.log(share[up].mean(axis=0) / share[down].mean(axis=0))
    return LanguageModel(languages, codes, weights)


def evidence(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Margin of each binary classifier per text, worked off in pieces of one size whatever the number of bits."""
    bits = model.codes.shape[1]
    signs, starts = folded(texts)
    total, number = np.zeros((len(texts), bits)), np.zeros(len(texts))
    step = max(_FEWEST, _CELLS // max(1, bits))
    for at in range(0, len(signs) - 2, step):
        slots, counts = trigrams(signs, at, step)
        # Only texts that reach into this piece.
        low, high = np.searchsorted(starts, (at, at + len(slots)), side="right")
        low = max(0, low - 1)
        borders = np.clip(starts[low : high + 1] - at, 0, len(slots))
        own = slice(low, low + len(borders) - 1)
        number[own] += sums(counts, borders)
        total[own] += sums(model.weights[slots] * counts[:, None], borders)
    return total / np.maximum(number, 1)[:, None] * np.minimum(number, EVIDENCE)[:, None]


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the chosen language's index, its probability, and whether the choice is ambiguous."""
    agree = margins[:, None, :] * model.codes[None]
    # Each classifier's loss weighs as much as it can tell apart: one share per bit.
    loss = np.logaddexp(0, -agree).sum(axis=2) * (2 / max(1, model.codes.shape[1]))
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
    chance /= chance.sum(axis=1, keepdims=True)
    every = np.arange(len(loss))
    close = loss[every, order[:, 1]] - loss[every, best] < MARGIN if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, chance[every, best], close


def sample(docs: DataFrame, languages: int = SAMPLE) -> list[tuple[str, str]]:
    """The bounded training sample of different texts, chosen by a hash of the text: (language, text)."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    usable = usable.where(F.length("text").between(1, LONGEST)).select("doc_id", "lang", F.xxhash64("text").alias("_draw"), "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))
    # Copies of a text share its hash and count as one.
    texts = usable.groupBy("lang", "_draw").agg(F.min("doc_id").alias("doc_id"))
    chosen = texts.withColumn("_turn", turn).where(F.col("_turn") <= languages)
    # Bounded: SAMPLE rows of three values per language.
    chosen = F.broadcast(chosen.select("doc_id", "lang", "_draw"))
    found = usable.join(chosen, ["doc_id", "lang", "_draw"], "left_semi").select("lang", "text").distinct()
    return sorted((r[0], r[1]) for r in found.collect())


def _judge(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity per text."""
    if model.languages:
        best, chance, close = decode(model, evidence(model, texts))
    else:
        best, chance, close = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
    worded = np.array([bool(model.languages) and _LETTER.search(t) is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    named = [model.languages[b] if w else UNDECIDED for b, w in zip(best, worded, strict=True)]
    return named, np.where(worded, chance, 0.0), close | ~worded


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every text in one pass; only the text is looked at.

    A text that is null or has no letter is ``und`` with score 0. Without a learned language, so is every text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(column: pa.Array) -> dict[str, pa.Array]:
        named, chance, close = _judge(shared.value, column.to_pylist())
        return {"lang_pred": pa.array(named, pa.string()), "score": pa.array(chance), "ambiguous": pa.array(close)}

    return map_column(docs, rows, "lang_pred string, score double, ambiguous boolean")


def label(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of ``docs`` and identify all of it: (doc_id, held_out, lang_pred, score, ambiguous)."""
    found = identify(docs, train(sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, chance, _ = _judge(shared.value, [t or "" for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array(chance >= least))

    return docs.mapInArrow(run, docs.schema)
