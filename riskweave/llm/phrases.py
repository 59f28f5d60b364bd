"""Phrases whose words stand together more often than their parts suggest.

The first passes find what may be frequent: phrases are hashed, each hash partition has a Misra-Gries summary whose
counters exceed its mass divided by the threshold, and the summaries of all tasks are merged, so every frequent
phrase survives. Words and pairs come first; longer phrases are summarised where all their pairs survived, because a
phrase is never more frequent than its parts. The last pass counts the survivors exactly, by their words; a task
adds up what it counts, so it hands on a row for each phrase it meets and not for each batch with that phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import small_batches, store
from riskweave.llm.frequent import ROWS, SCHEMA, Filter, filter_of, frequent, local_rows, part_of
from riskweave.llm.word_bytes import byte_kinds, words_of

LONGEST, THRESHOLD, FIRST = 5, 100, 2000
#: Counters of a summary, as a multiple of the least that keeps all that is frequent: counts then miss a small part of the threshold.
SPARE = 16
#: Bytes of text for each hash partition, and bounds of their number.
PART_BYTES, FEWEST_PARTS, MOST_PARTS = 64 << 20, 16, 1 << 16
#: Bytes of counts that a task of the last pass holds, and of text that it reads: each hands on every phrase it meets.
HELD_BYTES, TASK_BYTES = 64 << 20, 128 << 20
#: Lots that the phrases of a language are ranked in first.
LOTS = 64
UNDECIDED = "und"

#: The signs between words, and those that no phrase reaches across.
KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15))


class Grams:
    """The words of a batch as numbers, and its phrases of each length as hashes."""

    def __init__(self, batch: pa.RecordBatch):
        found = words_of(batch.column("text"), KINDS)
        words = found.words.dictionary_encode()
        self.dictionary, self.codes = words.dictionary, words.indices.to_numpy()
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[found.row]
        self.piece = found.piece
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in self.dictionary.to_pylist()], dtype=np.uint64)
        self.hashes = hashed[self.codes]
        # Hashed another way than words, as some languages are named like words of others.
        self.seeds = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in self.langs.to_pylist()], dtype=np.uint64)

    def of_lengths(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, where the phrases of this length start, and their hashes."""
        if not len(self.codes):
            return
        rolled = self.seeds[self.lang]
        for length in range(1, longest + 1):
            many = len(self.codes) - length + 1
            if many < 1:
                return
            rolled = (rolled[:many] + self.hashes[length - 1 :]) * _MIX[0]
            rolled ^= rolled >> np.uint64(29)
            rolled *= _MIX[1]
            rolled ^= rolled >> np.uint64(32)
            starts = np.flatnonzero(self.piece[:many] == self.piece[length - 1 :])
            yield length, starts, rolled[starts]

    def linked(self, longest: int, pairs: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phrases of three words or more whose pairs all pass ``pairs``."""
        follows = np.zeros(0, dtype=bool)  # whether the pair that starts at a word passes
        for length, starts, hashes in self.of_lengths(longest):
            if length == 2:
                follows = np.zeros(len(self.codes), dtype=bool)
                follows[starts[pairs(hashes)]] = True
            elif length > 2:
                whole = follows[starts]
                for step in range(1, length - 1):
                    whole &= follows[starts + step]
                yield length, starts[whole], hashes[whole]

    def counted(self, length: int, starts: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, words, n) of the phrases that start at ``starts``; phrases of one hash are told apart by their words."""
        order = np.argsort(hashes)
        starts, hashes = starts[order], hashes[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(starts) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = starts[new]
        same = self.lang[starts] == self.lang[first[group]]
        for step in range(length):
            same &= self.codes[starts + step] == self.codes[first[group] + step]
        if not same.all():  # a hash that two phrases share
            rows = np.column_stack([self.lang[starts], *(self.codes[starts + s] for s in range(length))])
            _, at, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            first = starts[at]
        parts = [self.dictionary.take(pa.array(self.codes[first + step])) for step in range(length)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", parts[0].type)) if length > 1 else parts[0]
        return pa.RecordBatch.from_pydict(
            {
                "lang": self.langs.take(pa.array(self.lang[first])).cast(pa.string()),
                "phrase": phrase.cast(pa.binary()).cast(pa.string()),
                "words": pa.array(np.full(len(first), length, np.int32)),
                "n": pa.array(np.bincount(group, minlength=len(first)).astype(np.int64)),
            }
        )


def added_up(counts: Iterable[pa.RecordBatch], most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) with the rows of one phrase added up; handed on when more than half of ``most`` bytes differ."""
    held: list[pa.RecordBatch] = []
    size = 0

    def total() -> list[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns({"n_sum": "n"}).to_batches(max_chunksize=ROWS)

    for some in counts:
        held.append(some)
        size += some.nbytes
        if size >= most:
            held = total()
            size = sum(x.nbytes for x in held)
            if size > most // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from total()


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit(UNDECIDED)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    return (Grams(batch) for batch in batches if batch.num_rows)


def _weigh(texts: DataFrame, parts: int, longest: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Words of each language, and the mass of each hash partition: of words and pairs, and of longer phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        mass = np.zeros((2, parts), dtype=np.int64)
        for grams in _each(batches):
            for lang, n in zip(grams.langs.to_pylist(), np.bincount(grams.lang, minlength=len(grams.langs)), strict=True):
                words[lang] += int(n)
            for length, _, hashes in grams.of_lengths(longest):
                mass[int(length > 2)] += np.bincount(part_of(hashes, parts), minlength=parts)
        kind, part = np.nonzero(mass)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([*words, *[None] * len(kind)], pa.string()),
                "kind": pa.array([*[None] * len(words), *kind.tolist()], pa.int32()),
                "part": pa.array([*[None] * len(words), *part.tolist()], pa.int32()),
                "n": pa.array([*words.values(), *mass[kind, part].tolist()], pa.int64()),
            }
        )

    sums = store(texts.mapInArrow(run, "lang string, kind int, part int, n long").groupBy("lang", "kind", "part").agg(F.sum("n").alias("n")), "mass")
    mass = np.zeros((2, parts), dtype=np.int64)
    for kind, part, n in sums.where(F.col("kind").isNotNull()).select("kind", "part", "n").collect():
        mass[kind, part] = n
    return sums.where(F.col("lang").isNotNull()).select("lang", "n"), list(mass)


def _survivors(texts: DataFrame, mass: np.ndarray, threshold: int, longest: int, pairs: Filter | None) -> Filter:
    """A filter that every frequent phrase passes: words and pairs, or those longer phrases whose ``pairs`` pass."""
    capacities = SPARE * (mass // threshold + 1)
    shared = texts.sparkSession.sparkContext.broadcast(pairs) if pairs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (g.linked(longest, shared.value) if shared else g.of_lengths(min(2, longest)) for g in _each(batches))
        yield from local_rows((hashes for some in found for _, _, hashes in some), capacities)

    return filter_of(store(frequent(texts.mapInArrow(run, SCHEMA), capacities, threshold), "survivors"))


def _occurrences(texts: DataFrame, pairs: Filter, longer: Filter, longest: int, tasks: int) -> DataFrame:
    """(lang, phrase, words, n) of the phrases that pass the filters: what each of ``tasks`` tasks, at most, has counted."""
    filters = texts.sparkSession.sparkContext.broadcast((pairs, longer))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _each(batches):
            short, long = filters.value
            found = [(k, s[p], h[p]) for k, s, h in grams.of_lengths(min(2, longest)) for p in [short(h)]]
            found += [(k, s[p], h[p]) for k, s, h in grams.linked(longest, short) for p in [long(h)]]
            for length, starts, hashes in found:
                if len(starts):
                    yield grams.counted(length, starts, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added_up(counts(batches))

    return texts.coalesce(tasks).mapInArrow(run, "lang string, phrase string, words int, n long")


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of up to ``longest`` words that occurs ``threshold`` times in its language; (lang, n).

    A null lang is ``und``, a null text empty. Texts are read four times; none is shuffled.
    """
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(FEWEST_PARTS, min(MOST_PARTS, 1 << (size // part_bytes).bit_length()))
    words, (few, many) = _weigh(texts, parts, longest)
    pairs = _survivors(texts, few, threshold, longest, None)
    longer = _survivors(texts, many, threshold, longest, pairs)
    # Two tasks a core at least, so that cores are done at about one time.
    tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    counts = _occurrences(texts, pairs, longer, longest, tasks).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return store(counts.where(F.col("f") >= threshold), "phrases"), words


def _run(phrase: Column, first: Column | int, many: Column | int) -> Column:
    """``many`` words of a phrase from word ``first`` on (from 1)."""
    return F.array_join(F.slice(phrase, first, many), " ")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, first: int = FIRST, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language.

    A phrase of 2 to ``longest`` words that occurs ``threshold`` times has the score 1000 * a * n / (l * r), rounded
    down, of the cut where that is least. A phrase that occurs only within longer ones is left out. Products
    are decimals of 38 digits; beyond them, which no table reaches, the query fails instead of rounding.
    """
    counts, words = phrase_counts(docs, threshold, longest, part_bytes)
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    long = counts.where(F.col("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("_words"))
    # Within: every row of words inside a longer phrase, with the most that such a phrase has.
    spans = F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _run(F.col("_words"), at, size)),
    )
    inner = long.where(F.col("words") > 2).select("lang", F.explode(F.flatten(spans)).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    alone = long.join(most, ["lang", "phrase"], "left").where(F.coalesce(F.col("_most"), F.lit(0)) < F.col("a")).drop("_most")
    cuts = alone.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns(
        {"_left": _run(F.col("_words"), 1, F.col("_cut")), "_right": _run(F.col("_words"), F.col("_cut") + 1, F.col("words") - F.col("_cut"))}
    )
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    # The number of words is one row per language.
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(words, "lang")
    product = F.lit(1000).cast("decimal(4,0)") * whole("a") * F.col("n").cast("decimal(14,0)")
    scored = scored.withColumns({"_over": product.cast("decimal(38,0)"), "_under": (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("_over div _under"))
    cut = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "_cut")).alias("_best")
    best = scored.groupBy("lang", "phrase", "a").agg(cut).select("lang", "phrase", "a", "_best.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of each lot, so that no task ranks all phrases of a language.
    lot = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(LOTS))).orderBy(*order)
    some = best.withColumn("_place", F.row_number().over(lot)).where(F.col("_place") <= first).drop("_place")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
