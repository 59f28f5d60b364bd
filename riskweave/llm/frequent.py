"""Summaries of what is frequent, after Misra and Gries, and filters of what they keep.

A summary counts numbers (hashes) with a bounded number of counters. When there are more, the largest count that
has no counter of its own is taken off all of them. Each number then misses at most what was taken off, which is
no more than mass / (counters + 1); summaries merge by adding up, and so do their errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds before it hands them on.
HELD = 1 << 21
ROWS = 1 << 16
SCHEMA = "part int, gram long, n long"
#: Bits of a filter: for each number, at least and at most. The largest filter takes 32 MB.
BITS, FEWEST, MOST, PROBES = 16, 1 << 18, 1 << 28, 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def part_of(numbers: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition of each number, from its highest bits; ``parts`` is a power of two."""
    return (numbers >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(numbers), np.int64)


def added(numbers: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and their counts."""
    if counts is None:
        return np.unique(numbers, return_counts=True)
    order = np.argsort(numbers, kind="stable")
    numbers, counts = numbers[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else np.zeros(0, np.int64)
    return numbers[new], np.add.reduceat(counts, new) if len(new) else counts


class Summary:
    """Counters of one hash partition; ``error`` is what a count may miss."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.numbers, self.counts, self.error = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, numbers: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Take up counts of distinct numbers, or another summary with its error."""
        self.waiting.append((numbers, counts))
        self.size += len(numbers)
        self.error += error
        if self.size > max(self.capacity, ROWS):
            self.settle()

    def settle(self) -> None:
        """Add up what waits, and take off what has no counter."""
        numbers, counts = (np.concatenate(x) for x in zip((self.numbers, self.counts), *self.waiting, strict=True))
        numbers, counts = added(numbers, counts)
        self.waiting, self.size = [], 0
        if len(counts) > self.capacity:
            off = int(np.partition(counts, -self.capacity - 1)[-self.capacity - 1])
            kept = counts > off
            numbers, counts = numbers[kept], counts[kept] - off
            self.error += off
        self.numbers, self.counts = numbers, counts


def rows_of(part: int, summary: Summary) -> Iterator[pa.RecordBatch]:
    """A summary as rows; its error is the count of no number."""
    summary.settle()
    yield _batch(np.full(1, part), np.zeros(1, np.uint64), np.array([summary.error]), np.array([True]))
    for at in range(0, len(summary.numbers), ROWS):
        some = summary.numbers[at : at + ROWS]
        yield _batch(np.full(len(some), part), some, summary.counts[at : at + ROWS])


def _batch(parts: np.ndarray, numbers: np.ndarray, counts: np.ndarray, none: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(parts.astype(np.int32)), "gram": pa.array(numbers.view(np.int64), mask=none), "n": pa.array(counts.astype(np.int64))}
    )


def local_rows(numbers: Iterator[np.ndarray], capacities: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Summaries of the numbers of a task, handed on whenever it holds too many; each partition has its capacity."""
    parts = len(capacities)

    def hand_on(held: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        borders = np.searchsorted(part_of(held[0], parts), np.arange(parts + 1))
        small: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
            if b - a > capacities[part]:
                summary = Summary(int(capacities[part]))
                summary.add(held[0][a:b], held[1][a:b])
                yield from rows_of(part, summary)
            elif b > a:  # no error, so no row for it
                small.append((np.full(b - a, part), held[0][a:b], held[1][a:b]))
        if small:
            some = [np.concatenate(x) for x in zip(*small, strict=True)]
            for at in range(0, len(some[0]), ROWS):
                yield _batch(*(x[at : at + ROWS] for x in some))

    held, waiting, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
    for some in numbers:
        waiting.append(added(some))
        size += len(waiting[-1][0])
        if size >= HELD:
            held = added(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))
            waiting, size = [], 0
            if len(held[0]) >= HELD:
                yield from hand_on(held)
                held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    yield from hand_on(added(*(np.concatenate(x) for x in zip(held, *waiting, strict=True))))


def frequent(summaries: DataFrame, capacities: np.ndarray, threshold: int) -> DataFrame:
    """(gram): every number that occurs ``threshold`` times or more, and some others, from rows of local summaries.

    Each hash partition is merged by one task, which holds no more than twice its capacity at a time.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, Summary] = {}
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            none = batch.column("gram").is_null().to_numpy(zero_copy_only=False)
            numbers = batch.column("gram").fill_null(0).to_numpy().view(np.uint64)
            for p in np.unique(part):
                summary = merged.setdefault(int(p), Summary(int(capacities[p])))
                mine = part == p
                summary.add(numbers[mine & ~none], n[mine & ~none], int(n[mine & none].sum()))
        for summary in merged.values():
            summary.settle()
            kept = summary.numbers[summary.counts + summary.error >= threshold]
            for at in range(0, len(kept), ROWS):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(kept[at : at + ROWS].view(np.int64))})

    return summaries.repartitionById(len(capacities), "part").mapInArrow(merge, "gram long")


class Filter:
    """Whether a number may be in a set: never wrong for one that is."""

    def __init__(self, bits: int, buckets: list[tuple[int, bytes]]):
        self.bits = bits
        self.held = np.zeros(bits // 8, dtype=np.uint8)
        for bucket, bitmap in buckets:  # buckets count from 1
            at = (bucket - 1) * 4096
            some = np.frombuffer(bitmap, np.uint8)[: len(self.held) - at]
            self.held[at : at + len(some)] = some

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        found = np.ones(len(numbers), dtype=bool)
        for odd in _ODD[:PROBES]:
            place = (numbers * odd) >> np.uint64(64 - self.bits.bit_length() + 1)
            found &= (self.held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(grams: DataFrame) -> Filter:
    """A filter of the numbers in ``grams`` (gram); its size grows with them up to a bound, beyond which it lets more pass."""
    bits = 1 << max(FEWEST.bit_length() - 1, min(MOST.bit_length() - 1, (grams.count() * BITS).bit_length()))
    shift = 64 - bits.bit_length() + 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("gram").to_numpy().view(np.uint64)
            for odd in _ODD[:PROBES]:
                yield pa.RecordBatch.from_pydict({"place": pa.array(((numbers * odd) >> np.uint64(shift)).astype(np.int64))})

    placed = grams.mapInArrow(places, "place long")
    # Buckets of 32,768 bits: what is collected is bounded by the bits.
    bucket = F.floor(F.col("place") / 32768).alias("bucket")
    maps = placed.groupBy(bucket).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bitmap"))
    return Filter(bits, [(r[0] + 1, bytes(r[1])) for r in maps.collect()])
