"""Ranked lexical search by Block-Max MaxScore over shards of documents.

A shard holds, for each term that is asked for, its postings in blocks: numbers of documents and counts, packed
in as few bytes as the block needs, with the last document and the largest impact of each block beside them.
A search orders the lists of an item by their bounds. Lists whose bounds together stay below the score of
the k-th best are not essential: their documents are looked up only where the essential lists have found
something, and a block is unpacked only if its maximum can still lift a candidate to the k-th best. The best of
each task carry over from shard to shard, and are merged over all tasks at the end.

All scores are whole numbers, so every order of additions gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import small_batches, store
from riskweave.llm.word_bytes import byte_kinds, words_of

#: Postings of a block, documents that are scored at a time, and bytes of text of a shard.
BLOCK, SPAN, SHARD_BYTES = 128, 2048, 32 << 20
#: Documents of a shard at most, and bytes of terms that one block of items holds on average.
MOST_DOCS, ITEM_BYTES = 1 << 17, 4 << 20
BEST = 10

#: The signs between terms, and the numbers of the score.
BETWEEN = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
KINDS = byte_kinds(BETWEEN)
LENGTH_SHARE, SCALE, STEP, SMOOTH = 90, 1_000_000_000, 1000, 8

LIST = "struct<term: binary, lasts: array<int>, maxima: array<bigint>, starts: array<int>, data: binary>"
INDEX = f"doc_ids array<bigint>, norms array<bigint>, lists array<{LIST}>"


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and documents that hold each term that is asked for."""

    documents: int
    words: int
    holding: dict[bytes, int]

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding.get(term, 0) + 1)))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """What the length of a document adds below the line of its score."""
        rate = LENGTH_SHARE * self.documents
        if int(lengths.max(initial=0)) * rate >= 1 << 63:
            return np.array([100 - LENGTH_SHARE + rate * int(n) // self.words for n in lengths], dtype=np.int64)
        return 100 - LENGTH_SHARE + lengths * rate // max(1, self.words)


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    counts = counts.astype(np.int64)
    return SCALE * counts // (STEP * counts + SMOOTH * norms)


def terms_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with the distinct terms of ``column``, as bytes in order, in place of it."""
    small_batches(texts.sparkSession)
    kept = texts.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = words_of(batch.column(column), KINDS)
                terms: list[set[bytes]] = [set() for _ in range(batch.num_rows)]
                for row, word in zip(found.row, found.words.to_pylist(), strict=True):
                    terms[row].add(word)
                kept = {n: batch.column(n) for n in batch.schema.names if n != column}
                yield pa.RecordBatch.from_pydict(kept | {"terms": pa.array([sorted(t) for t in terms], pa.list_(pa.binary()))})

    return kept.mapInArrow(run, ", ".join([*others, "terms array<binary>"]))


def _held(texts: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms per text; and row, term and count of each pair of a text and a term that is asked for."""
    found = words_of(texts, KINDS)
    lengths = np.bincount(found.row, minlength=len(texts)).astype(np.int64)
    term = pc.fill_null(pc.index_in(found.words, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = term >= 0
    pairs, counts = np.unique(found.row[known] * max(1, len(asked)) + term[known], return_counts=True)
    return lengths, pairs // max(1, len(asked)), pairs % max(1, len(asked)), counts


def statistics(docs: DataFrame, asked: list[bytes]) -> Statistics:
    """Counted over all documents; what reaches the driver are two sums and one for each term that is asked for."""
    small_batches(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(pa.array(asked, pa.large_binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = words = 0
        holding = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                lengths, _, term, _ = _held(batch.column("text"), wanted.value)
                documents, words = documents + int((lengths > 0).sum()), words + int(lengths.sum())
                holding += np.bincount(term, minlength=len(holding))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_pydict(
            {"what": pa.array([-2, -1, *some.tolist()], pa.int32()), "n": pa.array([documents, words, *holding[some].tolist()], pa.int64())}
        )

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sums = {r[0]: r[1] for r in texts.mapInArrow(run, "what int, n long").groupBy("what").agg(F.sum("n")).collect()}
    return Statistics(sums.pop(-2, 0), sums.pop(-1, 0), {asked[t]: n for t, n in sums.items()})


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same values in as few bytes as the largest one needs."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def pack(docs: np.ndarray, counts: np.ndarray, norms: np.ndarray) -> dict[str, object]:
    """The postings of one term in blocks; ``docs`` ascends."""
    lasts, maxima, starts, data = [], [], [], bytearray()
    worth = impacts(counts, norms[docs])
    before = -1
    for at in range(0, len(docs), BLOCK):
        part, number = docs[at : at + BLOCK], counts[at : at + BLOCK]
        gaps, many = _narrow(np.diff(part, prepend=before)), _narrow(number)
        starts.append(len(data))
        data += bytes([gaps.itemsize, many.itemsize]) + gaps.tobytes() + many.tobytes()
        before = int(part[-1])
        lasts.append(before)
        maxima.append(int(worth[at : at + BLOCK].max()))
    return {"lasts": lasts, "maxima": maxima, "starts": starts, "data": bytes(data)}


def build_index(docs: DataFrame, asked: list[bytes], stats: Statistics) -> DataFrame:
    """Shards of documents, a row each, with the lists of the terms in ``asked``.

    A shard holds consecutive rows of a partition, about ``SHARD_BYTES`` of text, so documents aren't shuffled.
    """
    small_batches(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(pa.array(asked, pa.large_binary()))

    def shard(parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.concatenate([p[1] for p in parts])
        norms = stats.norms(lengths)
        firsts = np.cumsum([0, *(len(p[1]) for p in parts)])
        rows = np.concatenate([p[2] + f for p, f in zip(parts, firsts, strict=False)])
        terms, counts = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
        order = np.lexsort((rows, terms))
        rows, terms, counts = rows[order], terms[order], counts[order]
        named, at = np.unique(terms, return_index=True)
        lists = [
            {"term": asked[t]} | pack(rows[a:b], counts[a:b], norms) for t, a, b in zip(named, at, np.append(at, len(terms))[1:], strict=True)
        ]
        kind = pa.list_(
            pa.struct(
                [("term", pa.binary()), ("lasts", pa.list_(pa.int32())), ("maxima", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("data", pa.binary())]
            )
        )
        ids = pa.concat_arrays([p[0] for p in parts])
        return pa.RecordBatch.from_pydict(
            {"doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "norms": pa.array([norms], pa.list_(pa.int64())), "lists": pa.array([lists], kind)}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, many = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append((batch.column("doc_id"), *_held(batch.column("text"), wanted.value)))
            size, many = size + batch.column("text").nbytes, many + batch.num_rows
            if size >= SHARD_BYTES or many >= MOST_DOCS:
                yield shard(parts)
                parts, size, many = [], 0, 0
        if parts:
            yield shard(parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, INDEX)


@dataclass
class Postings:
    """One list of a shard; blocks are unpacked when they are needed and stay until the shard is done."""

    lasts: np.ndarray
    maxima: np.ndarray
    starts: np.ndarray
    data: bytes
    norms: np.ndarray
    unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        known = self.unpacked.get(number)
        if known is None:
            at = int(self.starts[number])
            end = int(self.starts[number + 1]) if number + 1 < len(self.starts) else len(self.data)
            wide, high = self.data[at], self.data[at + 1]
            many = (end - at - 2) // (wide + high)
            gaps = np.frombuffer(self.data, f"<u{wide}", many, at + 2)
            counts = np.frombuffer(self.data, f"<u{high}", many, at + 2 + many * wide)
            docs = np.cumsum(gaps, dtype=np.int64) + (int(self.lasts[number - 1]) if number else -1)
            known = self.unpacked[number] = docs, impacts(counts, self.norms[docs])
        return known

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to below ``high``, and their impacts."""
        first, last = np.searchsorted(self.lasts, (low, high))
        blocks = [self.block(b) for b in range(int(first), min(int(last) + 1, len(self.lasts)))]
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, worth = (np.concatenate(x) for x in zip(*blocks, strict=True))
        a, b = np.searchsorted(docs, (low, high))
        return docs[a:b], worth[a:b]


class Best:
    """The ``k`` best (score, doc_id) of an item so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.found: list[tuple[int, bool, int]] = []

    @property
    def floor(self) -> int:
        """A document below this score can't be among the best any more; 1 while there is room."""
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        new = [(-int(s), i is None, i or 0) for s, i in zip(scores, ids, strict=True)]
        self.found = sorted(self.found + new)[: self.k]


def search_shard(lists: list[tuple[int, Postings]], doc_ids: list[int | None], best: Best, seen: dict[str, int]) -> None:
    """Offer to ``best`` all documents of a shard that can be among them; ``lists`` holds (weight, postings) of an item's terms.

    ``seen`` counts the blocks that were ruled out by their maximum.
    """
    bounds = np.array([w * int(p.maxima.max()) for w, p in lists], dtype=np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, below = [lists[i] for i in order], np.concatenate(([0], np.cumsum(bounds[order])))
    for low in range(0, len(doc_ids), SPAN):
        floor, high = best.floor, min(low + SPAN, len(doc_ids))
        # The first lists whose bounds together don't reach the floor aren't essential.
        idle = int(np.searchsorted(below[1:], floor, side="left"))
        if idle == len(lists):
            return
        total, touched = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=bool)
        for weight, postings in lists[idle:]:
            docs, worth = postings.between(low, high)
            total[docs - low] += weight * worth
            touched[docs - low] = True
        docs = np.flatnonzero(touched & (total + below[idle] >= floor))
        scores, docs = total[docs], docs + low
        for at in range(idle - 1, -1, -1):
            if not len(docs):
                break
            weight, postings = lists[at]
            block = np.searchsorted(postings.lasts, docs)
            inside = block < len(postings.lasts)
            most = np.where(inside, weight * postings.maxima[np.minimum(block, len(postings.lasts) - 1)], 0)
            stay = scores + most + below[at] >= floor
            seen["ruled out"] += len(np.unique(block[inside])) - len(np.unique(block[inside & stay]))
            docs, scores, block, inside = docs[stay], scores[stay], block[stay], inside[stay]
            for number in np.unique(block[inside]):
                held, worth = postings.block(int(number))
                who = np.flatnonzero(block == number)
                place = np.minimum(np.searchsorted(held, docs[who]), len(held) - 1)
                scores[who] += np.where(held[place] == docs[who], weight * worth[place], 0)
            stay = scores + below[at] >= floor
            docs, scores = docs[stay], scores[stay]
        if len(docs) > best.k:  # no more than the best and those equal to the last of them
            least = np.partition(scores, -best.k)[-best.k]
            docs, scores = docs[scores >= least], scores[scores >= least]
        some = scores >= floor
        best.offer(scores[some], [doc_ids[d] for d in docs[some]])


def search(index: DataFrame, items: list[tuple[int, list[bytes]]], stats: Statistics, k: int = BEST) -> DataFrame:
    """(key, doc_id, score): the best of each task for each item (key, terms)."""
    small_batches(index.sparkSession)
    asked = [(key, [(stats.weight(t), t) for t in terms if stats.weight(t) > 0 and stats.holding.get(t)]) for key, terms in items]
    wanted = index.sparkSession.sparkContext.broadcast([a for a in asked if a[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].as_py()
                norms = batch.column("norms")[row].values.to_numpy()
                lists = {}
                for entry in batch.column("lists")[row]:
                    parts = [entry[c].values.to_numpy() for c in ("lasts", "maxima", "starts")]
                    lists[entry["term"].as_py()] = Postings(*parts, entry["data"].as_py(), norms)
                for key, terms in wanted.value:
                    held = [(w, lists[t]) for w, t in terms if t in lists]
                    if held:
                        search_shard(held, doc_ids, best.setdefault(key, Best(k)), {"ruled out": 0})
        rows = [(key, None if null else doc, -score) for key, b in best.items() for score, null, doc in b.found]
        keys, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(keys, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())}
        )

    return index.mapInArrow(run, "key long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items`` (item_id, text).

    Every row of ``docs`` is a document, also if ids repeat or are null (a null id comes after others of equal score). A
    text that is null or has no term is never found; an item without terms has no rows, and one whose id repeats
    is answered for each row. Items are worked off in blocks of about ``item_bytes`` of terms; each block reads
    the documents twice, once for the counts and once for the index, and only its own terms are collected.
    """
    spark = docs.sparkSession
    keyed = terms_of(items.select("item_id", "text").withColumn("key", F.monotonically_increasing_id()))
    asked = store(keyed.where(F.size("terms") > 0), "items")
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)
    total = asked.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.hash("key"), F.lit(blocks)) == block).select("key", "terms").collect()
        if not mine and (found is not None or block + 1 < blocks):
            continue
        wanted = [(r[0], [bytes(t) for t in r[1]]) for r in mine]
        terms = sorted({t for _, row in wanted for t in row})
        stats = statistics(docs, terms)
        index = store(build_index(docs, terms, stats), "index")
        part = search(index, wanted, stats, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # A row per item and place: both sides are small.
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
