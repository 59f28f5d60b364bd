"""Token ids in training order: fixed-stride shards for sequential reads that can resume anywhere.

Every document is cut into sequences of a fixed number of token ids. A keyed permutation orders them: a
Feistel network over the smallest even number of bits that holds all (document, sequence) numbers,
walked until it lands among them. Rows without an id of their own (null, repeated, or of ids spread too wide to be
numbered) are placed by a hash of id, text, copy and sequence instead, which spreads them as evenly. Each shard holds an equal range of permuted numbers, sorted; the slot of a
sequence is its place in that order over all shards. All records have one size, so slot and offset
follow from each other. The shards are written by Spark's text writer, one file each, so that a lost
executor leaves no half shard; a record ends with the writer's line end.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import small_batches, store
from riskweave.session import working_dir

#: Token ids of a sequence, and bytes of text that make up a shard on average.
LENGTH, SHARD_BYTES = 512, 16 << 20
#: A shard is read as one value, so it is never asked to be larger.
MOST_BYTES = 256 << 20
HEADER, ROUNDS = 16, 6
#: Signs of white space in a row that are encoded as one.
RUN = 500_000
#: Copies of one row that are written at a time, records of a batch, and places where some rows are placed by hashes.
COPIES, RECORDS, PLACES = 1000, 8192, 1 << 62
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Permutation:
    """A keyed one-to-one map of 0 .. size - 1 onto itself."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.half = np.uint64(max(1, math.ceil(max(1, (size - 1).bit_length()) / 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _network(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            mixed = (right + key) * _ODD[0]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[1]
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & self.mask)
        return (left << self.half) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        x = self._network(numbers.astype(np.uint64))
        while (outside := x >= np.uint64(self.size)).any():  # walk on: the network permutes a power of four
            x[outside] = self._network(x[outside])
        return x.astype(np.int64)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """Byte-level encoding of a file of ranks, once per Python process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(model, text: str, limit: int = RUN) -> np.ndarray:
    """Ids of ``text`` as 16-bit numbers.

    The encoder fails on longer rows of white space than ``limit``; they are cut after each ``limit`` signs, and what
    is left of a row stays with what follows it.
    """
    if len(text) <= limit:
        ids = model.encode_to_numpy(text, disallowed_special=())
    else:
        parts, at = [], 0
        for run in re.finditer(rf"\s{{{limit + 1},}}", text):
            parts.append(text[at : run.start() + limit])
            at = run.start() + limit
            while run.end() - at > limit:
                parts.append(text[at : at + limit])
                at += limit
        ids = np.concatenate([model.encode_to_numpy(p, disallowed_special=()) for p in [*parts, text[at:]]])
    if ids.max(initial=0) >= 1 << 16:
        raise ValueError("token ids beyond 65,535 don't fit the records")
    return ids


def _own_ids(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text, first, many) and whether there are rows without an id of their own.

    A row with an id of its own has no ``first``. Equal rows of others are one row for each ``COPIES`` of them, numbered from ``first`` on.
    """
    whole = rows.withColumns({"first": F.lit(None).cast("long"), "many": F.lit(1).cast("long")})
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    shared = store(counted.where((F.col("_rows") > 1) | F.col("doc_id").isNull()).select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return whole, False
    known = shared.where(F.col("doc_id").isNotNull())
    again = rows.join(known, "doc_id", "left_semi").select("doc_id", "text").unionByName(rows.where(F.col("doc_id").isNull()))
    alike = again.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("_rows"))
    parted = alike.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(COPIES).cast("long"))))
    parted = parted.select("doc_id", "text", "first", F.least(F.lit(COPIES).cast("long"), F.col("_rows") - F.col("first")).alias("many"))
    # What is left of the many copies of one row is dealt out.
    few, more = parted.where(F.col("first") == 0), parted.where(F.col("first") > 0).repartition("doc_id", "first")
    own = whole.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left_anti")
    return own.unionByName(few).unionByName(more), True


def sequences(rows: DataFrame, path: str, pattern: str, end: int, length: int, low: int, per_doc: int, size: int, hashed: bool, shards: int, key: int) -> DataFrame:
    """(shard, place, record): ids as 16-bit numbers behind doc_id, sequence and number of ids, padded with ``end``.

    ``rows`` are those of :func:`_own_ids`; all are placed by hashes if ``hashed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(size, key)
        width = -(-order.size // shards)

        def made(records: list[bytes], numbers: list[int]) -> pa.RecordBatch:
            place = order(np.array(numbers, dtype=np.int64))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array((place // width).astype(np.int32)), "place": pa.array(place), "record": pa.array(records, pa.binary())}
            )

        for batch in batches:
            model, records, numbers = encoding(path, pattern), [], []
            for doc_id, text, first, many in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "first", "many")), strict=True):
                ids = np.append(token_ids(model, text), end).astype("<u2")
                named = (doc_id if doc_id is not None else -1).to_bytes(8, "big", signed=True)
                own = []
                for seq, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    head = named + seq.to_bytes(4, "big") + len(part).to_bytes(4, "big")
                    own.append(head + part.tobytes() + np.full(length - len(part), end, "<u2").tobytes())
                if first is None and not hashed:
                    records += own
                    numbers += range((doc_id - low) * per_doc, (doc_id - low) * per_doc + len(own))
                    continue
                seed = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(named))
                for copy in range(first or 0, (first or 0) + many):
                    records += own
                    numbers += [xxhash.xxh64_intdigest(struct.pack(">qi", copy, seq), seed) % size for seq in range(len(own))]
                    if len(records) >= RECORDS:
                        yield made(records, numbers)
                        records, numbers = [], []
            yield made(records, numbers)

    return rows.mapInArrow(run, "shard int, place long, record binary")


def write_shards(docs: DataFrame, path: str, pattern: str, folder: str, end: int, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = 0) -> int:
    """Write all sequences of ``docs`` to ``folder``/shard=N, one file per shard; returns the number of shards.

    Token ids must be below 65,536, or writing fails. A null text counts as empty; an empty text is one sequence, of the end
    id. Rows with a null doc_id carry -1; they and rows that repeat an id are spread over all shards. Where two
    sequences have one place, the records themselves break the tie, so equal input gives equal shards. An id
    of -1 reads as null. Shards of more than ``MOST_BYTES`` are made smaller. Nothing is written of an empty table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    weight = F.greatest(size, F.lit(2 * length))  # the least that a record holds
    low, high, longest, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max(size), F.sum(weight)).first()
    low, span = low or 0, (high - low + 2) if low is not None else 1  # one more than there are, as orders have always been
    per_doc = (longest or 0) // length + 1  # a token has a byte at least, and one end id is added
    hashed = span * per_doc >= PLACES
    numbered, some = _own_ids(rows)
    places = PLACES if some or hashed else span * per_doc
    shards = max(1, -(-(total or 0) // min(shard_bytes, MOST_BYTES)))
    made = sequences(numbered, path, pattern, end, length, low, per_doc, places, hashed, shards, key)
    dealt = made.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "record")
    lines = dealt.select("shard", F.col("record").cast("string").alias("record"))
    lines.write.partitionBy("shard").option("lineSep", "\n").text(folder)
    return shards


def read_index(spark: SparkSession, folder: str, length: int = LENGTH) -> DataFrame:
    """What the shards hold: (slot, shard, offset, doc_id, sequence, n_tokens, ids_sha256) per record."""
    small_batches(spark)
    stride = HEADER + 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    if "shard" not in files.columns:  # no folder of a shard: the table was empty
        return spark.createDataFrame([], "slot long, shard int, offset long, doc_id long, sequence int, n_tokens int, ids_sha256 string")
    before = F.sum("records").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    firsts = files.select("shard", F.expr(f"length div {stride}").alias("records"))  # a row per shard
    firsts = firsts.select("shard", F.coalesce(before, F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                doc_id = raw[:, :8].copy().view(">i8").ravel().astype(np.int64)
                numbers = raw[:, 8:HEADER].copy().view(">i4").astype(np.int32)
                digests = [hashlib.sha256(row[HEADER : HEADER + 2 * n].tobytes()).hexdigest() for row, n in zip(raw, numbers[:, 1], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(np.full(len(raw), shard, np.int32)),
                        "place": pa.array(np.arange(len(raw))),
                        "offset": pa.array(np.arange(len(raw)) * stride),
                        "doc_id": pa.array(doc_id, mask=doc_id == -1),
                        "sequence": pa.array(numbers[:, 0]),
                        "n_tokens": pa.array(numbers[:, 1]),
                        "ids_sha256": pa.array(digests),
                    }
                )

    schema = "shard int, place long, offset long, doc_id long, sequence int, n_tokens int, ids_sha256 string"
    listed = files.select("shard", "content").mapInArrow(run, schema).join(F.broadcast(firsts), "shard")
    return listed.select((F.col("first") + F.col("place")).alias("slot"), "shard", "offset", "doc_id", "sequence", "n_tokens", "ids_sha256")


def read_from(spark: SparkSession, folder: str, shard: int, slot_in_shard: int, count: int, length: int = LENGTH) -> list[np.ndarray]:
    """Token ids of ``count`` records of a shard from one on, without what is before them."""
    stride = HEADER + 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shard={shard}")
    part = F.substring("content", F.lit(slot_in_shard * stride + 1), F.lit(count * stride))
    raw = files.select(part).first()[0]
    found = []
    for at in range(0, len(raw), stride):
        size = int.from_bytes(raw[at + 12 : at + 16], "big")
        found.append(np.frombuffer(raw, "<u2", size, at + HEADER))
    return found


def training_order(docs: DataFrame, path: str, pattern: str, end: int, **options) -> DataFrame:
    """Write the shards to the shared folder and return their index."""
    folder = working_dir(docs.sparkSession, "shards")
    write_shards(docs, path, pattern, folder, end, **options)
    return read_index(docs.sparkSession, folder, options.get("length", LENGTH))
