"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a hash of the last 32 bytes says so; so equal texts have equal chunks. Each chunk is
known by a fingerprint of 128 bits, and a text by the list of its fingerprints, its recipe. The bytes of
every chunk move once, to the other chunks of their fingerprint, to prove that they are the same; copies
met by one task move once together. Where they are not, the fingerprint is replaced by a number per
content. From then on only recipes are compared, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import SPACE, flat_bytes, small_batches, store

#: Bytes of a chunk: at least, at most, and on average about 2 ** CUT_BITS more than at least.
SMALLEST, LARGEST, CUT_BITS = 512, 16_384, 11
WINDOW = 32
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def chunk_ends(raw: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end; they depend on the text alone."""
    mark = _GEAR[raw]
    width = 1
    while width < WINDOW:  # each step doubles the bytes that a position's hash covers
        longer = mark.copy()
        longer[width:] += mark[:-width] << np.uint32(width)
        mark, width = longer, width * 2
    marks = np.flatnonzero(mark >> np.uint32(32 - CUT_BITS) == 0) + 1
    first = np.searchsorted(marks, starts, side="right")
    found = []
    for k in range(len(starts) - 1):
        at, end, ends = int(starts[k]), int(starts[k + 1]), []
        # No cut lies in the first SMALLEST bytes, where the window may still cover the text before.
        for cut in [*marks[first[k] : first[k + 1]].tolist(), end]:
            while cut - at > LARGEST:
                at += LARGEST
                ends.append(at)
            if cut - at >= SMALLEST or cut == end and cut > at:
                ends.append(cut)
                at = cut
        found.append(ends)
    return found


def _fingerprint(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def recipes(texts: DataFrame, size: int = 16) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, recipe) per row of (doc_id, text_sha256, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = flat_bytes(batch.column("text"))
            view, made = memoryview(raw), []
            for k, ends in enumerate(chunk_ends(raw, starts)):
                at, parts = int(starts[k]), []
                for end in ends:
                    parts.append(_fingerprint(view[at:end], size))
                    at = end
                made.append(b"".join(parts))
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in ("doc_id", "text_sha256")} | {"n_bytes": pa.array(np.diff(starts)), "recipe": pa.array(made, pa.binary())}
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, text_sha256 string, n_bytes long, recipe binary")


def chunks(texts: DataFrame, size: int = 16, with_place: bool = False) -> DataFrame:
    """(fingerprint, content) of the chunks, those that a batch repeats once; with_place: all, with doc_id, text_sha256 and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = flat_bytes(batch.column("text"))
            view, seen = memoryview(raw), set()
            prints, contents, rows, places = [], [], [], []
            for k, ends in enumerate(chunk_ends(raw, starts)):
                at = int(starts[k])
                for place, end in enumerate(ends):
                    content, at = bytes(view[at:end]), end
                    if with_place or content not in seen:
                        seen.add(content)
                        prints.append(_fingerprint(content, size))
                        contents.append(content)
                        rows.append(k)
                        places.append(place)
            made = {"fingerprint": pa.array(prints, pa.binary()), "content": pa.array(contents, pa.binary())}
            if with_place:
                made |= {n: batch.column(n).take(pa.array(rows, pa.int64())) for n in ("doc_id", "text_sha256")}
                made["place"] = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_pydict(made)

    kind = texts.schema["doc_id"].dataType.simpleString()
    more = f", doc_id {kind}, text_sha256 string, place long" * with_place
    return texts.mapInArrow(run, "fingerprint binary, content binary" + more)


def mistaken(texts: DataFrame, size: int) -> DataFrame:
    """Fingerprints that stand for more than one content."""
    found = chunks(texts, size).groupBy("fingerprint").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    return found.where(F.col("least") != F.col("most")).select("fingerprint")


def _numbered(texts: DataFrame, wrong: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_sha256, numbers): for the chunks of a mistaken fingerprint, the number of their content."""
    places = chunks(texts, size, with_place=True).join(wrong, "fingerprint", "left_semi")
    contents = places.select("fingerprint", "content").distinct()
    number = F.row_number().over(Window.partitionBy("fingerprint").orderBy("content"))
    known = contents.withColumn("number", number)
    numbered = places.join(known, ["fingerprint", "content"]).select("doc_id", "text_sha256", "place", "number").distinct()
    return numbered.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("place", "number"))).alias("numbers"))


def exact_groups(docs: DataFrame, size: int = 16) -> DataFrame:
    """Equal texts: (doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks), one row per row of ``docs``.

    Texts are equal when they are the same with each run of ASCII white space as one space; null counts as
    empty, and empty texts are equal. ``keep_id`` is the smallest doc_id of the group (null only if all its
    ids are), ``kept`` marks that row; of rows that repeat an id and a text, one is kept. ``size`` is the
    number of bytes of a fingerprint; a short one costs time, not right results.
    """
    small_batches(docs.sparkSession)
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    text = text.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), "text")
    rows = store(recipes(text, size), "recipes")
    wrong = store(mistaken(text, size), "mistaken")
    key = ["n_bytes", "recipe"]
    if not wrong.isEmpty():
        rows = rows.join(
            _numbered(text, wrong, size).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_sha256", "_sha"),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")),
            "left",
        ).drop("_id", "_sha")
        rows = rows.withColumn("numbers", F.coalesce(F.to_json("numbers"), F.lit("")))
        key = [*key, "numbers"]
    groups = rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = Window.partitionBy("doc_id", "text_sha256").orderBy("n_bytes")
    once = rows.withColumn("_turn", F.row_number().over(again))
    return once.join(groups, key).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_turn") == 1)).alias("kept"),
        "text_sha256",
        "n_bytes",
        F.expr(f"cast(length(recipe) / {size} as bigint)").alias("n_chunks"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    marked = docs.withColumn("_text_sha", F.sha2(normalised(F.col("text")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_text_sha") == F.col("_kept_sha"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_sha"]).select(*docs.columns)
