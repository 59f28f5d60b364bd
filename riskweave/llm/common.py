"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import working_dir

#: Records and bytes that one Arrow batch brings to a Python worker. A longer text comes as a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: ASCII white space: the separator of words in every operator here.
SPACE = r"[\x20\x09-\x0D]"
#: Latin letters up to U+024F, for character classes.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by records and bytes, and let its Python workers find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_HOME)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; this cuts its lineage."""
    path = working_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def map_texts(
    docs: DataFrame, rows: Callable[[list[str]], dict[str, pa.Array]], schema: str, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Apply ``rows`` to the texts of each batch; a null text comes as an empty one.

    ``schema`` describes the columns that ``rows`` adds to those of ``keep``.
    """
    return map_column(docs, lambda texts: rows(texts.to_pylist()), schema, keep)


def map_column(
    docs: DataFrame, rows: Callable[[pa.Array], dict[str, pa.Array]], schema: str, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The same with the texts as one Arrow array."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = [f.name for f in kept.schema.fields if f.name != "text"]
    full = ", ".join([*(f"`{n}` {kept.schema[n].dataType.simpleString()}" for n in names), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | rows(batch.column("text")))

    return kept.mapInArrow(run, full)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts in one row, and where each text starts and the last one ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts`` (the last one is the end); 0 where nothing lies between."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]
