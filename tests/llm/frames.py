"""Small documents with everything that tables can hold."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("score", "size", "node", "copies", "kept", "blob", "component", "signature", "place", "_key", "_turn", "_id")

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 10),
    (2, None, "en", "a", 0),
    (3, "", "en", None, 0),
    (4, "   \n\t ", None, "b", 5),
    (5, "The quick  brown fox\njumps over the lazy dog near the old river bank today", "en", "b", 10),
    (5, "The quick  brown fox\njumps over the lazy dog near the old river bank today", "en", "b", 10),
    (6, "12345 67890 !!! ???", "de", "b", 10),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG + " end", "en", "c", len(LONG)),
    (9, "x" * 200_000, None, "c", 200_000),
    (10, "naïve café – 中文 😀 \x00 end", "fr", "c", 20),
    (11, None, None, None, None),
    (None, "a row without an id and with a few words", "en", "a", 3),
    (None, None, None, None, None),
]


def documents(spark: SparkSession, rows: list[tuple] | None = None, clashing: bool = False) -> DataFrame:
    from pyspark.sql import functions as F

    made = spark.createDataFrame(EDGES if rows is None else rows, SCHEMA)
    return made.withColumns({c: F.lit("other") for c in CLASHING}) if clashing else made


def table(spark: SparkSession, size: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(DATA, size, f"{name}.parquet"))
