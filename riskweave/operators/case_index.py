"""Search of cases by posting lists of trigrams, so that a needle reads only the parts that can hold it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from riskweave.operators.cases import SEARCHED, search_cases

GRAM = 3
PART, SLOT = "part", "slot"


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters in lower case; none for shorter or missing text."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    cut = F.array_distinct(F.transform(starts, lambda at: F.substring(low, at, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, cut).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class CaseIndex:
    """Cases in ``rows`` by a hash of their id, and a row per trigram and case in ``grams`` by a hash of the trigram.

    ``parts`` and ``slots`` are the numbers of folders; a table's never change.
    """

    spark: SparkSession
    path: str
    schema: StructType
    parts: int = 64
    slots: int = 64

    def write(self, cases: DataFrame) -> None:
        """Store the cases and their posting lists, in place of what was there."""
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias(PART)
        rows = cases.select(*self.schema.fieldNames(), part)
        rows.repartition(PART, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(16))).write.mode("overwrite").partitionBy(
            PART
        ).parquet(f"{self.path}/rows")
        # From the stored rows, so that the cases are computed once.
        stored = self._rows()
        grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in SEARCHED])))
        postings = stored.select("id", PART, F.explode(grams).alias("gram")).withColumn(SLOT, self._slot(F.col("gram")))
        # Dealt by trigram and part, so that a trigram of many cases is written by many tasks; sorted, so that row groups
        # can be passed over.
        postings.repartition("gram", PART).sortWithinPartitions(SLOT, "gram").write.mode("overwrite").partitionBy(
            SLOT
        ).parquet(f"{self.path}/grams")

    def _slot(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.slots)).cast("int")

    def _rows(self) -> DataFrame:
        with_part = StructType([*self.schema.fields, StructField(PART, IntegerType())])
        return self.spark.read.schema(with_part).parquet(f"{self.path}/rows")

    def candidates(self, text: str) -> DataFrame:
        """``part`` and ``id`` of the cases that hold every trigram of ``text``, of which there must be one.

        The slots and trigrams are values that reach the scan. Lists are intersected by a count, which is formed
        in part before anything moves.
        """
        needle = text.lower()
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        if not grams:
            raise ValueError(f"a needle for the index has {GRAM} characters or more")
        postings = self.spark.read.schema(f"id string, {PART} int, gram string, {SLOT} int").parquet(f"{self.path}/grams")
        wanted = F.lit(False)
        for gram in grams:
            wanted = wanted | ((F.col(SLOT) == self._slot(F.lit(gram))) & (F.col("gram") == gram))
        held = postings.where(wanted).groupBy(PART, "id").agg(F.count(F.lit(1)).alias("_held"))
        return held.where(F.col("_held") == len(grams)).select(PART, "id")

    def search(self, text: str = "", classification: str | None = None) -> DataFrame:
        """What ``search_cases`` finds among the stored cases.

        Candidates may hold the trigrams apart, so each is verified on its text. A needle of less than three characters has no
        trigram and is looked for in all rows.
        """
        if len(text.lower()) < GRAM:
            return search_cases(self._rows(), text, classification).drop(PART)
        found = self.candidates(text).persist()
        parts = sorted(r[0] for r in found.select(PART).distinct().collect())  # as many numbers as there are folders
        rows = self._rows().where(F.col(PART).isin(parts))
        # The ids are joined by Spark's choice: few of them are broadcast, many are shuffled.
        return search_cases(rows.join(found, [PART, "id"], "left_semi"), text, classification).drop(PART)
