"""Change and record streams, from Kafka or from files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.json import parse_once
from riskweave.schemas import SCORED

# Topic of each source table (fixed values).
TOPICS = {
    "transactions": "transactions.raw",
    "merchants": "enrichment.merchants",
    "accounts": "enrichment.accounts",
}

FILE_SCHEMA = "value string, topic string, offset bigint"


def read_change_stream(
    spark: SparkSession, source: Mapping[str, str], topic: str, starting: str = "latest", streaming: bool = True
) -> DataFrame:
    """Change records as (value, topic, offset, ingest_ts).

    ``source`` holds either ``kafka.bootstrap.servers`` and further Kafka options, or ``path`` of a folder
    of JSON lines with value, topic and offset. ``starting`` is where a Kafka query without a checkpoint
    begins; the position after that is kept in the query's checkpoint. ``maxOffsetsPerTrigger`` or
    ``maxFilesPerTrigger`` in ``source`` bound a micro-batch.
    """
    reader = spark.readStream if streaming else spark.read
    if "path" in source:
        options = {k: v for k, v in source.items() if k != "path"}
        records = reader.schema(FILE_SCHEMA).options(**options).json(source["path"])
        return records.where(F.col("topic") == topic).select(
            "value", "topic", "offset", F.current_timestamp().alias("ingest_ts")
        )
    # A batch query reads up to the present, so it can only start at the beginning.
    start = starting if streaming else "earliest"
    records = (
        reader.format("kafka").options(**source).option("subscribe", topic).option("startingOffsets", start).load()
    )
    return records.select(
        F.col("value").cast("string").alias("value"), "topic", "offset", F.col("timestamp").alias("ingest_ts")
    )


def parse_scored(records: DataFrame, value_col: str = "value") -> DataFrame:
    """Scored records from JSON text; unreadable ones are skipped."""
    parsed = parse_once(records, value_col, SCORED, "_s")
    return parsed.select(*[F.col(f"_s.{c}").alias(c) for c in SCORED.fieldNames()])


def read_scored_stream(spark: SparkSession, source: Mapping[str, str], topic: str = "transactions.scored") -> DataFrame:
    """Stream of scored transactions."""
    return parse_scored(read_change_stream(spark, source, topic))


def route_by_table(
    changes: DataFrame, tables: Mapping[str, str] = TOPICS, table_col: str = "table"
) -> dict[str, DataFrame]:
    """Split one change DataFrame by source table; the keys of the result are the topics."""
    return {
        topic: changes.where(F.col(table_col) == table).withColumn("topic", F.lit(topic))
        for table, topic in tables.items()
    }


def with_topic(changes: DataFrame, tables: Mapping[str, str] = TOPICS, table_col: str = "table") -> DataFrame:
    """Label each change with its topic in one pass; changes of other tables are left out."""
    pairs = [F.lit(part) for table, topic in tables.items() for part in (table, topic)]
    return changes.withColumn("topic", F.try_element_at(F.create_map(*pairs), F.col(table_col))).where(
        F.col("topic").isNotNull()
    )
