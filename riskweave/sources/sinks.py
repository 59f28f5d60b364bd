"""Sinks of the stream jobs.

A micro-batch may run twice. Each one therefore writes a folder of its own, named by the batch, and a
second run replaces exactly that folder; nothing that other batches wrote is read or moved. Tables with
a key are kept as such a log and merged per key when they are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BATCH = "batch_id"


def as_json_records(df: DataFrame, key_col: str, topic: str) -> DataFrame:
    """Rows as (key, value, topic) with the row as JSON in ``value``."""
    return df.select(
        F.col(key_col).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), F.lit(topic).alias("topic")
    )


def write_json_batch(df: DataFrame, key_col: str, topic: str, sink: Mapping[str, str], batch_id: int) -> None:
    """Publish one micro-batch: to Kafka (at least once), or to ``path`` as JSON lines (once per batch)."""
    records = as_json_records(df, key_col, topic)
    if "path" in sink:
        records.write.mode("overwrite").json(f"{sink['path']}/{BATCH}={batch_id}")
    else:
        records.write.format("kafka").options(**sink).save()


def write_json_stream(
    df: DataFrame, key_col: str, topic: str, sink: Mapping[str, str], checkpoint: str
) -> DataStreamWriter:
    """Stream form of ``write_json_batch``; start it with ``.start()``."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_json_batch(batch, key_col, topic, sink, batch_id)
    )


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch of a table; running it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a table, with their ``batch_id``."""
    rows = spark.read.parquet(path)
    return rows.withColumn(BATCH, F.col(BATCH).cast("bigint"))


def read_current(
    spark: SparkSession, path: str, keys: list[str], update_cols: list[str] | None = None, order_col: str | None = None
) -> DataFrame:
    """Upsert semantics over the log: the newest batch wins, for ``update_cols`` only if they are given.

    Other columns keep the value they were first inserted with. Within a batch ``order_col`` decides, such as
    the offset a row came from; rows that tie in it are ordered by all their values, so that the choice
    doesn't depend on how files are read.
    """
    rows = read_log(spark, path)
    columns = [c for c in rows.columns if c != BATCH]
    changing = [c for c in (columns if update_cols is None else update_cols) if c not in keys]
    fixed = [c for c in columns if c not in keys and c not in changing]
    sortable = [c for c in columns if "map<" not in rows.schema[c].dataType.simpleString() and c != order_col]
    order = F.struct(BATCH, *([order_col] if order_col else []), *sortable)
    picks = [F.max_by(F.struct(*changing), order).alias("_new")] if changing else []
    picks += [F.min_by(F.struct(*fixed), order).alias("_first")] if fixed else []
    parts = (["_new.*"] if changing else []) + (["_first.*"] if fixed else [])
    return rows.groupBy(*keys).agg(*picks).select(*keys, *parts).select(*columns)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], **rules) -> DataFrame:
    """Write the merged table to a new folder, as batch 0 of a log that can be continued there.

    ``rules`` are those of ``read_current``.
    """
    append_batch(read_current(spark, path, keys, **rules), target, 0)
    return read_log(spark, target)


DAY = "day"


def write_by_day(df: DataFrame, path: str, ms_col: str, by: tuple[str, ...] = ()) -> None:
    """Write a batch table partitioned by ``by`` and day; the partitions that occur in ``df`` are replaced.

    The rebalance hint makes files of even size and splits days or values that are much larger than others.
    """
    parts = [*by, DAY]
    dated = df.withColumn(DAY, F.to_date(F.timestamp_millis(ms_col)))
    dated.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *parts
    ).parquet(path)


def append_jdbc(
    df: DataFrame, options: Mapping[str, str], table: str, batch_size: int = 200, writers: int | None = None
) -> None:
    """Append to a database table, ``batch_size`` rows per statement, one connection per running task.

    ``writers`` bounds the connections where the database asks for it, at the price of a shuffle. For an
    upsert append to a staging table and let the database merge it (``INSERT ... ON CONFLICT``).
    """
    rows = df.repartition(writers) if writers else df
    rows.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch_size).mode(
        "append"
    ).save()
