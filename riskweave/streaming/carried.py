"""Jobs whose state is a table: each micro-batch is a batch computation that starts from what the one before it left.

An account's moving average after some rows is ``own + start * (1 - alpha) ** rows``, an affine map of the average
before them. Maps of rows that follow each other compose, so a micro-batch needs one scan, and the rows of a hot account
are cut into slots like in batch. The averages after a micro-batch are a run of rows, one per account; runs are merged
by fours, so a later micro-batch reads few of them. Lateness needs one number, the largest event time so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.ema import account_ema
from riskweave.operators.lateness import DROPPED, LATE, ON_TIME, classify_lateness
from riskweave.operators.ordered import SplitPolicy
from riskweave.params import LATE_DROP_MS, LATE_TOLERANCE_MS
from riskweave.sources.cdc import to_transactions, unwrap_cdc
from riskweave.sources.change_stream import read_change_stream, read_scored_stream
from riskweave.sources.sinks import append_batch
from riskweave.streaming.jobs import JobConfig, start_batches

STATE = "state"
#: So many runs of averages are merged into one.
FAN_IN = 4
#: Files of a run at most.
FILES = 256
AVERAGES = "account_id string, ema double, batch bigint"


def runs_before(batch_id: int) -> list[tuple[int, int]]:
    """Level and number of the runs that hold all micro-batches before ``batch_id``: the digits of that number.

    A run of level l holds the last averages of ``FAN_IN ** l`` micro-batches that follow each other.
    """
    found, level, left = [], 0, batch_id
    while left:
        left, digit = divmod(left, FAN_IN)
        found += [(level, left * FAN_IN + n) for n in range(digit)]
        level += 1
    return found


def _run(path: str, level: int, number: int) -> str:
    return f"{path}/level={level}/run={number}"


def _newest_of(spark: SparkSession, path: str, runs: list[tuple[int, int]]) -> DataFrame:
    """The last average of each account in ``runs``."""
    rows = spark.read.schema(AVERAGES).parquet(*[_run(path, *run) for run in runs])
    if len(runs) == 1:  # an account has one row in a run
        return rows
    return rows.groupBy("account_id").agg(F.max_by("ema", "batch").alias("ema"), F.max("batch").alias("batch"))


def write_averages(last: DataFrame, batch_id: int, path: str, files: int = FILES) -> None:
    """Write the averages after a micro-batch as a run, and merge runs when there are enough of a level.

    An average is rewritten once per level. The names of runs follow from the number of the micro-batch, so a
    repeated micro-batch replaces its own, and the runs that it reads were whole before it began.
    """
    last.coalesce(files).write.mode("overwrite").parquet(_run(path, 0, batch_id))
    level, number = 0, batch_id + 1
    while number % FAN_IN == 0:
        parts = [(level, n) for n in range(number - FAN_IN, number)]
        level, number = level + 1, number // FAN_IN
        merged = _newest_of(last.sparkSession, path, parts)
        merged.coalesce(files).write.mode("overwrite").parquet(_run(path, level, number - 1))


def ema_batch(
    batch: DataFrame, batch_id: int, cfg: JobConfig, state: str, alpha: float, policy: SplitPolicy, files: int = FILES
) -> None:
    """Averages of one micro-batch, continued from the state before it."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        many = batch.count()
        before = _newest_of(spark, state, runs_before(batch_id)).withColumnRenamed("ema", "start") if batch_id else None
        rows = account_ema(batch, alpha, policy, before, many).select("account_id", "transaction_id", "event_time_ms", "ema")
        append_batch(rows, cfg.table, batch_id)
    finally:
        batch.unpersist()
    stored = spark.read.schema(rows.schema).parquet(f"{cfg.table}/batch_id={batch_id}")
    last = stored.groupBy("account_id").agg(F.max_by("ema", F.struct("event_time_ms", "transaction_id")).alias("ema"))
    write_averages(last.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id, state, files)


def start_ema_job(
    spark: SparkSession, cfg: JobConfig, alpha: float = 0.1, policy: SplitPolicy = SplitPolicy(), buckets: int = FILES
) -> StreamingQuery:
    """Scored transactions to the moving average after each; arrival order counts between micro-batches, event time within.

    ``buckets`` bounds the files of a run of averages.
    """
    state = f"{cfg.checkpoint}-{STATE}"
    rows = read_scored_stream(spark, cfg.source, cfg.scored_topic).select("account_id", "transaction_id", "event_time_ms", "amount")
    return start_batches(rows, cfg, "ema", lambda batch, batch_id: ema_batch(batch, batch_id, cfg, state, alpha, policy, buckets))


def _newest_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The largest event time up to the micro-batch before ``batch_id``; each one has stored its own, one row."""
    if batch_id == 0:
        return None
    return spark.read.schema("newest bigint, batch_id bigint").parquet(path).where(F.col("batch_id") == batch_id - 1).first()[0]


def lateness_batch(batch: DataFrame, batch_id: int, cfg: JobConfig, state: str, tolerance_ms: int, drop_ms: int, policy: SplitPolicy) -> None:
    """Write the on-time, late and dropped rows of one micro-batch to tables of their own."""
    spark = batch.sparkSession
    newest = _newest_before(spark, state, batch_id)
    rows = classify_lateness(batch, "offset", tolerance_ms, drop_ms, policy=policy, seen_ms=newest)
    append_batch(rows, f"{cfg.table}/all", batch_id)
    stored = spark.read.parquet(f"{cfg.table}/all/batch_id={batch_id}")
    for kind in (ON_TIME, LATE, DROPPED):
        append_batch(stored.where(F.col("lateness") == kind).drop("lateness"), f"{cfg.table}/{kind}", batch_id)
    largest = stored.agg(F.greatest(F.max("event_time_ms"), F.lit(newest).cast("bigint")).alias("newest"))
    append_batch(largest, state, batch_id)


def start_lateness_job(
    spark: SparkSession,
    cfg: JobConfig,
    tolerance_ms: int = LATE_TOLERANCE_MS,
    drop_ms: int = LATE_DROP_MS,
    policy: SplitPolicy = SplitPolicy(),
) -> StreamingQuery:
    """Change records to rows by lateness, in ``cfg.table``: folders on_time, late and dropped.

    The watermark of a row trails the largest event time that arrived before it, in whatever micro-batch.
    """
    changes = read_change_stream(spark, cfg.source, cfg.raw_topic)
    rows = to_transactions(unwrap_cdc(changes)).select("transaction_id", "account_id", "offset", "event_time_ms")
    state = f"{cfg.checkpoint}-{STATE}"
    return start_batches(
        rows, cfg, "lateness", lambda batch, batch_id: lateness_batch(batch, batch_id, cfg, state, tolerance_ms, drop_ms, policy)
    )
