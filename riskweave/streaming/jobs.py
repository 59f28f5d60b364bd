"""The three stream jobs: score, spend, anomalies.

Each keeps its position and state in its checkpoint and writes one folder per micro-batch, so a
restart repeats at most the last micro-batch and replaces what that one wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from riskweave.operators.enrich import enrich
from riskweave.operators.rules import DEFAULT_RULES, Rule
from riskweave.operators.score import score_transactions
from riskweave.operators.spend import spend_union, with_event_time
from riskweave.params import SPEND_SPECS, RuleParams, SpendSpec, Weights
from riskweave.session import STREAM_SETTINGS
from riskweave.sources.cdc import to_transactions, unwrap_cdc
from riskweave.sources.change_stream import read_change_stream, read_scored_stream
from riskweave.sources.sinks import append_batch, write_json_batch
from riskweave.streaming.history import stream_anomalies

ReadTable = Callable[[], DataFrame]

#: Where a stored row came from in its log, which orders the versions of a key, and when it was scored.
OFFSET, PROCESSED = "source_offset", "processed_at"


@dataclass(frozen=True)
class JobConfig:
    """Where a job reads, writes and keeps its checkpoint.

    ``source`` and ``sink`` are Kafka options or hold a ``path``; ``table`` is the folder of the result
    table. ``interval`` is the least time between micro-batches, by default none: the next one starts when the
    last one has ended. None works off what is there and stops. ``idle_ms`` is how long the anomaly job keeps what it
    knows of an account without rows, by default for ever; it is removed in a later micro-batch with rows. A checkpoint is
    continued with or without a limit, as it began.
    """

    source: Mapping[str, str]
    checkpoint: str
    table: str | None = None
    sink: Mapping[str, str] | None = None
    raw_topic: str = "transactions.raw"
    scored_topic: str = "transactions.scored"
    anomaly_topic: str = "transactions.anomalies"
    tolerance: str = "5 seconds"
    interval: str | None = "0 seconds"
    idle_ms: int | None = None
    params: RuleParams = field(default_factory=RuleParams)
    weights: Weights = field(default_factory=Weights)


def start_batches(df: DataFrame, cfg: JobConfig, name: str, write: Callable[[DataFrame, int], object]) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``write``; one that repeats has the same number."""
    writer: DataStreamWriter = (
        df.writeStream.queryName(name).outputMode("append").option("checkpointLocation", cfg.checkpoint)
    )
    writer = writer.trigger(availableNow=True) if cfg.interval is None else writer.trigger(processingTime=cfg.interval)
    return writer.foreachBatch(write).start()


def stream_session(spark: SparkSession) -> SparkSession:
    """The session with the settings that stateful jobs need."""
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def write_results(batch: DataFrame, batch_id: int, key: str, topic: str, cfg: JobConfig) -> None:
    """Publish and store one micro-batch of results."""
    targets = [t for t in (cfg.sink, cfg.table) if t]
    rows = batch.persist() if len(targets) > 1 else batch
    try:
        if cfg.sink:
            write_json_batch(rows.drop(OFFSET), key, topic, cfg.sink, batch_id)
        if cfg.table:
            append_batch(rows, cfg.table, batch_id)
    finally:
        if rows.is_cached:
            rows.unpersist()


def enrich_batch(
    batch: DataFrame, batch_id: int, read_merchants: ReadTable, read_accounts: ReadTable, cfg: JobConfig
) -> None:
    """Score one micro-batch against the profiles of the moment; a changed profile re-emits nothing."""
    scored = score_transactions(enrich(batch, read_merchants(), read_accounts()), cfg.weights, keep=(OFFSET,))
    write_results(scored.withColumn(PROCESSED, F.current_timestamp()), batch_id, "account_id", cfg.scored_topic, cfg)


def start_score_job(
    spark: SparkSession, cfg: JobConfig, read_merchants: ReadTable, read_accounts: ReadTable
) -> StreamingQuery:
    """Change records to scored transactions."""
    changes = read_change_stream(stream_session(spark), cfg.source, cfg.raw_topic)
    txns = to_transactions(unwrap_cdc(changes)).drop("topic").withColumnRenamed("offset", OFFSET)
    return start_batches(
        txns, cfg, "score", lambda batch, batch_id: enrich_batch(batch, batch_id, read_merchants, read_accounts, cfg)
    )


def start_spend_job(
    spark: SparkSession, cfg: JobConfig, specs: tuple[SpendSpec, ...] = SPEND_SPECS
) -> StreamingQuery:
    """Scored transactions to spend windows; a window is written once, when the watermark has passed its end."""
    scored = read_scored_stream(stream_session(spark), cfg.source, cfg.scored_topic)
    sums = spend_union(with_event_time(scored, tolerance=cfg.tolerance), specs)
    return start_batches(
        sums, cfg, "spend", lambda batch, batch_id: write_results(batch, batch_id, "dimension_value", "spend", cfg)
    )


def start_anomaly_job(
    spark: SparkSession, cfg: JobConfig, rules: tuple[Rule, ...] = DEFAULT_RULES, strict_order: bool = False
) -> StreamingQuery:
    """Scored transactions to anomalies."""
    scored = read_scored_stream(stream_session(spark), cfg.source, cfg.scored_topic)
    timed = with_event_time(scored, tolerance=cfg.tolerance) if strict_order else scored
    hits = stream_anomalies(timed, cfg.params, rules, strict_order, cfg.idle_ms)
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    if cfg.idle_ms is not None:
        # Else a job by the machine's time runs empty micro-batches without end. A query keeps what held at its start.
        spark.conf.set(name, "false")
    try:
        return start_batches(
            hits,
            cfg,
            "anomalies",
            lambda batch, batch_id: write_results(batch, batch_id, "account_id", cfg.anomaly_topic, cfg),
        )
    finally:
        spark.conf.set(name, before)


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows a running or finished query has dropped behind its watermark, as far as progress is kept."""
    return sum(
        int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress for op in progress["stateOperators"]
    )
