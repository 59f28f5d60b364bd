"""The stream jobs run over the stored test tables.

History is written once, as a log of files in event order, and one query works it off; how much of it
comes into one micro-batch is the query's own bound on files. A last record, later than all others, lets
the watermark pass every window.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.plans.batch import score
from riskweave.plans.fixtures import PARAMS, Fixture
from riskweave.schemas import ANOMALY, SCORED
from riskweave.session import store, working_dir
from riskweave.operators.lateness import DROPPED, LATE, ON_TIME
from riskweave.sources.sinks import as_json_records, read_current, read_log
from riskweave.sources.change_stream import TOPICS
from riskweave.sources.profiles import read_accounts, read_merchants
from riskweave.sources.snapshots import union_all
from riskweave.streaming.asof import start_asof_job
from riskweave.streaming.carried import start_ema_job, start_lateness_job
from riskweave.streaming.history import account_state
from riskweave.streaming.jobs import OFFSET, PROCESSED, JobConfig, start_anomaly_job, start_score_job, start_spend_job
from riskweave.streaming.profiles import current_profiles, profile_table, start_profile_job

#: Rows of a file of the log, and files at least: a micro-batch reads one file.
FILE_ROWS, LEAST_FILES = 1_000_000, 4
SPEND_KEYS = ["window_start_ms", "window_end_ms", "dimension", "dimension_value"]
RAW, SCORED_TOPIC = "transactions.raw", "transactions.scored"
HEARTBEAT, HEARTBEAT_MS = "heartbeat", 3_600_000


def write_log(records: DataFrame, order: str, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write records as files in the order of ``order``, whatever it holds: rows without a value come first.

    The file source reads older files first, so each file gets a time after the one before it, as if the
    log had been written in that order.
    """
    spark = records.sparkSession
    records = store(records, "log-records")  # counted, sampled for the ranges and written
    files = max(LEAST_FILES, math.ceil(records.count() / file_rows))
    ranged = records.repartitionByRange(files, order).sortWithinPartitions(order)
    ranged.drop(order).write.json(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    newest = max((fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(n)).getModificationTime() for n in names), default=0)
    for k, name in enumerate(names):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), newest - 1000 * (len(names) - k), -1)


def change_records(txns: DataFrame) -> DataFrame:
    """Transactions as change records; nothing but the envelope is added."""
    kept = [c for c in txns.columns if c not in ("op", "event_time_ms")]
    row = F.struct(*kept, F.col("event_time_ms").alias("event_time"))
    body = F.struct(row.alias("after"), F.col("op"), F.col("event_time_ms").alias("ts_ms"))
    return txns.select(
        F.to_json(body).alias("value"),
        F.lit(RAW).alias("topic"),
        F.col("transaction_id").cast("bigint").alias("offset"),
    )


def _config(base: str, job: str, source: str) -> JobConfig:
    return JobConfig(
        source={"path": f"{base}/{source}", "maxFilesPerTrigger": "1"},
        checkpoint=f"{base}/checkpoints/{job}",
        table=f"{base}/{job}",
        interval=None,
        params=PARAMS,
    )


def replay_scores(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Change log to scored transactions, upserted by transaction."""
    base = working_dir(fx.spark, "replay-scores")
    cfg = replace(_config(base, "scored", "changes"), sink={"path": f"{base}/published"})
    txns = fx.all_transactions
    write_log(change_records(txns).withColumn("_at", F.col("offset")), "_at", cfg.source["path"], file_rows)
    start_score_job(fx.spark, cfg, lambda: fx.merchants, lambda: fx.accounts).awaitTermination()
    changing = ["risk_score", "score_breakdown", PROCESSED]
    current = read_current(fx.spark, cfg.table, ["transaction_id"], update_cols=changing, order_col=OFFSET)
    return current.drop(OFFSET, PROCESSED)


def replay_scores_with_profiles(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Profile changes to tables, change log to scored transactions against them; no topic is read twice."""
    base = working_dir(fx.spark, "replay-profiles")
    tables = {}
    for kind, table, key, changed in (("merchants", fx.merchants, "merchant_id", "category"), ("accounts", fx.accounts, "account_id", "tier")):
        log = fx.profile_changes(table, key, changed).withColumns({"topic": F.lit(TOPICS[kind]), "_at": F.col("offset")})
        cfg = _config(base, kind, f"{kind}-changes")
        write_log(log, "_at", cfg.source["path"], file_rows)
        start_profile_job(fx.spark, cfg, kind).awaitTermination()
        tables[kind] = profile_table(fx.spark, cfg.table, kind)
    cfg = _config(base, "scored", "changes")
    write_log(change_records(fx.all_transactions).withColumn("_at", F.col("offset")), "_at", cfg.source["path"], file_rows)
    read = {kind: (lambda t=t: current_profiles(t)) for kind, t in tables.items()}
    start_score_job(fx.spark, cfg, read["merchants"], read["accounts"]).awaitTermination()
    changing = ["risk_score", "score_breakdown", PROCESSED]
    current = read_current(fx.spark, cfg.table, ["transaction_id"], update_cols=changing, order_col=OFFSET)
    return current.drop(OFFSET, PROCESSED)


def replay_lateness(fx: Fixture, arrivals: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows in order of arrival to tables by lateness, put together again with the name of their table."""
    base = working_dir(fx.spark, "replay-lateness")
    cfg = _config(base, "lateness", "changes")
    rows = fx.transactions.drop("event_time_ms").join(arrivals.select("transaction_id", "event_time_ms"), "transaction_id")
    write_log(change_records(rows).withColumn("_at", F.col("offset")), "_at", cfg.source["path"], file_rows)
    start_lateness_job(fx.spark, cfg).awaitTermination()
    parts = [read_log(fx.spark, f"{cfg.table}/{kind}").withColumn("lateness", F.lit(kind)) for kind in (ON_TIME, LATE, DROPPED)]
    return union_all(parts).drop("batch_id")


def replay_ema(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Scored transactions to the moving average after each."""
    base = working_dir(fx.spark, "replay-ema")
    cfg = _config(base, "ema", "scored")
    _feed_scored(fx, cfg.source["path"], file_rows)
    start_ema_job(fx.spark, cfg).awaitTermination()
    return read_log(fx.spark, cfg.table).drop("batch_id")


def _feed_scored(fx: Fixture, path: str, file_rows: int, heartbeat: bool = False) -> None:
    txns = fx.all_transactions.where(F.col("op") != "d")
    scored = score(txns, fx.merchants, fx.accounts)
    if heartbeat:
        last = scored.agg(F.max("event_time_ms").alias("_last")).where(F.col("_last").isNotNull())
        made = {f.name: F.lit(None).cast(f.dataType) for f in SCORED.fields}
        made |= {c: F.lit(HEARTBEAT) for c in ("transaction_id", "account_id")}
        made["event_time_ms"] = F.col("_last") + HEARTBEAT_MS
        scored = scored.unionByName(last.select(*[made[f.name].alias(f.name) for f in SCORED.fields]))
    records = as_json_records(scored, "account_id", SCORED_TOPIC)
    at = F.get_json_object("value", "$.event_time_ms").cast("bigint")
    write_log(records.withColumn("_at", at), "_at", path, file_rows)


def replay_spend(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Scored transactions to their spend windows; the window of the last record, a heartbeat, stays open."""
    base = working_dir(fx.spark, "replay-spend")
    cfg = _config(base, "spend", "scored")
    _feed_scored(fx, cfg.source["path"], file_rows, heartbeat=True)
    start_spend_job(fx.spark, cfg).awaitTermination()
    return read_current(fx.spark, cfg.table, SPEND_KEYS)


def replay_account_state(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Scored transactions to the state that the anomaly job ends with."""
    base = working_dir(fx.spark, "replay-state")
    cfg = _config(base, "anomalies", "scored")
    _feed_scored(fx, cfg.source["path"], file_rows)
    start_anomaly_job(fx.spark, cfg).awaitTermination()
    return account_state(fx.spark, cfg.checkpoint)


def replay_anomalies(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Scored transactions to anomalies, with the account history as keyed state."""
    base = working_dir(fx.spark, "replay-anomalies")
    cfg = _config(base, "anomalies", "scored")
    _feed_scored(fx, cfg.source["path"], file_rows)
    start_anomaly_job(fx.spark, cfg).awaitTermination()
    return read_log(fx.spark, cfg.table).drop("batch_id")


def replay_published(fx: Fixture, file_rows: int = FILE_ROWS) -> DataFrame:
    """Scored transactions to anomalies as a reader of the publishing sink finds them; no table is written."""
    base = working_dir(fx.spark, "replay-published")
    cfg = replace(_config(base, "anomalies", "scored"), table=None, sink={"path": f"{base}/published"})
    _feed_scored(fx, cfg.source["path"], file_rows)
    start_anomaly_job(fx.spark, cfg).awaitTermination()
    records = fx.spark.read.schema("key string, value string, topic string").json(cfg.sink["path"])
    return records.select("key", "topic", F.from_json("value", ANOMALY).alias("r")).select("key", "topic", "r.*")


def read_profiles(fx: Fixture) -> dict[str, DataFrame]:
    """The merchants and accounts of the moment, from the beginning of their topics on."""
    found = {}
    kinds = (("merchants", fx.merchants, "merchant_id", "category", read_merchants), ("accounts", fx.accounts, "account_id", "tier", read_accounts))
    for kind, table, key, changed, read in kinds:
        path = f"{working_dir(fx.spark, 'topics')}/{kind}"
        fx.profile_changes(table, key, changed).withColumn("topic", F.lit(TOPICS[kind])).write.json(path)
        found[kind] = read(fx.spark, {"path": path})
    return found


def replay_asof(fx: Fixture, versions: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Transactions and the versions of merchants, two streams side by side, to the version in force at each transaction.

    Both streams end with a record later than all others, so that the watermark passes what is waiting.
    """
    base = working_dir(fx.spark, "replay-asof")
    cfg = _config(base, "asof", "changes")
    last = F.greatest(fx.all_transactions.agg(F.max("event_time_ms")).scalar(), versions.agg(F.max("valid_from_ms")).scalar()) + HEARTBEAT_MS
    ends = fx.all_transactions.limit(1).withColumns({"transaction_id": F.lit("-1"), "op": F.lit("c"), "event_time_ms": last})
    at = F.get_json_object("value", "$.ts_ms").cast("bigint")
    records = change_records(fx.all_transactions.unionByName(ends)).withColumn("_at", at)
    write_log(records, "_at", cfg.source["path"], file_rows)
    profiles = {**cfg.source, "path": f"{base}/versions"}
    end = versions.limit(1).withColumns({"merchant_id": F.lit(HEARTBEAT), "valid_from_ms": last})
    body = F.struct(F.struct("merchant_id", "risk_category").alias("after"), F.lit("u").alias("op"), F.col("valid_from_ms").alias("ts_ms"))
    changes = versions.unionByName(end).select(
        F.to_json(body).alias("value"), F.lit(TOPICS["merchants"]).alias("topic"), F.col("revision").cast("bigint").alias("offset")
    )
    write_log(changes.withColumn("_at", at), "_at", profiles["path"], file_rows)
    start_asof_job(fx.spark, cfg, profiles).awaitTermination()
    return read_log(fx.spark, cfg.table).drop("batch_id")
