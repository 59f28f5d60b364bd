from __future__ import annotations

import math
import time
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators.rules import detect_anomalies
from riskweave.operators.score import score_transactions
from riskweave.operators.enrich import enrich
from riskweave.operators.spend import spend_union
from riskweave.params import RuleParams
from riskweave.plans.fixtures import Fixture
from riskweave.plans import replay
from riskweave.schemas import ACCOUNT, MERCHANT, SCORED
from riskweave.sources.change_stream import parse_scored
from riskweave.sources.sinks import as_json_records, read_current, read_log, write_json_stream
from riskweave.streaming.history import ROW, SUMMARY, AnomalyProcessor, account_facts, account_state, stream_facts
from riskweave.streaming.jobs import (
    OFFSET,
    PROCESSED,
    JobConfig,
    late_rows_dropped,
    start_anomaly_job,
    start_score_job,
    start_spend_job,
)
from tests.builders import START, frame, random_rows, txn

PARAMS = RuleParams(max_txn=6, window_ms=120_000, z_threshold=2.5, min_history=4)


def scored(spark, rows):
    return score_transactions(
        enrich(frame(spark, rows), spark.createDataFrame([], MERCHANT), spark.createDataFrame([], ACCOUNT))
    )


def publish(spark, rows, folder):
    """One file of scored records, as the score job writes them."""
    as_json_records(scored(spark, rows), "account_id", "transactions.scored").coalesce(1).write.mode("append").json(folder)


def config(tmp_path, **changes):
    cfg = JobConfig(
        source={"path": str(tmp_path / "in")},
        checkpoint=str(tmp_path / "checkpoint"),
        table=str(tmp_path / "table"),
        interval=None,
        params=PARAMS,
    )
    return replace(cfg, **changes)


def pieces(rows, count):
    size = -(-len(rows) // count)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def keys(df):
    return {(r.transaction_id, r.reason_code, tuple(sorted(r.evidence.items()))) for r in df.collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_anomalies_over_micro_batches_equal_batch(spark, tmp_path, strict):
    rows = random_rows(600, seed=21)
    cfg = config(tmp_path)
    # Each piece is a job of its own, so the state also survives a restart between them.
    for piece in pieces(rows, 3):
        publish(spark, piece, cfg.source["path"])
        start_anomaly_job(spark, cfg, strict_order=strict).awaitTermination()
    if strict:
        publish(spark, [txn(999_999, "end", at=10**9)], cfg.source["path"])
        start_anomaly_job(spark, cfg, strict_order=True).awaitTermination()
    assert keys(read_log(spark, cfg.table)) == keys(detect_anomalies(scored(spark, rows), PARAMS))


def test_strict_order_sorts_between_micro_batches(spark, tmp_path):
    rows = [txn(n, amount=10 + n % 5, at=n * 1000) for n in range(40)]
    rows[30]["amount"] = 900.0
    mixed = rows[::2], rows[1::2]
    # Both halves overlap in time, so the tolerance has to span them.
    cfg = config(tmp_path, tolerance="60 seconds")
    for part in (*mixed, [txn(999_999, "end", at=10**9)]):
        publish(spark, part, cfg.source["path"])
        start_anomaly_job(spark, cfg, strict_order=True).awaitTermination()
    assert keys(read_log(spark, cfg.table)) == keys(detect_anomalies(scored(spark, rows), PARAMS))


def test_spend_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    base = START - START % 300_000

    def at(n, ms, amount):
        return txn(n, amount=amount) | {"event_time_ms": base + ms}

    cfg = config(tmp_path)
    batches = [
        [at(1, 1_000, 1.0), at(2, 59_000, 2.0)],
        [at(3, 400_000, 4.0)],
        # Behind the watermark of 395 s: dropped. At its edge: counted.
        [at(4, 2_000, 100.0), at(5, 396_000, 8.0)],
        [at(6, 900_000, 16.0)],
    ]
    dropped = 0
    for rows in batches:
        publish(spark, rows, cfg.source["path"])
        query = start_spend_job(spark, cfg)
        query.awaitTermination()
        dropped += late_rows_dropped(query)
    got = {
        (r.dimension, r.window_start_ms - base): (r.total_amount, r.txn_count)
        for r in read_current(spark, cfg.table, replay.SPEND_KEYS).collect()
    }
    assert got == {
        ("CATEGORY", 0): (3.0, 2),
        ("CATEGORY", 360_000): (12.0, 2),
        ("MERCHANT", 0): (3.0, 2),
        ("MERCHANT", 360_000): (12.0, 2),
        ("ACCOUNT", 0): (3.0, 2),
        ("ACCOUNT", 300_000): (12.0, 2),
    }
    # The late row counts once per roll-up.
    assert dropped == 3


def test_score_job_publishes_stores_and_reads_fresh_profiles(spark, tmp_path):
    profile_path = str(tmp_path / "merchants")

    def merchants(risk, mode):
        spark.createDataFrame([("m", "Shop", "FOOD", risk, "X")], MERCHANT).write.mode(mode).parquet(profile_path)

    cfg = config(tmp_path, sink={"path": str(tmp_path / "published")})
    readers = (lambda: spark.read.parquet(profile_path), lambda: spark.createDataFrame([], ACCOUNT))
    for n, risk in ((1, "LOW"), (2, "HIGH")):
        merchants(risk, "overwrite")
        replay.change_records(frame(spark, [txn(n)])).write.mode("append").json(cfg.source["path"])
        start_score_job(spark, cfg, *readers).awaitTermination()
    stored = {r.transaction_id: r.merchant_risk for r in read_log(spark, cfg.table).collect()}
    assert stored == {"000001": "LOW", "000002": "HIGH"}
    published = parse_scored(spark.read.schema("key string, value string, topic string").json(cfg.sink["path"]))
    assert sorted(r.transaction_id for r in published.collect()) == ["000001", "000002"]


def test_json_stream_sink(spark, tmp_path):
    publish(spark, [txn(1), txn(2, "b")], str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, value string, topic string").json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = write_json_stream(stream.select("key", "value"), "key", "copy", {"path": out}, str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.key for r in spark.read.json(out).collect()) == ["a", "b"]


@pytest.mark.parametrize("name", ["replay_scores", "replay_spend", "replay_anomalies"])
def test_replay_in_many_micro_batches(spark, name):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    got = getattr(replay, name)(fx, file_rows=150)
    if name == "replay_scores":
        expected = fx.scored.select("transaction_id", "risk_score")
        assert set(got.select("transaction_id", "risk_score").collect()) == set(expected.collect())
    elif name == "replay_anomalies":
        assert keys(got) == keys(fx.anomalies)
    else:
        simple = lambda df: {(*[r[k] for k in replay.SPEND_KEYS], round(r.total_amount, 6), r.txn_count) for r in df.collect()}
        assert simple(got) == simple(spend_union(fx.scored))


@pytest.mark.parametrize("file_rows", [40, 10_000])
def test_log_holds_rows_without_time(spark, tmp_path, file_rows):
    rows = [(str(n), None if n % 10 == 0 else n) for n in range(200)]
    path = str(tmp_path / "log")
    replay.write_log(spark.createDataFrame(rows, "value string, _at long"), "_at", path, file_rows)
    assert sorted(int(r.value) for r in spark.read.json(path).collect()) == list(range(200))
    files = sorted(tmp_path.glob("log/part-*"), key=lambda f: f.stat().st_mtime)
    assert len(files) >= 4 and files == sorted(files)


def arrival_facts(batches, params):
    """The rules row by row: batches as they arrive, rows of a batch by time."""
    times, n, mean, squares, place, hits = [], 0, 0.0, 0.0, None, set()
    for batch in batches:
        for row in sorted(batch, key=lambda r: (r["event_time_ms"], r["transaction_id"])):
            now = row["event_time_ms"]
            amount, lat, lon = (row[c] if row[c] is not None else 0.0 for c in ("amount", "latitude", "longitude"))
            times = [t for t in [*times, now] if t >= now - params.window_ms]
            if len(times) > params.max_txn:
                hits.add((row["transaction_id"], "VELOCITY"))
            spread = math.sqrt(squares / (n - 1)) if n > 1 else 0.0
            if n >= params.min_history and spread and (amount - mean) / spread > params.z_threshold:
                hits.add((row["transaction_id"], "AMOUNT_SPIKE"))
            n += 1
            gap = amount - mean
            mean += gap / n
            squares += gap * (amount - mean)
            if lat or lon:
                if place and place[2] > 0:
                    chord = math.sin(math.radians(lat - place[0]) / 2) ** 2 + math.cos(math.radians(place[0])) * math.cos(
                        math.radians(lat)
                    ) * math.sin(math.radians(lon - place[1]) / 2) ** 2
                    km = 2 * 6371.0 * math.atan2(math.sqrt(chord), math.sqrt(1 - chord))
                    if km / max((now - place[2]) / 3_600_000, 1e-9) > params.max_kmh:
                        hits.add((row["transaction_id"], "GEO_TRAVEL"))
                place = (lat, lon, now)
    return hits


def test_late_rows_and_missing_values_in_arrival_order(spark, tmp_path):
    """Late rows count, nulls are zeros, and times that have left the window are pruned."""
    city, far = dict(lat=48.1, lon=11.6), dict(lat=-33.9, lon=151.2)
    batches = [
        [txn(1, at=1_000, **city)],
        [txn(2, at=400_000, **city)],
        [txn(3, at=3_000, **far)],  # late, elsewhere
        [txn(4, at=401_000, **city)],
        [txn(10 + n, amount=11 + n % 2, at=500_000 + n * 500, **city) for n in range(8)],
        [txn(30, at=505_000, **city) | {"amount": None}, txn(31, at=506_000) | {"latitude": None, "longitude": None}],
        [txn(32, amount=5_000.0, at=506_500, **city)],
        [txn(40 + n, at=900_000 + n, **city) for n in range(7)],  # the window starts anew
    ]
    cfg = config(tmp_path)
    for rows in batches:
        publish(spark, rows, cfg.source["path"])
        start_anomaly_job(spark, cfg).awaitTermination()
    got = {(r.transaction_id, r.reason_code) for r in read_log(spark, cfg.table).collect()}
    wanted = arrival_facts(batches, PARAMS)
    assert got == wanted
    assert {("000003", "GEO_TRAVEL"), ("000004", "GEO_TRAVEL"), ("000032", "AMOUNT_SPIKE")} <= got
    assert ("000031", "GEO_TRAVEL") not in got
    assert {t for t, code in got if code == "VELOCITY"} >= {"000046"} and ("000045", "VELOCITY") not in got


def test_state_keeps_only_the_window():
    rows = pd.DataFrame([("a", 10, 1.0, 0.0, 0.0), ("b", 500, 2.0, 3.0, 4.0)], columns=list(ROW))
    facts, state = account_facts(rows, (2, 5.0, 2.0), (1.0, 2.0, 7), [1, 5, 450, 900], window_ms=100)
    assert list(facts.recent_count) == [5, 3]
    assert state[-1] == [450, 500, 900] and state[3:6] == (3.0, 4.0, 500)
    assert list(facts.prior_count) == [2, 3] and facts.prior_mean.iloc[1] == pytest.approx(11 / 3)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_values_that_are_no_number_fire_no_rule(spark, tmp_path, value):
    rows = [txn(n, amount=10 + n % 3, at=n * 200_000, lat=48.1, lon=11.6) for n in range(1, 12)]
    rows[7]["amount"] = rows[9]["latitude"] = value
    cfg = config(tmp_path)
    for piece in pieces(rows, 3):
        publish(spark, piece, cfg.source["path"])
        start_anomaly_job(spark, cfg).awaitTermination()
    batch = keys(detect_anomalies(scored(spark, rows), PARAMS))
    streamed = keys(read_log(spark, cfg.table)) if list((tmp_path / "table").glob("*/part*")) else set()
    assert {k[:2] for k in streamed} == {k[:2] for k in batch}
    assert all(code != "GEO_TRAVEL" for _, code, _ in batch)
    assert {t for t, code, _ in batch if code == "AMOUNT_SPIKE"} <= ({"000008"} if value == float("inf") else set())


@pytest.mark.parametrize("order", [1, -1])
def test_update_beside_its_create_is_stored_in_log_order(spark, tmp_path, order):
    """The amount is that of the create, the score that of the update, however the files are read."""
    create, update = txn(1, amount=10.0), txn(1, amount=5000.0, op="u")
    cfg = config(tmp_path)
    for offset, row in ((0, create), (1, update))[::order]:
        records = replay.change_records(frame(spark, [row])).withColumn("offset", F.lit(offset).cast("bigint"))
        records.coalesce(1).write.mode("append").json(cfg.source["path"])
    nothing = (lambda: spark.createDataFrame([], MERCHANT), lambda: spark.createDataFrame([], ACCOUNT))
    start_score_job(spark, cfg, *nothing).awaitTermination()
    changing = ["risk_score", "score_breakdown", PROCESSED]
    row = read_current(spark, cfg.table, ["transaction_id"], update_cols=changing, order_col=OFFSET).first()
    scores = {r.amount: r.risk_score for r in scored(spark, [create]).union(scored(spark, [update])).collect()}
    assert (row.amount, row.risk_score) == (10.0, scores[5000.0]) and row[PROCESSED] is not None


def test_schema_of_scored_rows(spark):
    assert scored(spark, [txn(1)]).columns == SCORED.fieldNames()


def test_state_survives_a_restart_with_other_partitions(spark, tmp_path):
    rows = random_rows(300, seed=8)
    cfg = config(tmp_path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for piece, partitions in zip(pieces(rows, 3), ("4", "7", "2"), strict=True):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            publish(spark, piece, cfg.source["path"])
            start_anomaly_job(spark, cfg).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for row in rows:
        want.setdefault(row["account_id"], []).append(row["amount"])
    held = {r.account_id: r for r in account_state(spark, cfg.checkpoint).collect()}
    assert {a: r.amount_count for a, r in held.items()} == {a: len(x) for a, x in want.items()}
    for account, amounts in want.items():
        assert held[account].amount_mean == pytest.approx(sum(amounts) / len(amounts))
        assert held[account].amount_stddev == pytest.approx(pd.Series(amounts).std())


def test_state_of_an_idle_account_is_removed(spark, tmp_path):
    cfg = config(tmp_path, idle_ms=1500)
    burst = [txn(n, "a", at=n * 1000) for n in range(5)] + [txn(10 + n, "b", at=n * 1000) for n in range(3)]
    publish(spark, burst, cfg.source["path"])
    start_anomaly_job(spark, cfg).awaitTermination()
    assert {r.account_id for r in account_state(spark, cfg.checkpoint).collect()} == {"a", "b"}
    time.sleep(2)
    publish(spark, [txn(20, "b", at=9000)], cfg.source["path"])
    start_anomaly_job(spark, cfg).awaitTermination()
    # b had a row, but later than its state lasted, so it starts anew.
    assert [(r.account_id, r.amount_count) for r in account_state(spark, cfg.checkpoint).collect()] == [("b", 1)]


def test_state_kept_long_enough_changes_nothing(spark, tmp_path):
    rows = random_rows(200, seed=4)
    cfg = config(tmp_path, idle_ms=3_600_000)
    for piece in pieces(rows, 2):
        publish(spark, piece, cfg.source["path"])
        start_anomaly_job(spark, cfg).awaitTermination()
    assert keys(read_log(spark, cfg.table)) == keys(detect_anomalies(scored(spark, rows), PARAMS))
    with pytest.raises(ValueError):
        AnomalyProcessor(PARAMS, strict_order=True, idle_ms=1)


def test_state_lies_by_place(spark, tmp_path, monkeypatch):
    """State is read and written once per place, however many accounts it has; accounts keep apart."""
    monkeypatch.setattr(stream_facts, "__defaults__", (*stream_facts.__defaults__[:-1], 2))
    rows = random_rows(300, seed=5)
    cfg = config(tmp_path)
    for piece in pieces(rows, 2):
        publish(spark, piece, cfg.source["path"])
        start_anomaly_job(spark, cfg).awaitTermination()
    assert keys(read_log(spark, cfg.table)) == keys(detect_anomalies(scored(spark, rows), PARAMS))
    accounts = {row["account_id"] for row in rows}
    assert {r.account_id for r in account_state(spark, cfg.checkpoint).collect()} == accounts and len(accounts) > 2
    assert spark.read.format("statestore").option("stateVarName", SUMMARY).load(cfg.checkpoint).count() <= 2
