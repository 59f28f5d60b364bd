"""Keyed tables, and the jobs whose state they hold."""

from __future__ import annotations

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from riskweave.operators.ema import account_ema
from riskweave.operators.enrich import enrich
from riskweave.operators.ordered import SplitPolicy
from riskweave.operators.score import score_transactions
from riskweave.sources.change_stream import TOPICS
from riskweave.sources.keyed_table import KeyedTable
from riskweave.sources.sinks import as_json_records, read_log
from riskweave.streaming.carried import ema_batch, runs_before, start_ema_job, start_lateness_job
from riskweave.streaming.jobs import JobConfig, start_score_job
from riskweave.streaming.profiles import current_profiles, profile_table, start_profile_job
from tests.builders import START, frame, random_rows

COLUMNS = "k string, part bigint, v double, seq bigint"


def make(spark, path, **rules):
    return KeyedTable(spark, str(path), COLUMNS, ("k", "part"), ("seq",), **rules)


def merged(rows, update):
    """Plain version: rows come in order of writes."""
    held: dict[tuple, list] = {}
    for write in rows:
        best: dict[tuple, tuple] = {}
        for k, part, v, seq in write:
            best[k, part] = max(best.get((k, part), (-1, None)), (seq, v))
        for key, (seq, v) in best.items():
            if key not in held:
                held[key] = [v, seq]
            elif seq >= held[key][1]:
                held[key] = [v if update else held[key][0], seq]
    return {key: tuple(x) for key, x in held.items()}


@pytest.mark.parametrize("update", [True, False])
def test_writes_equal_a_plain_merge_and_repeat_without_effect(spark, tmp_path, update):
    rng = random.Random(3)
    writes = [[(rng.choice(["a", "b", None, "c d", "é"]), rng.randrange(6), rng.random(), rng.randrange(20)) for _ in range(n)] for n in (40, 1, 0, 25)]
    table = make(spark, tmp_path, buckets=5, update_cols=None if update else ("seq",))
    assert table.read().count() == 0
    for i, rows in enumerate(writes):
        for _ in range(2):
            table.write(spark.createDataFrame(rows, COLUMNS), i)
        # Equal orders: the largest value counts, as in the plain version.
        got = {(r.k, r.part): (r.v, r.seq) for r in table.read().collect()}
        assert got == merged(writes[: i + 1], update)
    assert table.read_before(1, spark.createDataFrame(writes[0], COLUMNS)).count() == len(merged(writes[:1], update))


def test_a_write_reads_only_touched_buckets_and_moves_no_stored_row(spark, tmp_path):
    table = make(spark, tmp_path, buckets=16)
    table.write(spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit(0).cast("long").alias("part"), F.lit(1.0).alias("v"), F.lit(0).cast("long").alias("seq")), 0)
    update = spark.createDataFrame([("7", 0, 2.0, 1), ("new", 0, 3.0, 1)], COLUMNS)
    touched = table.write(update, 1)
    assert 1 <= len(touched) <= 2
    heads = table.heads()
    assert {b for b, w in heads.items() if w == 1} == touched and len(heads) == 16
    old = table._rows({b: 0 for b in touched})
    latest = table._latest(update).withColumn("bucket", table._bucket()).persist()
    latest.count()  # its size is known, as it is when a write merges
    plan = table.merge(old, latest)._jdf.queryExecution().executedPlan().toString()
    read = {name.split("bucket=")[1].split("/")[0] for name in old.inputFiles()}
    assert read == {str(b) for b in touched}
    # The stored rows are the side that stays in joins with what is broadcast.
    latest.unpersist()
    assert "SortMergeJoin" not in plan and "LeftOuter, BuildRight" in plan and "LeftSemi, BuildRight" in plan
    assert {(r.k, r.v) for r in table.read().where("k in ('7', 'new', '8')").collect()} == {("7", 2.0), ("new", 3.0), ("8", 1.0)}


def records(spark, kind, changes, folder):
    rows = [(json.dumps(body), TOPICS[kind], offset) for offset, body in changes]
    spark.createDataFrame(rows, "value string, topic string, offset long").coalesce(1).write.mode("append").json(str(folder))


def config(tmp_path, job):
    return JobConfig(source={"path": str(tmp_path / f"{job}-in")}, checkpoint=str(tmp_path / f"{job}-at"), table=str(tmp_path / job), interval=None)


def test_profiles_are_merged_change_by_change(spark, tmp_path):
    cfg = config(tmp_path, "merchants")
    shop = lambda key, risk: {"merchant_id": key, "name": key.upper(), "category": "FOOD", "risk_category": risk, "country": "US"}
    pieces = [
        [(0, {"after": shop("a", "LOW"), "op": "r", "ts_ms": 10}), (1, {"after": shop("b", "LOW"), "op": "r", "ts_ms": 10})],
        [(2, {"after": shop("a", "HIGH"), "op": "u", "ts_ms": 30}), (3, {"before": {"merchant_id": "b"}, "op": "d", "ts_ms": 40})],
        # Late: an older update of both, and a new profile.
        [(4, {"after": shop("a", "MEDIUM"), "op": "u", "ts_ms": 20}), (5, {"after": shop("b", "MEDIUM"), "op": "u", "ts_ms": 35}), (6, {"after": shop("c", "LOW"), "op": "c", "ts_ms": 50})],
    ]
    read = []
    for piece in pieces:
        records(spark, "merchants", piece, cfg.source["path"])
        query = start_profile_job(spark, cfg, "merchants", buckets=4)
        query.awaitTermination()
        read += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    # Each change is read once; nothing is replayed.
    table = profile_table(spark, cfg.table, "merchants", buckets=4)
    assert sum(read) <= 3 * 7 and {(r.merchant_id, r.risk_category) for r in current_profiles(table).collect()} == {("a", "HIGH"), ("c", "LOW")}

    txns = config(tmp_path, "score")
    sale = lambda n, shop: {"after": {"transaction_id": f"{n}", "account_id": "x", "merchant_id": shop, "amount": 5.0, "event_time": START + n}, "op": "c", "ts_ms": START}
    for n, shop_id in enumerate("abc"):
        records(spark, "transactions", [(n, sale(n, shop_id))], txns.source["path"])
        accounts = spark.createDataFrame([], "account_id string, tier string, country string, risk_score double")
        start_score_job(spark, txns, lambda: current_profiles(table), lambda: accounts).awaitTermination()
    got = {r.merchant_id: r.merchant_risk for r in read_log(spark, txns.table).collect()}
    assert got == {"a": "HIGH", "b": "MEDIUM", "c": "LOW"}


def publish(spark, rows, folder):
    none = spark.createDataFrame([], "merchant_id string, name string, category string, risk_category string, country string")
    accounts = spark.createDataFrame([], "account_id string, tier string, country string, risk_score double")
    scored = score_transactions(enrich(frame(spark, rows), none, accounts))
    as_json_records(scored, "account_id", "transactions.scored").coalesce(1).write.mode("append").json(folder)


@pytest.mark.parametrize("policy", [SplitPolicy(), SplitPolicy(min_rows=20, slot=15)])
def test_averages_over_micro_batches_equal_batch(spark, tmp_path, policy):
    rows = random_rows(240, seed=5)
    cfg = config(tmp_path, "ema")
    for at in range(0, 240, 80):
        publish(spark, rows[at : at + 80], cfg.source["path"])
        start_ema_job(spark, cfg, 0.2, policy, buckets=8).awaitTermination()
    got = {r.transaction_id: r.ema for r in read_log(spark, cfg.table).collect()}
    expected = {r.transaction_id: r.ema for r in account_ema(frame(spark, rows), 0.2).collect()}
    assert got.keys() == expected.keys() and len(got) == 240
    assert all(abs(got[k] - expected[k]) <= 1e-9 * max(1, abs(expected[k])) for k in got)


def test_averages_over_many_micro_batches_take_few_jobs(spark, tmp_path):
    rows = [{**r, "account_id": None} if r["account_id"] == "acc0" else r for r in random_rows(180, seed=6)]
    assert any(r["account_id"] is None for r in rows)
    cfg = config(tmp_path, "many")
    cfg = replace(cfg, source={**cfg.source, "maxFilesPerTrigger": "1"})
    for at in range(0, 180, 20):
        publish(spark, rows[at : at + 20], cfg.source["path"])
    query = start_ema_job(spark, cfg, 0.2, buckets=8)
    query.awaitTermination()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 9
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(query.runId)) <= 15 * len(batches)
    got = {r.transaction_id: r.ema for r in read_log(spark, cfg.table).collect()}
    expected = {r.transaction_id: r.ema for r in account_ema(frame(spark, rows), 0.2).collect()}
    assert got.keys() == expected.keys() and len(got) == 180
    assert all(abs(got[k] - expected[k]) <= 1e-9 * max(1, abs(expected[k])) for k in got)


def test_a_repeated_micro_batch_starts_from_the_same_averages(spark, tmp_path):
    rows, cfg, state = random_rows(100, seed=7), config(tmp_path, "again"), str(tmp_path / "state")
    for batch_id in (0, 1, 2, 3, 3, 4):
        ema_batch(frame(spark, rows[20 * batch_id : 20 * batch_id + 20]), batch_id, cfg, state, 0.2, SplitPolicy())
    got = {r.transaction_id: r.ema for r in read_log(spark, cfg.table).collect()}
    expected = {r.transaction_id: r.ema for r in account_ema(frame(spark, rows), 0.2).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) <= 1e-9 * max(1, abs(expected[k])) for k in got)


def test_few_runs_of_averages_cover_all_micro_batches_before():
    for batch_id in range(300):
        runs = runs_before(batch_id)
        covered = [n for level, number in runs for n in range(number * 4**level, (number + 1) * 4**level)]
        assert sorted(covered) == list(range(batch_id)) and len(runs) <= 15


def test_late_rows_come_to_tables_of_their_own(spark, tmp_path):
    cfg = config(tmp_path, "late")
    rng, newest, expected = random.Random(1), None, {}
    for piece in range(4):
        changes = []
        for n in range(piece * 30, piece * 30 + 30):
            at = START + n * 1000 - rng.choice([0, 0, 0, 7_000, 60_000])
            body = {"after": {"transaction_id": f"{n}", "account_id": "x", "event_time": at, "amount": 1.0}, "op": "c", "ts_ms": START}
            changes.append((n, body))
            lag = max(0, newest - 5_000 - at) if newest is not None else 0
            expected[f"{n}"] = "on_time" if lag == 0 else "late" if lag <= 10_000 else "dropped"
            newest = max(newest or 0, at)
        records(spark, "transactions", changes, cfg.source["path"])
        start_lateness_job(spark, cfg, policy=SplitPolicy(slot=8)).awaitTermination()
    got = {r.transaction_id: kind for kind in ("on_time", "late", "dropped") for r in read_log(spark, f"{cfg.table}/{kind}").collect()}
    assert got == expected and set(got.values()) == {"on_time", "late", "dropped"}
