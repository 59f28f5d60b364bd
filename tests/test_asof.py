"""Profiles in force at a time, from two streams, and look-ups in keyed tables."""

from __future__ import annotations

import json
import random
from bisect import bisect_right

from riskweave.operators import cases
from riskweave.plans.fixtures import Fixture
from riskweave.plans.queries import keyed_table
from riskweave.session import store
from riskweave.sources.keyed_table import KeyedTable
from riskweave.streaming import asof
from riskweave.streaming.asof import start_asof_job
from riskweave.streaming.jobs import JobConfig
from tests.builders import START

HOUR = 3_600_000


def feed(spark, folder, topic, rows):
    """Append one file: (time, order, row, op)."""
    lines = [(json.dumps({"after": row, "op": op, "ts_ms": at}), topic, order) for at, order, row, op in rows]
    spark.createDataFrame(lines, "value string, topic string, offset bigint").coalesce(1).write.mode("append").json(str(folder))


def payment(number, merchant, at):
    row = {"transaction_id": f"t{number}", "account_id": "a", "merchant_id": merchant, "amount": 1.5, "currency": "USD", "event_time": at}
    return at, number, row, "c"


def change(order, merchant, at, label, op="u"):
    return at, order, {"merchant_id": merchant, "name": "n", "category": "c", "risk_category": label, "country": "US"}, op


def run(spark, base, batches, salts=4):
    """One run per pair of lists (payments, changes), each continuing from the checkpoint."""
    cfg = JobConfig(source={"path": f"{base}/txns"}, checkpoint=f"{base}/checkpoint", table=f"{base}/table", interval=None)
    for payments, changes in batches:
        feed(spark, f"{base}/txns", "transactions.raw", payments)
        feed(spark, f"{base}/versions", "enrichment.merchants", changes)
        start_asof_job(spark, cfg, {"path": f"{base}/versions"}, salts=salts).awaitTermination()
    found = spark.read.parquet(cfg.table).select("transaction_id", "version.risk_category", "version.ts_ms").collect()
    return cfg, sorted(tuple(r) for r in found)


def last(at):
    """Records that let both watermarks pass."""
    return [payment(10**6, "end", at)], [change(10**6, "end", at, "END")]


def test_versions_that_come_after_the_payment_count(spark, tmp_path):
    t = START
    first = [payment(1, "m", t + 1000), payment(2, "m", t + 3000), payment(3, "other", t + 1000)]
    # The version of t + 2000 arrives in a later micro-batch than the payment of t + 3000, but within the tolerance.
    batches = [(first, [change(1, "m", t, "LOW")]), ([payment(4, "m", t)], [change(2, "m", t + 2000, "HIGH")]), last(t + HOUR)]
    _, found = run(spark, tmp_path, batches)
    assert found == [("t1", "LOW", t), ("t2", "HIGH", t + 2000), ("t3", None, None), ("t4", "LOW", t)]


def test_equal_times_deletes_and_keys_that_are_missing(spark, tmp_path):
    t = START
    changes = [change(1, "m", t, "A"), change(3, "m", t, "C"), change(2, "m", t, "B"), change(4, "m", t + 5000, "GONE", "d")]
    payments = [payment(1, "m", t), payment(2, "m", t + 5000), payment(3, None, t + 1), payment(4, "m", t - 1), payment(4, "m", t - 1)]
    _, found = run(spark, tmp_path, [(payments, changes), last(t + HOUR)])
    assert found == [("t1", "C", t), ("t2", None, None), ("t3", None, None), ("t4", None, None), ("t4", None, None)]


def test_random_batches_equal_a_plain_version_and_old_versions_go(spark, tmp_path):
    rng = random.Random(3)
    batches, payments, changes = [], [], []
    for k in range(3):
        base = START + k * HOUR
        some = [payment(100 * k + i, f"m{rng.randrange(3)}", base + rng.randrange(HOUR)) for i in range(60)]
        new = [change(100 * k + i, f"m{rng.randrange(3)}", base + rng.randrange(HOUR), f"v{k}-{i}") for i in range(30)]
        batches.append((some, new))
        payments, changes = payments + some, changes + new
    cfg, found = run(spark, tmp_path, [*batches, last(START + 4 * HOUR)])
    held: dict[str, dict[int, tuple]] = {}
    for at, order, row, _ in changes:
        known = held.setdefault(row["merchant_id"], {})
        known[at] = max(known.get(at, (-1, "")), (order, row["risk_category"]))
    wanted = []
    for at, _, row, _ in payments:
        known = held.get(row["merchant_id"], {})
        times = sorted(known)
        place = bisect_right(times, at)
        wanted.append((row["transaction_id"], known[times[place - 1]][1] if place else None, times[place - 1] if place else None))
    assert found == sorted(wanted, key=lambda r: r[0])
    state = spark.read.format("statestore").option("stateVarName", "versions").load(cfg.checkpoint)
    # One version a key and place is left; those of the last record lie ahead.
    assert all(r["count"] == 1 for r in state.groupBy("key").count().collect())


def test_job_brings_its_state_store(spark, tmp_path):
    """A session that no other stateful job has prepared."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        _, found = run(spark, tmp_path, [([payment(1, "m", START)], [change(1, "m", START, "LOW")]), last(START + HOUR)])
    finally:
        spark.conf.set(name, before)
    assert found == [("t1", "LOW", START)]


def test_keys_of_a_place_keep_apart(spark, tmp_path, monkeypatch):
    """All keys in one place: calls to the state store go by place, versions and rows by key."""
    monkeypatch.setattr(asof.stream_asof, "__defaults__", (*asof.stream_asof.__defaults__[:-1], 1))
    t = START
    changes = [change(k, f"m{k % 3}", t + k * 1000, f"v{k}") for k in range(9)]
    payments = [payment(k, f"m{k % 3}" if k % 5 else None, t + k * 1000 + 500) for k in range(12)]
    cfg, found = run(spark, tmp_path, [(payments, changes), last(t + HOUR)], salts=1)
    wanted = []
    for k in range(12):
        of = k if k < 9 else 6 + k % 3
        wanted.append((f"t{k}", f"v{of}", t + of * 1000) if k % 5 else (f"t{k}", None, None))
    assert found == sorted(wanted)
    state = spark.read.format("statestore").option("stateVarName", "versions").load(cfg.checkpoint)
    held = [r.v.of_key for r in state.selectExpr("explode(value.versions) AS v").collect()]
    assert sorted(held) == ["end", "m0", "m1", "m2"]


def test_look_up_reads_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k string, v bigint", ("k",), ("v",), buckets=32)
    table.write(spark.range(5000).selectExpr("cast(id as string) k", "id v"), 0)
    wanted = spark.createDataFrame([("7",), ("11",), ("none",), ("7",), (None,)], "k string")
    found = table.look_up(wanted)
    assert sorted(map(tuple, found.collect())) == [("11", 11), ("7", 7)]
    buckets = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}
    assert len(buckets) <= 4 < 32 == len(table.heads())
    assert table.look_up(wanted.limit(0)).count() == 0


def test_a_case_reads_one_bucket_and_shuffles_no_large_table(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    table = keyed_table(fx, "one-case", fx.transactions, ("transaction_id",), ("event_time_ms",))
    table.write(fx.transactions, 0)
    one = store(cases.newest_page(fx.anomaly_table, limit=1), "one")
    rows = table.look_up(one)
    assert rows.count() == 1
    assert len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles() if "bucket=" in f}) == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
