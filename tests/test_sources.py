from __future__ import annotations

import json
import time

import pytest

from riskweave.schemas import ACCOUNT_FIELDS
from riskweave.sources import cdc
from riskweave.sources.change_stream import parse_scored, route_by_table
from riskweave.sources.sinks import append_batch, as_json_records, compact, read_current, read_log
from riskweave.sources.snapshots import latest_per_key, snapshot_plus_changes
from riskweave.sources.tables import read_table, to_stored
from tests.builders import frame, txn

AFTER = {
    "transaction_id": "t",
    "account_id": "a",
    "merchant_id": "m",
    "amount": 12.5,
    "currency": "EUR",
    "latitude": 1.5,
    "longitude": 2.5,
    "event_time": 1_700_000_000_000,
}


def record(after=AFTER, op="c", ts_ms=1_600_000_000_000, **changes):
    body = {"before": None, "after": None if after is None else after | changes}
    if op is not None:
        body["op"] = op
    if ts_ms is not None:
        body["ts_ms"] = ts_ms
    return json.dumps(body)


def parsed(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return [r.asDict() for r in cdc.to_transactions(cdc.unwrap_cdc(df)).collect()]


def test_plain_record(spark):
    (row,) = parsed(spark, record())
    assert row == {
        "transaction_id": "t",
        "account_id": "a",
        "merchant_id": "m",
        "amount": 12.5,
        "currency": "EUR",
        "latitude": 1.5,
        "longitude": 2.5,
        "event_time_ms": 1_700_000_000_000,
        "op": "c",
    }


@pytest.mark.parametrize(
    "value",
    [record(op="d"), record(after=None), "no json", '{"op":"c","after":{"transaction_id":"t"', "", None, "[]", '{"op":"c"}'],
)
def test_dropped_records(spark, value):
    assert parsed(spark, value) == []


@pytest.mark.parametrize("op, kept", [("u", "u"), ("r", "r"), (None, "c")])
def test_kept_operations(spark, op, kept):
    assert [r["op"] for r in parsed(spark, record(op=op))] == [kept]


@pytest.mark.parametrize(
    "change, column, expected",
    [
        ({"amount": "12.75"}, "amount", 12.75),
        ({"amount": "n/a"}, "amount", 0.0),
        ({"amount": None}, "amount", 0.0),
        ({"latitude": None}, "latitude", 0.0),
        ({"currency": ""}, "currency", "USD"),
        ({"currency": None}, "currency", "USD"),
        ({"account_id": None}, "account_id", ""),
        ({"event_time": "1700000000123"}, "event_time_ms", 1_700_000_000_123),
        ({"event_time": 1.7e12}, "event_time_ms", 1_700_000_000_000),
        ({"event_time": "2026-06-12T14:30:00Z"}, "event_time_ms", 1_781_274_600_000),
        ({"event_time": "2026-06-12T14:30:00.250+02:00"}, "event_time_ms", 1_781_267_400_250),
        ({"event_time": "soon"}, "event_time_ms", 1_600_000_000_000),
        ({"event_time": 0}, "event_time_ms", 1_600_000_000_000),
        ({"event_time": -5}, "event_time_ms", 1_600_000_000_000),
    ],
)
def test_lenient_fields(spark, change, column, expected):
    (row,) = parsed(spark, record(**change))
    assert row[column] == expected


def test_time_of_ingestion_is_the_last_resort(spark):
    (row,) = parsed(spark, record(ts_ms=None, event_time=None))
    assert abs(row["event_time_ms"] - time.time() * 1000) < 60_000


def test_empty_row_gets_every_default(spark):
    (row,) = parsed(spark, json.dumps({"after": {}, "ts_ms": 5}))
    assert (row["transaction_id"], row["amount"], row["currency"], row["event_time_ms"]) == ("", 0.0, "USD", 5)


def test_profiles_keep_the_key_of_a_delete(spark):
    rows = [
        json.dumps({"after": {"account_id": "1", "tier": "VIP", "risk_score": "0.5"}, "op": "c", "ts_ms": 1}),
        json.dumps({"before": {"account_id": "1"}, "op": "d", "ts_ms": 2}),
        json.dumps({"after": {"account_id": "2", "tier": "VIP", "risk_score": 0.25}, "op": "r", "ts_ms": 3}),
    ]
    df = spark.createDataFrame([(v,) for v in rows], "value string")
    log = cdc.to_accounts(cdc.parse_cdc(df, fields=ACCOUNT_FIELDS))
    (row,) = latest_per_key(log, "account_id", ["ts_ms"]).collect()
    assert (row.account_id, row.tier, row.risk_score) == ("2", "VIP", 0.25)


def test_changes_override_the_snapshot(spark):
    snapshot = spark.createDataFrame([("1", "old"), ("2", "old"), ("3", "old")], "id string, v string")
    changes = spark.createDataFrame(
        [("1", "new", "u", 5), ("1", "newer", "u", 6), ("2", None, "d", 7), ("4", "first", "c", 1)],
        "id string, v string, op string, ts_ms long",
    )
    state = {r.id: r.v for r in snapshot_plus_changes(snapshot, changes, "id", ["ts_ms"]).collect()}
    assert state == {"1": "newer", "3": "old", "4": "first"}


def test_routing(spark):
    df = spark.createDataFrame([("transactions", 1), ("accounts", 2), ("audit", 3)], "table string, n int")
    routed = {topic: [r.n for r in part.collect()] for topic, part in route_by_table(df).items()}
    assert routed == {"transactions.raw": [1], "enrichment.merchants": [], "enrichment.accounts": [2]}


def test_scored_records_round_trip_and_skip_damage(spark):
    from riskweave.operators.enrich import enrich
    from riskweave.operators.score import score_transactions
    from riskweave.schemas import ACCOUNT, MERCHANT

    txns = frame(spark, [txn(1, amount=100), txn(2, account="b")])
    scored = score_transactions(enrich(txns, spark.createDataFrame([], MERCHANT), spark.createDataFrame([], ACCOUNT)))
    records = as_json_records(scored, "account_id", "transactions.scored")
    assert sorted(r.key for r in records.collect()) == ["a", "b"]
    damaged = records.select("value").union(spark.createDataFrame([("{oops",), (None,)], "value string"))
    back = parse_scored(damaged)
    assert sorted(back.collect()) == sorted(scored.collect()) and back.columns == scored.columns


def test_log_table_upserts(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "k string, amount double, score double"
    append_batch(spark.createDataFrame([("a", 1.0, 0.1), ("b", 2.0, 0.2)], schema), path, 0)
    append_batch(spark.createDataFrame([("b", 99.0, 0.9), ("c", 3.0, 0.3)], schema), path, 1)
    # The same batch once more, as after a restart.
    append_batch(spark.createDataFrame([("b", 99.0, 0.9), ("c", 3.0, 0.3)], schema), path, 1)
    partial = read_current(spark, path, ["k"], update_cols=["score"])
    assert sorted(map(tuple, partial.collect())) == [("a", 1.0, 0.1), ("b", 2.0, 0.9), ("c", 3.0, 0.3)]
    full = read_current(spark, path, ["k"])
    assert ("b", 99.0, 0.9) in set(map(tuple, full.collect()))
    assert read_log(spark, path).count() == 4
    packed = compact(spark, path, str(tmp_path / "packed"), ["k"], update_cols=["score"])
    assert sorted(r.k for r in packed.collect()) == ["a", "b", "c"]


def test_stored_form_and_table_scan(spark, tmp_path):
    to_stored(frame(spark, [txn(1, amount=12.345)])).write.parquet(str(tmp_path / "transactions"))
    back = read_table(spark, "transactions", str(tmp_path))
    assert dict(back.dtypes)["amount"] == "decimal(12,2)" and dict(back.dtypes)["event_time"] == "timestamp"
    back.createOrReplaceTempView("stored_transactions")
    assert str(read_table(spark, "stored_transactions").first().amount) == "12.35"


def test_day_partitions_are_replaced_and_pruned(spark, tmp_path):
    from riskweave.operators.reports import top_spend
    from riskweave.schemas import SPEND
    from riskweave.sources.sinks import write_by_day

    day = 86_400_000
    path = str(tmp_path / "spend")

    def sums(*rows):
        return spark.createDataFrame([(d * day, d * day + 60_000, dim, v, total, 1) for d, dim, v, total in rows], SPEND)

    first = [(1, "MERCHANT", "a", 1.0), (2, "MERCHANT", "a", 2.0), (2, "ACCOUNT", "x", 5.0)]
    write_by_day(sums(*first), path, "window_start_ms", ("dimension",))
    write_by_day(sums((2, "MERCHANT", "b", 4.0)), path, "window_start_ms", ("dimension",))
    table = spark.read.parquet(path)
    assert sorted((r.dimension, r.dimension_value) for r in table.collect()) == [
        ("ACCOUNT", "x"),
        ("MERCHANT", "a"),
        ("MERCHANT", "b"),
    ]
    top = top_spend(table, "MERCHANT", as_of_ms=2 * day, lookback_ms=day // 2, k=5)
    assert [(r.dimension_value, r.total_spend) for r in top.collect()] == [("b", 4.0)]
    scan = next(line for line in top._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line)
    assert "day" in scan.split("PartitionFilters")[1] and "GreaterThanOrEqual(window_start_ms" in scan


def test_profiles_from_topics_and_jobs_from_the_command_line(spark, tmp_path):
    from riskweave.streaming.submit import start

    merchant = {"merchant_id": "m", "name": "Shop", "category": "FOOD", "risk_category": "LOW", "country": "X"}
    account = {"account_id": "a", "tier": "VIP", "country": "FR", "risk_score": 0.5}
    lines = [
        ("enrichment.merchants", {"after": merchant, "op": "r", "ts_ms": 1}),
        ("enrichment.merchants", {"after": merchant | {"risk_category": "HIGH"}, "op": "u", "ts_ms": 2}),
        ("enrichment.accounts", {"after": account, "op": "c", "ts_ms": 1}),
        ("transactions.raw", {"after": AFTER, "op": "c", "ts_ms": 1}),
    ]
    rows = [(json.dumps(body), topic, n) for n, (topic, body) in enumerate(lines)]
    source = str(tmp_path / "topics")
    spark.createDataFrame(rows, "value string, topic string, offset long").write.json(source)
    table = str(tmp_path / "scored")
    options = ["--source", f"path={source}", "--checkpoint", str(tmp_path / "cp"), "--table", table, "--interval", "once"]
    start(spark, ["score", *options]).awaitTermination()
    (row,) = read_log(spark, table).collect()
    assert (row.merchant_risk, row.account_tier) == ("HIGH", "VIP")
    assert row.score_breakdown["cross_border"] == 0.1


def test_shared_folder_is_the_one_the_cluster_names(spark):
    from types import SimpleNamespace

    from riskweave.session import shared_dir, working_dir

    def session(named, master):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId="other")
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(session("s3://bucket/work/", "yarn")) == "s3://bucket/work"
    with pytest.raises(ValueError):
        shared_dir(session(None, "yarn"))
    assert shared_dir(spark) == shared_dir(spark)
    assert working_dir(spark, "x") != working_dir(spark, "x")


def test_table_by_either_name(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    spark.range(4).write.parquet(str(tmp_path / "named.parquet"))
    assert read_table(spark, "plain", str(tmp_path)).count() == 3
    assert read_table(spark, "named", str(tmp_path)).count() == 4
