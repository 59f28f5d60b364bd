from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.operators import rules
from riskweave.operators.ordered import SLOT, SplitPolicy, large_keys, spread
from riskweave.params import RuleParams
from tests.builders import frame, random_rows, txn
from tests.reference_rules import simulate

POLICIES = {
    "whole": SplitPolicy(),
    "hot account cut": SplitPolicy(min_rows=100, slots_per_share=4),
    "all accounts cut": SplitPolicy(min_rows=30, slots_per_share=2),
    "many slots": SplitPolicy(min_rows=13, slots_per_share=1),
}


def flags(df):
    return {(r.transaction_id, r.reason_code) for r in df.select("transaction_id", "reason_code").collect()}


def evidence(df):
    return {r.transaction_id: r.evidence for r in df.collect()}


def test_burst_flags_from_the_eleventh_row_of_one_moment(spark):
    rows = [txn(n, amount=10 + n) for n in range(1, 16)]
    hits = evidence(rules.velocity_flags(frame(spark, rows)))
    assert {k: v["txn_count"] for k, v in hits.items()} == {f"{n:06d}": str(n) for n in range(11, 16)}
    assert hits["000011"] == {"txn_count": "11", "window_ms": "60000", "threshold": "10"}


def test_velocity_window_is_inclusive(spark):
    ten = [txn(n, at=0) for n in range(10)]
    at_edge = ten + [txn(10, at=60_000)]
    behind = ten + [txn(10, at=60_001)]
    assert flags(rules.velocity_flags(frame(spark, at_edge))) == {("000010", "VELOCITY")}
    assert flags(rules.velocity_flags(frame(spark, behind))) == set()
    assert flags(rules.velocity_flags(frame(spark, ten))) == set()


def test_spike_after_eight_small_amounts(spark):
    rows = [txn(n, amount=5 + 5 * n, at=n * 1000) for n in range(8)] + [txn(8, amount=3000, at=9000)]
    hits = evidence(rules.amount_spikes(frame(spark, rows)))
    assert list(hits) == ["000008"]
    assert hits["000008"] == {
        "amount": "3000.00",
        "mean": "22.50",
        "stddev": "12.25",
        "z_score": "243.11",
        "threshold": "3.0",
    }


@pytest.mark.parametrize("history, expected", [(4, set()), (5, {("000099", "AMOUNT_SPIKE")})])
def test_spike_needs_five_earlier_rows(spark, history, expected):
    rows = [txn(n, amount=10 + n % 2, at=n) for n in range(history)] + [txn(99, amount=500, at=1000)]
    assert flags(rules.amount_spikes(frame(spark, rows))) == expected


def test_no_spike_without_spread_or_at_the_threshold(spark):
    same = [txn(n, amount=10, at=n) for n in range(6)] + [txn(99, amount=500, at=1000)]
    assert flags(rules.amount_spikes(frame(spark, same))) == set()
    # Mean 10 and sample deviation 2 exactly: 16 is three deviations above.
    exact = [txn(n, amount=a, at=n) for n, a in enumerate([8, 12, 8, 12, 10])]
    assert flags(rules.amount_spikes(frame(spark, exact + [txn(99, amount=16, at=100)]))) == set()
    above = rules.amount_spikes(frame(spark, exact + [txn(99, amount=16.01, at=100)]))
    assert flags(above) == {("000099", "AMOUNT_SPIKE")}


def test_trip_between_two_cities(spark):
    rows = [txn(1, lat=37.77, lon=-122.42), txn(2, lat=55.76, lon=37.62, at=1000)]
    hit = evidence(rules.geo_travel(frame(spark, rows)))["000002"]
    assert hit["prev_lat"] == "37.77" and hit["curr_lon"] == "37.62" and hit["max_speed_kmh"] == "900.0"
    assert 9400 < float(hit["distance_km"]) < 9500 and hit["elapsed_hours"] == "0.000"


def test_missing_location_neither_counts_nor_resets(spark):
    rows = [txn(1, lat=10, lon=10), txn(2, at=500), txn(3, lat=-40, lon=100, at=1000)]
    hits = evidence(rules.geo_travel(frame(spark, rows)))
    assert list(hits) == ["000003"] and hits["000003"]["prev_lat"] == "10.0"


def test_rows_at_one_moment_use_the_least_time(spark):
    rows = [txn(1, lat=10, lon=10), txn(2, lat=10.001, lon=10), txn(3, lat=10.001, lon=10)]
    assert flags(rules.geo_travel(frame(spark, rows))) == {("000002", "GEO_TRAVEL")}


@pytest.mark.parametrize("policy", POLICIES.values(), ids=POLICIES.keys())
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_row_by_row(spark, policy, seed):
    rows = random_rows(1500, seed)
    params = RuleParams(max_txn=6, window_ms=120_000, z_threshold=2.5, min_history=4)
    assert flags(rules.detect_anomalies(frame(spark, rows), params, policy)) == simulate(rows, params)


@pytest.mark.parametrize("name", [n for n in POLICIES if n != "whole"])
def test_cutting_changes_no_fact(spark, name):
    df = frame(spark, random_rows(800, seed=5))
    key = ["account_id", "transaction_id"]
    whole = rules.account_history(df).toPandas().sort_values(key).reset_index(drop=True)
    cut = rules.account_history(df, policy=POLICIES[name]).toPandas().sort_values(key).reset_index(drop=True)
    assert list(whole.recent_count) == list(cut.recent_count)
    assert list(whole.prior_count) == list(cut.prior_count)
    assert list(whole.previous) == list(cut.previous)
    for fact in ("prior_mean", "prior_stddev"):
        gap = (whole[fact].fillna(-1) - cut[fact].fillna(-1)).abs().max()
        assert gap < 1e-9


def test_large_amounts_keep_their_spread_when_cut(spark):
    rows = [txn(n, amount=1e9 + n % 3, at=n * 1000) for n in range(300)]
    policy = SplitPolicy(min_rows=10, slots_per_share=2)
    whole = {r.transaction_id: r.prior_stddev for r in rules.account_history(frame(spark, rows)).collect()}
    cut = {r.transaction_id: r.prior_stddev for r in rules.account_history(frame(spark, rows), policy=policy).collect()}
    assert max(abs(whole[k] - cut[k]) for k in whole) < 1e-6


@pytest.mark.parametrize("moment", [False, True], ids=["over time", "at one moment"])
def test_hot_account_is_spread_over_slots(spark, moment):
    rows = random_rows(3000, seed=3, hot_share=0.5)
    if moment:
        rows = [r | {"event_time_ms": 1} if r["account_id"] == "hot" else r for r in rows]
    df = frame(spark, rows)
    large = large_keys(df, ["account_id"], SplitPolicy(min_rows=300, slots_per_share=2))
    assert [r[0] for r in large.keys.collect()] == ["hot"]
    order = ["event_time_ms", "transaction_id"]
    cut = spread(large.of(df), ["account_id"], order, large.slots)
    sizes = [r["count"] for r in cut.groupBy(SLOT).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 400
    in_order = [r[SLOT] for r in cut.orderBy(*order).collect()]
    assert in_order == sorted(in_order)


def test_burst_of_a_hot_account_is_counted_across_slots(spark):
    rows = [txn(n, "hot") for n in range(500)]
    policy = SplitPolicy(min_rows=50, slots_per_share=2)
    hits = evidence(rules.velocity_flags(frame(spark, rows), policy=policy))
    assert {k: int(v["txn_count"]) for k, v in hits.items()} == {f"{n:06d}": n + 1 for n in range(10, 500)}


def test_copies_of_one_row_are_spread(spark):
    df = frame(spark, [txn(7, "hot")] * 1000)
    large = large_keys(df, ["account_id"], SplitPolicy(min_rows=100, slots_per_share=2))
    cut = spread(large.of(df), ["account_id"], ["event_time_ms", "transaction_id"], large.slots)
    assert max(r["count"] for r in cut.groupBy(SLOT).count().collect()) < 400
    counts = rules.account_history(df, policy=SplitPolicy(100, 2)).select("recent_count", "prior_count").collect()
    assert sorted(map(tuple, counts)) == [(n + 1, n) for n in range(1000)]


def test_own_rule_and_sequence(spark):
    rule = rules.Rule(
        "FIRST_SEEN", fires=lambda p: F.col("prior_count") == 0, evidence=lambda p: F.create_map(F.lit("n"), F.lit("0"))
    )
    rows = [txn(1), txn(1, op="u"), txn(2, account="b")]
    df = frame(spark, rows).withColumn("offset", F.monotonically_increasing_id())
    hits = rules.detect_anomalies(df, rules=(rule,), sequence="offset")
    assert sorted(r.id for r in hits.collect()) == ["000001:FIRST_SEEN", "000002:FIRST_SEEN"]


def test_parameters_from_environment():
    env = {"ANOMALY_VELOCITY_MAX_TXN": "3", "ANOMALY_VELOCITY_WINDOW_SECS": "30", "ANOMALY_ZSCORE_THRESHOLD": "2.5"}
    assert RuleParams.from_env(env) == RuleParams(max_txn=3, window_ms=30_000, z_threshold=2.5)
    assert RuleParams.from_env({}) == RuleParams()


def test_plan_has_one_exchange_of_the_rows(spark):
    df = rules.detect_anomalies(frame(spark, random_rows(500, seed=9)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final
