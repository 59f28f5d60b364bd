from __future__ import annotations

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.functions.geo import haversine_km, speed_kmh
from riskweave.functions.scores import percent_of, score_band, score_percent
from riskweave.operators import cases, reports
from riskweave.operators.ema import account_ema
from riskweave.operators.enrich import enrich, enrich_asof
from riskweave.operators.lateness import classify_lateness
from riskweave.operators.ordered import SplitPolicy, large_keys
from riskweave.operators.score import COMPONENTS, score_components, score_transactions
from riskweave.operators.spend import spend_by, spend_union
from riskweave.operators.upsert import append_idempotent, insert_if_absent, upsert
from riskweave.operators.verdicts import validate_verdicts
from riskweave.schemas import ACCOUNT, MERCHANT
from tests.builders import START, frame, random_rows, txn
from tests.reference_rules import haversine

CUT = SplitPolicy(min_rows=20, slots_per_share=3)
BOTH = pytest.mark.parametrize("policy", [SplitPolicy(), CUT], ids=["whole", "cut"])
MIDNIGHT = START - START % 86_400_000


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def profiles(spark):
    merchants = spark.createDataFrame(
        [("hi", "Shop", "CRYPTO", "HIGH", "X"), ("mid", "Bar", "FOOD", "MEDIUM", "X"), ("low", "Pub", "FOOD", "LOW", "X")],
        MERCHANT,
    )
    accounts = spark.createDataFrame(
        [("us", "Ann", "VIP", "US", 1000.0, 0.5), ("fr", "Bea", "PREMIUM", "FR", 0.0, 0.9)], ACCOUNT
    )
    return merchants, accounts


@pytest.mark.parametrize(
    "merchant, account, hour, amount, expected",
    [
        ("hi", "fr", 3, 20_000, (0.25, 0.35, 0.18, 0.10, 0.10)),
        ("hi", "us", 6, 10_000, (0.25, 0.35, 0.10, 0.0, 0.0)),
        ("mid", "fr", 5, 0, (0.0, 0.15, 0.18, 0.10, 0.0)),
        ("low", "us", 23, 99, (0.25 * math.log(100) / math.log(10_001), 0.05, 0.10, 0.0, 0.0)),
        ("?", "?", 12, 0, (0.0, 0.15, 0.06, 0.0, 0.0)),
    ],
)
def test_score_terms(spark, merchant, account, hour, amount, expected):
    row = txn(1, account, amount, merchant=merchant) | {"event_time_ms": MIDNIGHT + hour * 3_600_000}
    enriched = enrich(frame(spark, [row]), *profiles(spark))
    terms = score_components(enriched).first()
    got = tuple(terms[f"score_{name}"] for name in COMPONENTS)
    assert got == pytest.approx(expected) and terms.score_breakdown == pytest.approx(dict(zip(COMPONENTS, expected)))
    total = score_transactions(enriched).first().risk_score
    assert total == pytest.approx(min(sum(expected), 1.0))


def test_misses_get_defaults(spark):
    row = enrich(frame(spark, [txn(1, "?", merchant="?")]), *profiles(spark)).first()
    assert (row.merchant_name, row.merchant_category, row.merchant_risk) == ("Unknown", "UNKNOWN", "MEDIUM")
    assert (row.account_tier, row.account_country, row.account_risk) == ("STANDARD", "US", 0.3)
    assert row.merchant_miss and row.account_miss


def test_amounts_below_the_domain_of_the_logarithm(spark):
    scored = score_transactions(enrich(frame(spark, [txn(1, amount=-5), txn(2, amount=-1)]), *profiles(spark)))
    scores = {r.transaction_id: r.risk_score for r in scored.collect()}
    assert math.isnan(scores["000001"]) and scores["000002"] == float("-inf")


def test_functions(spark):
    got = value(spark, haversine_km(F.lit(37.77), F.lit(-122.42), F.lit(55.76), F.lit(37.62)))
    assert got == pytest.approx(haversine(37.77, -122.42, 55.76, 37.62))
    assert value(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)
    assert value(spark, speed_kmh(F.lit(1.0), F.lit(-10))) == pytest.approx(1e9)
    assert value(spark, score_percent(F.lit(0.125))) == 13
    assert value(spark, score_percent(F.lit(float("nan")))) is None
    bands = [value(spark, score_band(F.lit(n))) for n in (100, 80, 79, 60, 59, 40, 39, 0)]
    assert bands == ["critical", "critical", "high", "high", "medium", "medium", "low", "low"]
    assert value(spark, score_band(F.lit(None).cast("int"))) is None
    assert [value(spark, percent_of(F.lit(a), F.lit(b))) for a, b in ((5.0, 20.0), (5.0, 0.0))] == [25.0, 0.0]


def test_spend_windows(spark):
    rows = [txn(1, amount=1, at=0), txn(2, amount=2, at=59_999), txn(3, amount=4, at=60_000), txn(4, "b", 8, at=1)]
    base = START - START % 300_000
    df = frame(spark, [r | {"event_time_ms": r["event_time_ms"] - START + base} for r in rows])
    by_minute = {(r.window_start_ms - base, r.dimension_value): (r.total_amount, r.txn_count) for r in spend_by(df, "ACCOUNT", "account_id", 60_000).collect()}
    assert by_minute == {(0, "a"): (3.0, 2), (60_000, "a"): (4.0, 1), (0, "b"): (8.0, 1)}
    all_rows = spend_union(df.withColumn("merchant_category", F.lit("FOOD"))).collect()
    assert sum(r.total_amount for r in all_rows) == 45.0
    assert {(r.dimension, r.window_end_ms - r.window_start_ms) for r in all_rows} == {
        ("CATEGORY", 60_000),
        ("MERCHANT", 60_000),
        ("ACCOUNT", 300_000),
    }


def test_top_spend_cuts_by_time_and_breaks_ties_by_name(spark):
    spend = spark.createDataFrame(
        [(0, 60, "MERCHANT", "old", 99.0, 1), (100, 160, "MERCHANT", "b", 5.0, 1), (100, 160, "MERCHANT", "a", 5.0, 2), (200, 260, "MERCHANT", "c", 6.0, 3)],
        "window_start_ms long, window_end_ms long, dimension string, dimension_value string, total_amount double, txn_count long",
    )
    top = reports.top_spend(spend, "MERCHANT", as_of_ms=200, lookback_ms=100, k=2)
    assert [(r.dimension_value, r.total_spend) for r in top.collect()] == [("c", 6.0), ("a", 5.0)]
    series = reports.spend_timeseries(spend, "MERCHANT", 200, 100)
    assert [(r.time_ms, r.metric) for r in series.collect()] == [(100, "a"), (100, "b"), (200, "c")]


@BOTH
def test_average_row_by_row(spark, policy):
    rows = random_rows(1200, seed=11, hot_share=0.6)
    expected, state = {}, {}
    for row in sorted(rows, key=lambda r: (r["event_time_ms"], r["transaction_id"])):
        before = state.get(row["account_id"], row["amount"])
        state[row["account_id"]] = expected[row["transaction_id"]] = before * 0.9 + row["amount"] * 0.1
    got = {r.transaction_id: r.ema for r in account_ema(frame(spark, rows), policy=policy).collect()}
    assert got == pytest.approx(expected, rel=1e-12)


@BOTH
@pytest.mark.parametrize("alpha", [0.1, 0.6])
def test_ema_of_amounts_far_apart(spark, alpha, policy):
    """Large amounts weigh many blocks later, and nothing but zeros leaves an average above zero."""
    amounts = [3.0, 1e30, *[0.0] * 1500, 1e-20, 1e40, *[0.0] * 400, 7.0]
    rows = [txn(n, "a", amount=amount) for n, amount in enumerate(amounts)]
    expected, value = {}, amounts[0]
    for row, amount in zip(rows, amounts, strict=True):
        value = (1 - alpha) * value + alpha * amount
        if value > 1e-290:  # with fewer digits below
            expected[row["transaction_id"]] = value
    got = {r.transaction_id: r.ema for r in account_ema(frame(spark, rows), alpha, policy).collect()}
    assert len(got) == len(amounts)
    assert {t: got[t] for t in expected} == pytest.approx(expected, rel=1e-10, abs=0)


@BOTH
def test_version_in_force(spark, policy):
    rng = random.Random(4)
    versions = [(rng.choice("ab"), t, f"v{t}") for t in range(0, 1000, 7)]
    probes = [(n, rng.choice(["a", "a", "b", "none"]), rng.randrange(-5, 1100)) for n in range(400)]
    expected = {
        n: max(((t, v) for k, t, v in versions if k == key and t <= at), default=(None, None))[1] for n, key, at in probes
    }
    left = spark.createDataFrame(probes, "n int, key string, event_time_ms long")
    right = spark.createDataFrame(versions, "key string, valid_from long, label string")
    got = enrich_asof(left, right, "key", "valid_from", policy=policy)
    assert {r.n: r.version.label if r.version else None for r in got.collect()} == expected


@BOTH
@pytest.mark.parametrize("by", [(), ("account_id",)])
def test_lateness_row_by_row(spark, policy, by):
    rng = random.Random(8)
    rows = [(n, rng.choice("xy"), START + n * 1000 - rng.choice([0, 0, 3_000, 9_000, 30_000])) for n in range(300)]
    expected, seen = {}, defaultdict(lambda: None)
    for n, account, at in rows:
        key = account if by else ""
        lag = 0 if seen[key] is None else max(seen[key] - 5_000 - at, 0)
        expected[n] = "on_time" if lag == 0 else "late" if lag <= 10_000 else "dropped"
        seen[key] = at if seen[key] is None else max(seen[key], at)
    df = spark.createDataFrame(rows, "offset long, account_id string, event_time_ms long").repartition(4)
    got = classify_lateness(df, "offset", by=by, policy=policy)
    assert {r.offset: r.lateness for r in got.collect()} == expected
    assert set(expected.values()) == {"on_time", "late", "dropped"}


def test_upsert(spark):
    schema = "k string, a int, b int"
    target = spark.createDataFrame([("x", 1, 1), ("y", 2, 2), (None, 0, 0)], schema)
    updates = spark.createDataFrame([("y", 9, 8, 1), ("y", 7, 6, 2), ("z", 5, 4, 1), (None, 3, 3, 1)], schema + ", at int")
    merged = upsert(target, updates, ["k"], update_cols=["b"], order_col="at")
    assert set(map(tuple, merged.collect())) == {("x", 1, 1), ("y", 2, 6), ("z", 5, 4), (None, 0, 3)}
    again = upsert(merged, updates, ["k"], update_cols=["b"], order_col="at")
    assert set(map(tuple, again.collect())) == set(map(tuple, merged.collect()))
    whole = upsert(target, updates, ["k"], order_col="at")
    assert ("y", 7, 6) in set(map(tuple, whole.collect()))


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("x", 1)], "k string, a int")
    rows = spark.createDataFrame([("x", 5), ("y", 7), ("y", 6)], "k string, a int")
    assert sorted(map(tuple, insert_if_absent(target, rows, ["k"], order_col="a").collect())) == [("x", 1), ("y", 6)]
    once = append_idempotent(target, rows.dropDuplicates(["k"]), ["k"])
    assert append_idempotent(once, rows, ["k"]).count() == once.count() == 2


def test_verdict_checks(spark):
    good = {
        "is_fraud": True,
        "confidence": 0.9,
        "ai_risk_score": 90,
        "classification": "CONFIRMED_FRAUD",
        "reasoning": "r",
        "recommended_actions": ["block"],
    }
    records = {
        "good": good,
        "edge": good | {"confidence": 1, "ai_risk_score": 0},
        "low": good | {"confidence": -0.1},
        "high": good | {"ai_risk_score": 101},
        "label": good | {"classification": "GUILTY"},
        "missing": {k: v for k, v in good.items() if k != "reasoning"},
        "list": good | {"recommended_actions": "block"},
        "number": good | {"ai_risk_score": "many"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("broken", "{"), ("none", None)]
    accepted, rejected = validate_verdicts(spark.createDataFrame(rows, "anomaly_event_id string, value string"))
    assert sorted(r.anomaly_event_id for r in accepted.collect()) == ["edge", "good"]
    assert accepted.where("anomaly_event_id = 'good'").first().recommended_actions == ["block"]
    assert {r.anomaly_event_id: r.reason for r in rejected.collect()} == {
        "low": "confidence out of range",
        "high": "ai_risk_score out of range",
        "label": "classification unknown",
        "missing": "reasoning missing",
        "list": "recommended_actions has the wrong type",
        "number": "ai_risk_score has the wrong type",
        "broken": "not readable",
        "none": "not readable",
    }


@pytest.fixture(scope="module")
def tables(spark):
    """Scored transactions, transactions, accounts, merchants, verdicts, actions."""
    from riskweave.schemas import CASE_ACTION, VERDICT

    merchants, accounts = profiles(spark)
    txns = frame(spark, [txn(1, "us", 250, 1, 2, merchant="hi"), txn(2, "fr", 10, merchant="low", at=5)])
    scored = score_transactions(enrich(txns, merchants, accounts))
    verdicts = spark.createDataFrame([("c1", True, 0.9, 85, "CONFIRMED_FRAUD", "r", ["block"], "m", 150)], VERDICT)
    actions = spark.createDataFrame(
        [("1", "c1", "ESCALATE", None, 160), ("2", "c1", "DENY", "n", 170), ("3", "c1", "APPROVE", None, 170)],
        CASE_ACTION,
    )
    return scored, txns, accounts, merchants, verdicts, actions


@pytest.fixture(scope="module")
def board(spark, tables):
    """Three cases: with verdict and actions, without verdict, and with nothing to look up."""
    from riskweave.schemas import ANOMALY

    anomalies = spark.createDataFrame(
        [
            ("c1", "000001", "us", "AMOUNT_SPIKE", {"z_score": "4.00", "amount": "250.00"}, 100),
            ("c2", "000002", "fr", "VELOCITY", {"txn_count": "11"}, 200),
            ("c3", "gone", "gone", "GEO_TRAVEL", {}, 300),
        ],
        ANOMALY,
    )
    verdicts, actions = tables[4:]
    view = cases.case_view(anomalies, *tables)
    return view, anomalies, verdicts, actions


def test_case_view(board):
    rows = {r.id: r for r in board[0].collect()}
    assert rows["c1"].last_action == "APPROVE" and rows["c1"].ai_analysis.classification == "CONFIRMED_FRAUD"
    assert rows["c2"].ai_analysis is None and rows["c2"].merchant_name == "Pub"
    assert rows["c3"].amount is None and rows["c3"].owner_name is None and rows["c3"].last_action is None


def test_case_pages_and_queues(board):
    view, _, verdicts, _ = board
    assert [r.id for r in cases.case_page(view, limit=2).collect()] == ["c3", "c2"]
    assert [r.id for r in cases.case_page(view, limit=2, offset=2).collect()] == ["c1"]
    assert [r.id for r in cases.pending_cases(view, verdicts, 1).collect()] == ["c2"]


def test_view_of_a_few_cases_equals_the_whole_view(spark, board, tables):
    view, anomalies, verdicts, _ = board
    whole = {r.id: r for r in view.collect()}
    for selected in (
        cases.newest_page(anomalies, 2, 1),
        cases.oldest_pending(anomalies, verdicts, 1),
        cases.one_case(anomalies, "c3"),
        cases.one_case(anomalies, "nope"),
    ):
        few = cases.case_view_of(selected, *tables)
        assert {r.id: r for r in few.collect()} == {r.id: whole[r.id] for r in selected.collect()}


def test_case_detail(board):
    view, _, _, actions = board
    rows = cases.case_detail(view, actions, "c1").collect()
    assert [(r.performed_at_ms, r.action_id) for r in rows] == [(170, "3"), (170, "2"), (160, "1")]
    assert [r.action for r in cases.case_detail(view, actions, "c2").collect()] == [None]
    assert cases.case_detail(view, actions, "nope").count() == 0
    assert [r.id for r in cases.action_history(actions, "c1").collect()] == ["3", "2", "1"]
    one = cases.case_record(view, actions, "c1").first()
    assert [(a.performed_at_ms, a.id) for a in one.case_actions] == [(170, "3"), (170, "2"), (160, "1")]
    assert cases.case_record(view, actions, "c2").first().case_actions == []


def test_case_stats(spark, board):
    _, anomalies, verdicts, _ = board
    row = cases.case_stats(anomalies, verdicts).first()
    assert row.asDict() == {
        "total_events": 3,
        "high_risk_count": 1,
        "pending_review_count": 2,
        "confirmed_fraud_count": 1,
        "analyzed_count": 1,
        "analyzed_pct": 33,
    }
    assert cases.case_stats(anomalies.limit(0), verdicts).first().analyzed_pct == 0


@pytest.mark.parametrize(
    "text, classification, found",
    [("", None, "c1 c2 c3"), ("PUB", None, "c2"), ("spike", None, "c1"), ("00000", None, "c1 c2"), ("ann", "SUSPICIOUS", ""), ("ann", "CONFIRMED_FRAUD", "c1")],
)
def test_case_search(board, text, classification, found):
    assert " ".join(sorted(r.id for r in cases.search_cases(board[0], text, classification).collect())) == found


def test_case_labels_and_brief(board):
    labels = {r.id: (r.verdict_label, r.verdict_band) for r in cases.label_pending(board[0]).collect()}
    assert labels["c1"] == ("CONFIRMED_FRAUD", "critical") and labels["c2"] == ("pending", None)
    briefs = {r.id: r.brief for r in cases.case_brief(board[0]).collect()}
    assert "Amount: 250.00 USD, 25.0% of the credit limit" in briefs["c1"]
    assert "Evidence: amount=250.00, z_score=4.00" in briefs["c1"]
    assert "Amount: 10.00 USD, 0.0% of the credit limit" in briefs["c2"]
    assert "Owner: Unknown, STANDARD, Unknown" in briefs["c3"] and "Location: N/A, N/A" in briefs["c3"]


def test_lists_join_only_what_they_show(board, tables):
    """Labels, shares and classes equal those of the whole view, and join no other table."""
    view, anomalies, verdicts, _ = board
    scored, _, accounts, *_ = tables

    def joins(df):
        return df._jdf.queryExecution().analyzed().toString().count("Join ")

    whole = {r.id: r for r in cases.label_pending(cases.pct_of_limit(view)).collect()}
    lean = cases.label_pending(cases.reviewed(anomalies, verdicts))
    assert {r.id: (r.verdict_label, r.verdict_band) for r in lean.collect()} == {i: (r.verdict_label, r.verdict_band) for i, r in whole.items()}
    shares = cases.pct_of_limit(cases.limits_of(anomalies, scored, accounts))
    assert {r.id: r.pct_of_limit for r in shares.collect()} == {i: r.pct_of_limit for i, r in whole.items()}
    fraud = cases.of_class(anomalies, verdicts, "CONFIRMED_FRAUD")
    assert {r.id for r in fraud.collect()} == {i for i, r in whole.items() if r.classification == "CONFIRMED_FRAUD"}
    assert (joins(lean), joins(fraud)) == (1, 1) and joins(shares) - joins(scored) - joins(accounts) == 2


def test_fraud_rate_counts_windows_without_events(spark):
    scored = spark.createDataFrame([(0,), (1,), (300_000,)], "event_time_ms long")
    anomalies = spark.createDataFrame([(5, "VELOCITY"), (900_000, "VELOCITY")], "detected_at_ms long, reason_code string")
    rates = {r.window_start_ms: r.fraud_rate_pct for r in reports.fraud_rate(scored, anomalies).collect()}
    assert rates == pytest.approx({0: 50.0, 300_000: 0.0, 900_000: 100 / 300 / 0.001})


@pytest.mark.parametrize("name", ["top_categories", "top_merchants", "top_accounts", "spend_timeseries"])
def test_panels_read_recent_rows_only(spark, name):
    """The time bound reaches the scan of the events; no profile is joined for a column of the row itself."""
    from riskweave.plans.queries import REGISTRY, runnable

    plan = runnable(REGISTRY[name])(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "events.parquet" in line]
    assert any("GreaterThanOrEqual(ts," in line for line in scans)
    assert plan.count("supplier.parquet") <= (3 if name in ("top_categories", "spend_timeseries") else 2)
    assert "customer.parquet" not in plan


def test_slots_are_bounded(spark):
    """A slot is a task and a range whose bounds the driver finds, so more rows make larger slots, not ever more of them."""
    rows = spark.range(5000).selectExpr("0 AS _all", "id")
    assert large_keys(rows, ["_all"], SplitPolicy(min_rows=0, slot=1)).slots == SplitPolicy().most_slots
    assert large_keys(rows, ["_all"], SplitPolicy(min_rows=0, slot=1000)).slots == 5
