"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.geo import elapsed_hours, haversine_km, speed_kmh
from riskweave.functions.scores import z_score
from riskweave.functions.times import HOUR_MS
from riskweave.operators import cases, reports, rules, spend
from riskweave.operators.case_index import CaseIndex
from riskweave.operators.ema import account_ema
from riskweave.operators.enrich import enrich, enrich_accounts, enrich_asof, enrich_merchants
from riskweave.operators.lateness import classify_lateness, late_counts
from riskweave.operators.ordered import SplitPolicy
from riskweave.operators.pages import deep_page, time_counts
from riskweave.operators.panes import stepped_fraud_rate, stepped_rate
from riskweave.operators.score import COMPONENTS, score_components
from riskweave.operators.upsert import append_idempotent, insert_if_absent, upsert
from riskweave.operators.verdicts import validate_verdicts
from riskweave.params import SPEND_SPECS, SpendSpec
from riskweave.plans.fixtures import DAY_MS, PARAMS, Fixture, number
from riskweave.plans.replay import replay_account_state, replay_anomalies, replay_asof, replay_ema, replay_lateness, replay_published, replay_scores, replay_scores_with_profiles, replay_spend, read_profiles
from riskweave.schemas import ACCOUNT_FIELDS, MERCHANT_FIELDS
from riskweave.sources.cdc import DELETE, keep_first_version, parse_cdc, to_accounts, to_merchants, to_transactions, unwrap_cdc
from riskweave.sources.change_stream import with_topic
from riskweave.sources.keyed_table import KeyedTable
from riskweave.sources.sinks import write_by_day
from riskweave.sources.tables import read_table, to_stored
from riskweave.sources.snapshots import latest_per_key, snapshot_plus_changes, versions
from riskweave.session import store, working_dir

Query = Callable[[Fixture], DataFrame]
REGISTRY: dict[str, Query] = {}

DIGITS = 6
# Cuts keys of more than a thousand rows, or of a ten-thousandth of all rows if that is more.
SLOTS = SplitPolicy(min_rows=1000)
CASE_COLUMNS = (
    "id",
    "transaction_id",
    "account_id",
    "reason_code",
    "detected_at_ms",
    "merchant_id",
    "amount",
    "rule_risk_score",
    "currency",
    "latitude",
    "longitude",
    "event_time_ms",
    "owner_name",
    "tier",
    "account_country",
    "credit_limit",
    "account_risk_score",
    "merchant_name",
    "merchant_category",
    "merchant_risk_category",
    "merchant_country",
    "ai_analysis_id",
    "is_fraud",
    "confidence",
    "ai_risk_score",
    "classification",
    "reasoning",
    "analyzed_at_ms",
    "last_action",
)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def runnable(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Fixture(spark, folder))


def r6(column: Column | str) -> Column:
    """Rounded, because engines add doubles in different orders."""
    return F.round(column, DIGITS)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def plain_cases(df: DataFrame, *extra: str) -> DataFrame:
    return rounded(df.select(*CASE_COLUMNS, *extra), "rule_risk_score")


# ---- change logs -----------------------------------------------------------------------------


@query
def cdc_unwrap(fx: Fixture) -> DataFrame:
    """Change records with all their oddities to typed transactions."""
    return to_transactions(unwrap_cdc(fx.envelopes)).drop("topic", "offset")


@query
def cdc_first_versions(fx: Fixture) -> DataFrame:
    """Updates do not count twice: the first record per transaction."""
    log = transaction_log(fx).where(F.col("op") != "d")
    return keep_first_version(log, "ts_ms").select("transaction_id", "amount", "op", "ts_ms")


def transaction_log(fx: Fixture) -> DataFrame:
    """Creates, then updates of some and deletes of some."""
    n = number("transaction_id")
    change = F.struct(F.lit("c").alias("op"), F.lit(0).alias("later_ms"), F.lit(0.0).alias("more"))
    update = F.struct(F.lit("u").alias("op"), F.lit(1000).alias("later_ms"), F.lit(1.0).alias("more"))
    delete = F.struct(F.lit("d").alias("op"), F.lit(2000).alias("later_ms"), F.lit(0.0).alias("more"))
    steps = F.array_compact(F.array(change, F.when(n % 41 == 0, update), F.when(n % 97 == 0, delete)))
    return fx.all_transactions.drop("op").withColumn("_s", F.explode(steps)).select(
        "transaction_id",
        "account_id",
        (F.col("amount") + F.col("_s.more")).alias("amount"),
        F.col("_s.op").alias("op"),
        (F.col("event_time_ms") + F.col("_s.later_ms")).alias("ts_ms"),
    )


@query
def cdc_current_state(fx: Fixture) -> DataFrame:
    return rounded(latest_per_key(transaction_log(fx), "transaction_id", ["ts_ms"]), "amount")


@query
def snapshot_and_changes(fx: Fixture) -> DataFrame:
    """Accounts: initial table, then updates and deletes from the log."""
    log = accounts_log(fx).where(F.col("op") != "r")
    state = snapshot_plus_changes(fx.accounts, log, "account_id", ["ts_ms", "offset"])
    return state.select("account_id", "tier", "country", "credit_limit", "risk_score")


@query
def route_changes(fx: Fixture) -> DataFrame:
    """Records per topic after routing by source table."""
    changes = (
        fx.envelopes.select(F.lit("transactions").alias("table"))
        .unionByName(accounts_records(fx).select(F.lit("accounts").alias("table")))
        .unionByName(merchants_records(fx).select(F.lit("merchants").alias("table")))
        .unionByName(fx.table("nation").select(F.lit("audit").alias("table")))
    )
    return with_topic(changes).groupBy("topic").agg(F.count(F.lit(1)).alias("record_count"))


def merchants_records(fx: Fixture) -> DataFrame:
    return fx.profile_changes(fx.merchants, "merchant_id", "category")


def accounts_records(fx: Fixture) -> DataFrame:
    return fx.profile_changes(fx.accounts, "account_id", "tier")


def accounts_log(fx: Fixture) -> DataFrame:
    return to_accounts(parse_cdc(accounts_records(fx), fields=ACCOUNT_FIELDS))


@query
def latest_merchants(fx: Fixture) -> DataFrame:
    log = to_merchants(parse_cdc(merchants_records(fx), fields=MERCHANT_FIELDS))
    return latest_per_key(log, "merchant_id", ["ts_ms", "offset"]).select(*MERCHANT_FIELDS, "op", "ts_ms")


@query
def latest_accounts(fx: Fixture) -> DataFrame:
    return latest_per_key(accounts_log(fx), "account_id", ["ts_ms", "offset"]).select(*ACCOUNT_FIELDS, "op", "ts_ms")


@query
def profiles_of_topics(fx: Fixture) -> DataFrame:
    """Merchants and accounts of the moment, read from their topics."""
    found = read_profiles(fx)
    merchants = found["merchants"].select(F.lit("merchant").alias("kind"), F.col("merchant_id").alias("id"), F.col("category").alias("label"), "country")
    accounts = found["accounts"].select(F.lit("account").alias("kind"), F.col("account_id").alias("id"), F.col("tier").alias("label"), "country")
    return merchants.unionByName(accounts)


# ---- enrichment and scoring ------------------------------------------------------------------


def enriched(fx: Fixture) -> DataFrame:
    return enrich(fx.transactions, fx.merchants, fx.accounts)


@query
def enrich_transactions(fx: Fixture) -> DataFrame:
    return enriched(fx)


@query
def enrich_merchants_only(fx: Fixture) -> DataFrame:
    return enrich_merchants(fx.transactions, fx.merchants).select(
        "transaction_id", "merchant_name", "merchant_category", "merchant_risk", "merchant_miss"
    )


@query
def enrich_accounts_only(fx: Fixture) -> DataFrame:
    return enrich_accounts(fx.transactions, fx.accounts).select(
        "transaction_id", "account_tier", "account_country", "account_risk", "account_miss"
    )


@query
def enrich_asof_merchants(fx: Fixture) -> DataFrame:
    """The merchant version in force at the time of each transaction."""
    known = versions(
        fx.profile_versions(fx.merchants, "merchant_id", "risk_category"), "merchant_id", "valid_from_ms", ["revision"]
    )
    return enrich_asof(fx.transactions, known, "merchant_id", "valid_from_ms").select(
        "transaction_id", "merchant_id", "event_time_ms", "version.risk_category", "version.valid_from_ms"
    )


@query
def enrichment_misses(fx: Fixture) -> DataFrame:
    return reports.enrichment_misses(enriched(fx))


@query
def score_terms(fx: Fixture) -> DataFrame:
    """The five terms of the score."""
    names = [f"score_{name}" for name in COMPONENTS]
    return rounded(score_components(enriched(fx)).select("transaction_id", *names), *names)


@query
def score_transactions(fx: Fixture) -> DataFrame:
    return rounded(fx.scored.drop("score_breakdown"), "risk_score")


@query
def score_breakdowns(fx: Fixture) -> DataFrame:
    """The entries of the breakdown that goes with each score."""
    entries = fx.scored.select("transaction_id", F.explode("score_breakdown").alias("term", "points"))
    return rounded(entries, "points")


@query
def scored_summary(fx: Fixture) -> DataFrame:
    return rounded(reports.scored_summary(fx.scored), "avg_risk_score")


@query
def transaction_count(fx: Fixture) -> DataFrame:
    return reports.transaction_count(fx.transactions)


@query
def score_bands(fx: Fixture) -> DataFrame:
    return reports.score_bands(fx.scored)


@query
def account_ema_feature(fx: Fixture) -> DataFrame:
    """The average as its logarithm, whose digits do not fall on a rounding tie."""
    return account_ema(fx.transactions).select(
        "account_id", "transaction_id", "event_time_ms", r6(F.log1p("ema")).alias("log_ema")
    )


# ---- rules -----------------------------------------------------------------------------------


def flagged(fx: Fixture, rule: rules.Rule, *keep: str) -> DataFrame:
    recent = rule is rules.VELOCITY
    facts = rules.account_history(fx.transactions, PARAMS, with_recent=recent)
    return rules.apply_rules(facts, PARAMS, (rule,), keep).drop("evidence")


@query
def velocity_flags(fx: Fixture) -> DataFrame:
    return flagged(fx, rules.VELOCITY, "recent_count").withColumnRenamed("recent_count", "txn_count")


@query
def amount_spikes(fx: Fixture) -> DataFrame:
    hits = flagged(fx, rules.AMOUNT_SPIKE, "amount", "prior_count", "prior_mean", "prior_stddev")
    z = z_score(F.col("amount"), F.col("prior_mean"), F.col("prior_stddev"))
    # Means of cents often end in a rounding tie, their logarithm does not.
    measured = hits.withColumns({"z": z, "log_mean": F.log1p("prior_mean")}).drop("prior_mean")
    return rounded(measured, "log_mean", "prior_stddev", "z")


@query
def geo_travel(fx: Fixture) -> DataFrame:
    hits = flagged(fx, rules.GEO_TRAVEL, "latitude", "longitude", "previous")
    km = haversine_km(F.col("previous.latitude"), F.col("previous.longitude"), F.col("latitude"), F.col("longitude"))
    ms = F.col("detected_at_ms") - F.col("previous.event_time_ms")
    measured = hits.withColumns(
        {
            "prev_lat": F.col("previous.latitude"),
            "prev_lon": F.col("previous.longitude"),
            "distance_km": km,
            "hours": elapsed_hours(ms),
            "kmh": speed_kmh(km, ms),
        }
    )
    return measured.drop("previous").withColumns(
        {"distance_km": F.round("distance_km", 4), "hours": F.round("hours", 6), "kmh": F.round("kmh", 3)}
    )


@query
def anomalies_all(fx: Fixture) -> DataFrame:
    return fx.anomalies.withColumn("evidence_keys", F.size("evidence")).drop("evidence")


@query
def anomaly_evidence(fx: Fixture) -> DataFrame:
    """The entries of the evidence as numbers; means of cents end in rounding ties, so those are held against the mean."""
    facts = rules.account_history(fx.transactions, PARAMS)
    hits = rules.apply_rules(facts, PARAMS, keep=("prior_mean",))
    entries = hits.select("id", "prior_mean", F.explode("evidence").alias("entry", "shown"))
    value, mean = F.col("shown").cast("double"), F.col("entry") == "mean"
    return entries.select(
        "id", "entry", F.when(~mean, value).alias("number"), F.when(mean, F.abs(value - F.col("prior_mean")) < 0.0051).alias("close")
    )


@query
def anomalies_hot_account(fx: Fixture) -> DataFrame:
    """The rules where one account holds a third of the rows and is cut into slots."""
    hot = F.when(number("account_id") % 3 == 0, F.lit("hot")).otherwise(F.col("account_id"))
    skewed = fx.transactions.withColumn("account_id", hot)
    return rules.detect_anomalies(skewed, PARAMS, SLOTS).drop("evidence")


@query
def anomalies_by_reason(fx: Fixture) -> DataFrame:
    return reports.anomalies_by_reason(fx.anomalies)


# ---- spend -----------------------------------------------------------------------------------


def spend_of(fx: Fixture, position: int) -> DataFrame:
    spec = SPEND_SPECS[position]
    return rounded(spend.spend_by(fx.scored, spec.dimension, spec.column, spec.width_ms), "total_amount")


@query
def spend_by_category_1m(fx: Fixture) -> DataFrame:
    return spend_of(fx, 0)


@query
def spend_by_merchant_1m(fx: Fixture) -> DataFrame:
    return spend_of(fx, 1)


@query
def spend_by_account_5m(fx: Fixture) -> DataFrame:
    return spend_of(fx, 2)


@query
def spend_union(fx: Fixture) -> DataFrame:
    return rounded(fx.spend, "total_amount")


def recent_spend(fx: Fixture, spec: SpendSpec, lookback_ms: int) -> DataFrame:
    """Sums of the recent rows only: the bound reaches the scan, and profiles are joined only for their columns."""
    since = F.expr(f"timestamp_ntz'{fx.last_event - timedelta(milliseconds=lookback_ms)}'")
    recent = fx.as_transactions(fx.table("events").where(F.col("ts") >= since)).where(F.col("op") != DELETE)
    rows = recent if spec.column in recent.columns else enrich_merchants(recent, fx.merchants)
    return spend.spend_by(rows, spec.dimension, spec.column, spec.width_ms)


def top_of(fx: Fixture, dimension: str, name: str, k: int) -> DataFrame:
    # Events are sparse, so the panels look back a day instead of an hour here.
    spec = next(s for s in SPEND_SPECS if s.dimension == dimension)
    sums = recent_spend(fx, spec, DAY_MS)
    top = reports.top_spend(sums, dimension, fx.as_of_ms, DAY_MS, k)
    return rounded(top.withColumnRenamed("dimension_value", name), "total_spend")


@query
def top_categories(fx: Fixture) -> DataFrame:
    return top_of(fx, "CATEGORY", "category", 20).drop("transaction_count")


@query
def top_merchants(fx: Fixture) -> DataFrame:
    return top_of(fx, "MERCHANT", "merchant", 10).drop("transaction_count")


@query
def top_accounts(fx: Fixture) -> DataFrame:
    return top_of(fx, "ACCOUNT", "account_id", 20)


@query
def spend_timeseries(fx: Fixture) -> DataFrame:
    spec = SpendSpec("CATEGORY", "merchant_category", SPEND_SPECS[0].width_ms)
    sums = recent_spend(fx, spec, 24 * HOUR_MS)
    return rounded(reports.spend_timeseries(sums, "CATEGORY", fx.as_of_ms, 24 * HOUR_MS), "value")


@query
def top_categories_stored(fx: Fixture) -> DataFrame:
    """The panel over a stored table of sums, of which only the days in question are read."""
    folder = working_dir(fx.spark, "panels")
    write_by_day(to_stored(fx.spend), f"{folder}/spend_by_window", "window_start_ms", ("dimension",))
    sums = read_table(fx.spark, "spend_by_window", folder)
    now = int((fx.last_event - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    top = reports.top_spend(sums, "CATEGORY", now, DAY_MS, 20)
    return top.select(F.col("dimension_value").alias("category"), r6(F.col("total_spend").cast("double")).alias("total_spend"))


# ---- cases -----------------------------------------------------------------------------------


def case_rows(fx: Fixture, selected: DataFrame | None = None) -> DataFrame:
    """The case view, of all anomalies or of a few."""
    tables = (fx.scored, fx.transactions, fx.accounts, fx.merchants, fx.verdicts, fx.actions)
    if selected is None:
        return cases.case_view(fx.anomaly_table, *tables)
    return cases.case_view_of(selected, *tables)


@query
def case_view(fx: Fixture) -> DataFrame:
    return plain_cases(case_rows(fx))


@query
def case_page(fx: Fixture) -> DataFrame:
    return plain_cases(case_rows(fx, cases.newest_page(fx.anomaly_table, limit=100, offset=20)))


@query
def case_page_lookup(fx: Fixture) -> DataFrame:
    """A page of cases from keyed tables, of which only the buckets with wanted ids are read."""
    page = store(cases.newest_page(fx.anomaly_table, limit=100, offset=20), "page")
    tables = []
    for name, rows in (("scored", fx.scored), ("transactions", fx.transactions)):
        table = keyed_table(fx, f"lookup-{name}", rows, ("transaction_id",), ("event_time_ms",))
        table.write(rows, 0)
        tables.append(table.look_up(page))
    return plain_cases(cases.case_view_of(page, *tables, fx.accounts, fx.merchants, fx.verdicts, fx.actions))


def busiest_case(fx: Fixture) -> Column:
    """Id of the newest case with three actions."""
    newest = F.max_by("id", F.struct("detected_at_ms", "id")).alias("id")
    return fx.anomaly_table.where(number("transaction_id") % 4 == 3).agg(newest).scalar()


@query
def case_detail(fx: Fixture) -> DataFrame:
    wanted = busiest_case(fx)
    detail = cases.case_detail(case_rows(fx, cases.one_case(fx.anomaly_table, wanted)), fx.actions, wanted)
    return plain_cases(detail, "action_id", "action", "notes", "performed_at_ms")


@query
def case_record(fx: Fixture) -> DataFrame:
    """One case in one row; its nested actions, newest first, are shown as text."""
    wanted = busiest_case(fx)
    record = cases.case_record(case_rows(fx, cases.one_case(fx.anomaly_table, wanted)), fx.actions, wanted)
    parts = F.transform("case_actions", lambda a: F.concat_ws("|", a["performed_at_ms"].cast("string"), a["id"].cast("string"), a["action"], a["notes"]))
    return plain_cases(record.withColumn("actions_text", F.array_join(parts, ";")), "actions_text")


@query
def action_history(fx: Fixture) -> DataFrame:
    return cases.action_history(fx.actions, busiest_case(fx))


@query
def case_last_action(fx: Fixture) -> DataFrame:
    return cases.last_action(fx.actions)


@query
def pending_cases(fx: Fixture) -> DataFrame:
    return plain_cases(case_rows(fx, cases.oldest_pending(fx.anomaly_table, fx.verdicts, 10)))


@query
def case_stats(fx: Fixture) -> DataFrame:
    return cases.case_stats(fx.anomaly_table, fx.verdicts)


@query
def case_search(fx: Fixture) -> DataFrame:
    wanted = cases.of_class(fx.anomaly_table, fx.verdicts, "SUSPICIOUS")
    return plain_cases(cases.search_cases(case_rows(fx, wanted), "SPIKE"))


@query
def case_search_index(fx: Fixture) -> DataFrame:
    """Search of all cases through stored trigrams."""
    rows = plain_cases(case_rows(fx))
    index = CaseIndex(fx.spark, working_dir(fx.spark, "case-index"), rows.schema)
    index.write(rows)
    return index.search("Geo_TRA")


@query
def case_deep_page(fx: Fixture) -> DataFrame:
    """A page behind a third of all cases; what lies before it is counted, not sorted."""
    table = fx.anomaly_table
    counts = time_counts(table)
    behind = table.count() // 3
    return plain_cases(case_rows(fx, deep_page(table, counts, limit=100, offset=behind)))


@query
def case_labels(fx: Fixture) -> DataFrame:
    labelled = cases.label_pending(cases.reviewed(fx.anomaly_table, fx.verdicts))
    return labelled.select("id", "verdict_label", "verdict_band")


@query
def case_brief(fx: Fixture) -> DataFrame:
    """Text for reviewers; formatted numbers differ between engines at ties, so there is no oracle."""
    return cases.case_brief(case_rows(fx)).select("id", "brief")


@query
def pct_of_limit(fx: Fixture) -> DataFrame:
    limits = cases.limits_of(fx.anomaly_table, fx.scored, fx.accounts)
    shares = cases.pct_of_limit(limits).select("id", "amount", "credit_limit", "pct_of_limit")
    # Finite shares have seven decimals at most, so the eighth is never a rounding tie.
    return shares.withColumn("pct_of_limit", F.round("pct_of_limit", 8))


@query
def recent_anomalies(fx: Fixture) -> DataFrame:
    return reports.recent_anomalies(fx.anomaly_table, 50).drop("evidence")


@query
def verdict_counts(fx: Fixture) -> DataFrame:
    return reports.verdict_counts(fx.verdicts)


def raw_verdicts(fx: Fixture) -> DataFrame:
    """Verdicts as JSON text, some of them damaged."""
    n = number("_t")
    rows = fx.verdicts.withColumn("_t", F.split("anomaly_event_id", ":")[0])
    body = F.struct(
        "is_fraud",
        F.when(n % 7 == 1, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(n % 11 == 2, F.lit(101)).otherwise(F.col("ai_risk_score")).alias("ai_risk_score"),
        F.when(n % 13 == 3, F.lit("GUILTY")).otherwise(F.col("classification")).alias("classification"),
        F.when(n % 17 != 4, F.col("reasoning")).alias("reasoning"),
        "recommended_actions",
    )
    text = F.to_json(body)
    return rows.select("anomaly_event_id", F.when(n % 19 == 5, F.substring(text, 1, 30)).otherwise(text).alias("value"))


@query
def verdict_validate(fx: Fixture) -> DataFrame:
    """Accepted and rejected verdicts with the reason."""
    accepted, rejected = validate_verdicts(raw_verdicts(fx))
    return accepted.select("anomaly_event_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("anomaly_event_id", F.col("reason").alias("outcome"))
    )


# ---- rates -----------------------------------------------------------------------------------


@query
def anomaly_counts_5m(fx: Fixture) -> DataFrame:
    return reports.anomaly_counts(fx.anomalies)


@query
def anomaly_rate_1m(fx: Fixture) -> DataFrame:
    return rounded(reports.anomaly_rate(fx.anomalies), "per_second")


@query
def reason_share_30m(fx: Fixture) -> DataFrame:
    return rounded(reports.reason_share(fx.anomalies), "share")


@query
def fraud_rate_5m(fx: Fixture) -> DataFrame:
    return rounded(reports.fraud_rate(fx.transactions, fx.anomalies), "fraud_rate_pct")


@query
def anomaly_rate_stepped(fx: Fixture) -> DataFrame:
    """Anomalies per second of the last five minutes by rule, every 30 seconds."""
    rates = stepped_rate(fx.anomalies, "detected_at_ms", 300_000, 30_000, ("reason_code",))
    return rounded(rates, "per_second")


@query
def fraud_rate_stepped(fx: Fixture) -> DataFrame:
    return rounded(stepped_fraud_rate(fx.transactions, fx.anomalies), "fraud_rate_pct")


@query
def miss_rate_1m(fx: Fixture) -> DataFrame:
    return rounded(reports.miss_rate(enriched(fx)), "misses_per_event")


@query
def throughput_1m(fx: Fixture) -> DataFrame:
    """Records per second into scoring, and out of the anomaly rules."""
    both = reports.throughput(fx.transactions, "score").unionByName(
        reports.throughput(fx.anomalies, "anomaly", time_col="detected_at_ms")
    )
    return rounded(both, "per_second")


def arrivals(fx: Fixture) -> DataFrame:
    """Transactions with a log position; some arrive seconds late and some minutes late."""
    n = number("transaction_id")
    delay = F.when(n % 10 == 3, 12_000).when(n % 10 == 6, 900_000).otherwise(0)
    return fx.transactions.select(
        "transaction_id", "account_id", n.alias("offset"), (F.col("event_time_ms") - delay).alias("event_time_ms")
    )


@query
def lateness_buckets(fx: Fixture) -> DataFrame:
    """Lateness of each row against one watermark for the whole log."""
    return classify_lateness(arrivals(fx), "offset")


@query
def lateness_in_slots(fx: Fixture) -> DataFrame:
    """The same with the log cut into slots, as any large log is."""
    return classify_lateness(arrivals(fx), "offset", policy=SLOTS)


@query
def lateness_by_account(fx: Fixture) -> DataFrame:
    """Lateness against one watermark per account."""
    return classify_lateness(arrivals(fx), "offset", by=("account_id",))


@query
def late_counts_1h(fx: Fixture) -> DataFrame:
    return late_counts(classify_lateness(arrivals(fx), "offset"), HOUR_MS)


# ---- keyed writes ----------------------------------------------------------------------------


@query
def upsert_scored(fx: Fixture) -> DataFrame:
    """Rescoring changes the score and leaves the amount as it was stored."""
    n = number("transaction_id")
    scores = fx.scored.select("transaction_id", "amount", "risk_score", "event_time_ms")
    stored = scores.where(n % 3 != 0)
    again = scores.where(n % 2 == 0).select(
        "transaction_id",
        (F.col("amount") + 1000).alias("amount"),
        (F.col("risk_score") / 4).alias("risk_score"),
        "event_time_ms",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"),
    )
    again = again.withColumn("risk_score", F.col("risk_score") * F.col("attempt"))
    merged = upsert(stored, again, ["transaction_id"], update_cols=["risk_score"], order_col="attempt")
    return rounded(merged, "amount", "risk_score")


@query
def upsert_spend(fx: Fixture) -> DataFrame:
    """Windows that were written before are replaced as a whole."""
    sums = spend.spend_by(fx.scored, "CATEGORY", "merchant_category", SPEND_SPECS[0].width_ms)
    early = sums.where(F.col("txn_count") == 1).withColumn("total_amount", F.lit(0.0))
    keys = ["window_start_ms", "window_end_ms", "dimension", "dimension_value"]
    return rounded(upsert(early, sums, keys, order_col="txn_count"), "total_amount")


@query
def upsert_verdicts(fx: Fixture) -> DataFrame:
    """A second verdict on a case replaces the first."""
    cols = ["anomaly_event_id", "ai_risk_score", "classification", "analyzed_at_ms"]
    first = fx.verdicts.select(*cols)
    second = first.where(F.col("ai_risk_score") % 2 == 0).select(
        "anomaly_event_id",
        (F.lit(100) - F.col("ai_risk_score")).alias("ai_risk_score"),
        F.lit("UNKNOWN").alias("classification"),
        (F.col("analyzed_at_ms") + 60_000).alias("analyzed_at_ms"),
    )
    return upsert(first, second, ["anomaly_event_id"], order_col="analyzed_at_ms")


@query
def append_anomalies(fx: Fixture) -> DataFrame:
    """A replayed batch of anomalies adds only what was not written."""
    columns = ["id", "transaction_id", "account_id", "reason_code", "detected_at_ms"]
    rows = fx.anomaly_table.select(*columns)
    written = rows.where(number("transaction_id") % 2 == 0)
    return append_idempotent(written, rows, ["transaction_id", "reason_code", "detected_at_ms"])


@query
def append_case_actions(fx: Fixture) -> DataFrame:
    columns = ["id", "anomaly_event_id", "action", "notes", "performed_at_ms"]
    rows = fx.actions.select(*columns)
    return append_idempotent(rows.where(F.col("notes") == "step 1"), rows, ["id"])


@query
def insert_absent(fx: Fixture) -> DataFrame:
    """Transactions that are stored already are not inserted again."""
    n = number("transaction_id")
    rows = fx.transactions.select("transaction_id", "account_id", "amount", "event_time_ms")
    stored = rows.where(n % 3 == 0)
    new = rows.where(n % 2 == 0).withColumn("amount", F.lit(-1.0))
    return insert_if_absent(stored, new, ["transaction_id"])


# ---- streams ---------------------------------------------------------------------------------


@query
def stream_score(fx: Fixture) -> DataFrame:
    return rounded(replay_scores(fx).drop("score_breakdown"), "risk_score")


@query
def stream_spend(fx: Fixture) -> DataFrame:
    return rounded(replay_spend(fx), "total_amount")


@query
def stream_anomalies(fx: Fixture) -> DataFrame:
    return replay_anomalies(fx).withColumn("evidence_keys", F.size("evidence")).drop("evidence")


@query
def stream_published_anomalies(fx: Fixture) -> DataFrame:
    """Anomalies as the publishing sink has them."""
    return replay_published(fx).select("key", "topic", "id", "transaction_id", "reason_code", "detected_at_ms", F.size("evidence").alias("evidence_keys"))


@query
def stream_score_profiles(fx: Fixture) -> DataFrame:
    """Scores against profiles that other streams keep current."""
    return rounded(replay_scores_with_profiles(fx).drop("score_breakdown"), "risk_score")


@query
def stream_asof_merchants(fx: Fixture) -> DataFrame:
    """The merchant version in force at each transaction, where both are streams."""
    rows = replay_asof(fx, fx.profile_versions(fx.merchants, "merchant_id", "risk_category"))
    return rows.select(
        "transaction_id", "merchant_id", "event_time_ms", "version.risk_category", F.col("version.ts_ms").alias("valid_from_ms")
    )


@query
def stream_lateness(fx: Fixture) -> DataFrame:
    """On-time, late and dropped rows of a running job."""
    return replay_lateness(fx, arrivals(fx))


@query
def stream_ema(fx: Fixture) -> DataFrame:
    """The moving average, continued from micro-batch to micro-batch."""
    return replay_ema(fx).select("account_id", "transaction_id", "event_time_ms", r6(F.log1p("ema")).alias("log_ema"))


@query
def stream_account_state(fx: Fixture) -> DataFrame:
    """The state of every account after the last micro-batch of the anomaly job."""
    total = F.round(F.col("amount_mean") * F.col("amount_count"), 2)  # amounts have two digits, so sums have no ties
    return rounded(replay_account_state(fx).withColumn("amount_sum", total).drop("amount_mean"), "amount_stddev")


# ---- keyed tables ----------------------------------------------------------------------------


def keyed_table(fx: Fixture, name: str, like: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], **rules) -> KeyedTable:
    columns = ", ".join(f"{c} {t}" for c, t in like.dtypes)
    return KeyedTable(fx.spark, working_dir(fx.spark, name), columns, keys, order, **rules)


def written_twice(table: KeyedTable, first: DataFrame, second: DataFrame) -> DataFrame:
    """Two writes, the second of which is repeated."""
    for write_id, rows in ((0, first), (1, second), (1, second)):
        table.write(rows, write_id)
    return table.read()


@query
def keyed_scored(fx: Fixture) -> DataFrame:
    """Rescoring as a write to the buckets it touches."""
    n = number("transaction_id")
    scores = fx.scored.select("transaction_id", "amount", "risk_score", "event_time_ms", F.lit(0).alias("attempt"))
    again = scores.where(n % 2 == 0).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns(
        {"amount": F.col("amount") + 1000, "risk_score": F.col("risk_score") / 4 * F.col("attempt")}
    )
    table = keyed_table(fx, "keyed-scored", scores, ("transaction_id",), ("attempt",), update_cols=("risk_score", "attempt"))
    return rounded(written_twice(table, scores.where(n % 3 != 0), again).drop("attempt"), "amount", "risk_score")


@query
def keyed_spend(fx: Fixture) -> DataFrame:
    """Windows that were written before are replaced as a whole."""
    sums = spend.spend_by(fx.scored, "CATEGORY", "merchant_category", SPEND_SPECS[0].width_ms)
    early = sums.where(F.col("txn_count") == 1).withColumn("total_amount", F.lit(0.0))
    keys = ("window_start_ms", "window_end_ms", "dimension", "dimension_value")
    table = keyed_table(fx, "keyed-spend", sums, keys, ("txn_count",))
    return rounded(written_twice(table, early, sums), "total_amount")


@query
def keyed_verdicts(fx: Fixture) -> DataFrame:
    """A second verdict on a case replaces the first; an older one that comes later doesn't."""
    first = fx.verdicts.select("anomaly_event_id", "ai_risk_score", "classification", "analyzed_at_ms")
    changed = first.where(F.col("ai_risk_score") % 2 == 0).withColumns(
        {
            "ai_risk_score": F.lit(100) - F.col("ai_risk_score"),
            "classification": F.lit("UNKNOWN"),
            "analyzed_at_ms": F.col("analyzed_at_ms") + 60_000,
        }
    )
    stale = first.withColumns({"classification": F.lit("STALE"), "analyzed_at_ms": F.col("analyzed_at_ms") - 1})
    table = keyed_table(fx, "keyed-verdicts", first, ("anomaly_event_id",), ("analyzed_at_ms",))
    return written_twice(table, first, changed.unionByName(stale))
