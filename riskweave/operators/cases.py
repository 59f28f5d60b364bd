"""Case review: anomalies joined with everything an analyst needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import fixed, label_or_pending, percent_of, score_band
from riskweave.session import store

VERDICT_FIELDS = (
    "is_fraud",
    "confidence",
    "ai_risk_score",
    "classification",
    "reasoning",
    "recommended_actions",
    "model_used",
    "analyzed_at_ms",
)
HIGH_RISK_FROM = 70  # verdict score that counts as high risk (fixed value)
SEARCHED = ("transaction_id", "owner_name", "merchant_name", "reason_code")


def last_action(actions: DataFrame) -> DataFrame:
    """Newest action of each case; equal times are decided by id."""
    return actions.groupBy("anomaly_event_id").agg(
        F.max_by("action", F.struct("performed_at_ms", "id")).alias("last_action")
    )


def case_view(
    anomalies: DataFrame,
    scored: DataFrame,
    txns: DataFrame,
    accounts: DataFrame,
    merchants: DataFrame,
    verdicts: DataFrame,
    actions: DataFrame,
) -> DataFrame:
    """One row per anomaly with transaction, profiles, verdict and last action; all look-ups may miss.

    Anomalies are few among transactions, so both large tables are first cut to the ids in question: Spark
    broadcasts the ids if they are few, and then nothing else of those tables is shuffled. Verdicts without an ``id``
    go by that of their case, of which each has one at most.
    """
    wanted = anomalies.select("transaction_id").distinct()
    scores = scored.select(
        "transaction_id", "merchant_id", "amount", F.col("risk_score").alias("rule_risk_score"), "score_breakdown"
    ).join(wanted, "transaction_id", "left_semi")
    trips = txns.select("transaction_id", "currency", "latitude", "longitude", "event_time_ms").join(
        wanted, "transaction_id", "left_semi"
    )
    owners = accounts.select(
        "account_id",
        "owner_name",
        "tier",
        F.col("country").alias("account_country"),
        "credit_limit",
        F.col("risk_score").alias("account_risk_score"),
    )
    shops = merchants.select(
        "merchant_id",
        F.col("name").alias("merchant_name"),
        F.col("category").alias("merchant_category"),
        F.col("risk_category").alias("merchant_risk_category"),
        F.col("country").alias("merchant_country"),
    )
    verdict_id = F.col("id" if "id" in verdicts.columns else "anomaly_event_id")
    reviews = verdicts.select(
        F.col("anomaly_event_id").alias("id"),
        verdict_id.alias("ai_analysis_id"),
        *VERDICT_FIELDS,
        F.struct(*VERDICT_FIELDS).alias("ai_analysis"),
    )
    latest = last_action(actions).withColumnRenamed("anomaly_event_id", "id")
    return (
        anomalies.join(scores, "transaction_id", "left")
        .join(trips, "transaction_id", "left")
        .join(owners, "account_id", "left")
        .join(shops, "merchant_id", "left")
        .join(reviews, "id", "left")
        .join(latest, "id", "left")
        .select(
            *anomalies.columns,
            *[c for c in scores.columns if c != "transaction_id"],
            *trips.columns[1:],
            *owners.columns[1:],
            *shops.columns[1:],
            *reviews.columns[1:],
            "last_action",
        )
    )


def case_view_of(
    selected: DataFrame,
    scored: DataFrame,
    txns: DataFrame,
    accounts: DataFrame,
    merchants: DataFrame,
    verdicts: DataFrame,
    actions: DataFrame,
) -> DataFrame:
    """``case_view`` of a few anomalies: a page, a queue, one case.

    The other tables are cut to the selected ids before they are joined. ``selected`` usually comes from
    ``newest_page``, ``oldest_pending`` or ``one_case``; it is stored first, as each table needs it, and so
    Spark knows its size: few ids are broadcast and no table is shuffled, more are joined by a shuffle.
    """
    chosen = store(selected, "cases")

    def cut(table: DataFrame, ids: DataFrame, name: str, key: str) -> DataFrame:
        few = ids.select(F.col(name).alias(key)).distinct()
        return table.join(few, key, "left_semi")

    return case_view(
        chosen,
        scored,
        txns,
        cut(accounts, chosen, "account_id", "account_id"),
        merchants,
        cut(verdicts, chosen, "id", "anomaly_event_id"),
        cut(actions, chosen, "id", "anomaly_event_id"),
    )


def newest_page(anomalies: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Anomalies of a page, newest first."""
    return anomalies.orderBy(F.desc("detected_at_ms"), "id").offset(offset).limit(limit)


def oldest_pending(anomalies: DataFrame, verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` oldest anomalies without a verdict."""
    judged = verdicts.select(F.col("anomaly_event_id").alias("id"))
    return anomalies.join(judged, "id", "left_anti").orderBy("detected_at_ms", "id").limit(n)


def one_case(anomalies: DataFrame, case_id: str | Column) -> DataFrame:
    """The anomaly with this id."""
    return anomalies.where(F.col("id") == case_id).limit(1)


def case_page(cases: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of cases, newest first; the same order and bounds as ``newest_page``."""
    return newest_page(cases, limit, offset)


def pending_cases(cases: DataFrame, verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` oldest cases without a verdict."""
    return oldest_pending(cases, verdicts, n)


def action_history(actions: DataFrame, case_id: str | Column) -> DataFrame:
    """Actions of one case, newest first."""
    return actions.where(F.col("anomaly_event_id") == case_id).orderBy(F.desc("performed_at_ms"), F.desc("id"))


def case_detail(cases: DataFrame, actions: DataFrame, case_id: str | Column) -> DataFrame:
    """One case with its actions, newest first: a row per action, or one row if there is none.

    ``case_id`` is a value or a scalar subquery. The history may be long, so it stays a distributed
    result; ``case_record`` nests it for a single reader.
    """
    history = actions.where(F.col("anomaly_event_id") == case_id).select(
        F.col("anomaly_event_id").alias("id"),
        F.col("id").alias("action_id"),
        "action",
        "notes",
        "performed_at_ms",
    )
    return (
        cases.where(F.col("id") == case_id)
        .join(history, "id", "left")
        .orderBy(F.desc("performed_at_ms"), F.desc("action_id"))
    )


def case_record(cases: DataFrame, actions: DataFrame, case_id: str | Column) -> DataFrame:
    """One case in one row, its actions nested as ``case_actions``; for what one reader can read."""
    entry = F.struct("performed_at_ms", "id", "action", "notes")
    history = (
        actions.where(F.col("anomaly_event_id") == case_id)
        .groupBy(F.col("anomaly_event_id").alias("id"))
        .agg(F.sort_array(F.collect_list(entry), asc=False).alias("case_actions"))
    )
    none = F.array().cast(history.schema["case_actions"].dataType)
    return (
        cases.where(F.col("id") == case_id)
        .join(history, "id", "left")
        .withColumn("case_actions", F.coalesce("case_actions", none))
    )


def case_stats(anomalies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counters of the review board, one row."""
    reviews = verdicts.select(
        F.col("anomaly_event_id").alias("id"), "ai_risk_score", "classification", F.lit(True).alias("_judged")
    )
    judged = F.coalesce("_judged", F.lit(False))
    counts = (
        anomalies.select("id")
        .join(reviews, "id", "left")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(F.col("ai_risk_score") >= HIGH_RISK_FROM).alias("high_risk_count"),
            F.count_if(~judged).alias("pending_review_count"),
            F.count_if(F.col("classification") == "CONFIRMED_FRAUD").alias("confirmed_fraud_count"),
            F.count_if(judged).alias("analyzed_count"),
        )
    )
    share = F.round(percent_of(F.col("analyzed_count"), F.col("total_events"))).cast("int")
    return counts.withColumn("analyzed_pct", share)


def search_cases(cases: DataFrame, text: str = "", classification: str | None = None) -> DataFrame:
    """Cases whose transaction, owner, merchant or reason contains ``text``, in any letter case."""
    found = cases if classification is None else cases.where(F.col("classification") == classification)
    if not text:
        return found
    needle = text.lower()
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.lower(F.coalesce(name, F.lit(""))).contains(needle)
    return found.where(hit)


def reviewed(anomalies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Anomalies with the class and score of their verdict, if any: what lists and filters by verdict need."""
    found = verdicts.select(F.col("anomaly_event_id").alias("id"), "classification", "ai_risk_score")
    return anomalies.join(found, "id", "left")


def of_class(anomalies: DataFrame, verdicts: DataFrame, classification: str) -> DataFrame:
    """Anomalies whose verdict has this class, to select cases before anything else is joined."""
    found = verdicts.where(F.col("classification") == classification).select(F.col("anomaly_event_id").alias("id"))
    return anomalies.join(found, "id", "left_semi")


def limits_of(anomalies: DataFrame, scored: DataFrame, accounts: DataFrame) -> DataFrame:
    """Anomalies with the amount of their transaction and the limit of their account."""
    return anomalies.join(scored.select("transaction_id", "amount"), "transaction_id", "left").join(
        accounts.select("account_id", "credit_limit"), "account_id", "left"
    )


def pct_of_limit(cases: DataFrame) -> DataFrame:
    return cases.withColumn("pct_of_limit", percent_of(F.col("amount"), F.col("credit_limit")))


def label_pending(cases: DataFrame) -> DataFrame:
    """Add the label and score band shown in lists."""
    return cases.withColumn("verdict_label", label_or_pending(F.col("classification"))).withColumn(
        "verdict_band", score_band(F.col("ai_risk_score"))
    )


def case_brief(cases: DataFrame) -> DataFrame:
    """Add ``brief``: the case as text for a reviewer."""
    num = F.lit(0.0)
    amount = F.coalesce(F.col("amount").cast("double"), num)
    credit = F.coalesce(F.col("credit_limit").cast("double"), num)

    def text(name: str, default: str = "Unknown") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    def line(label: str, *parts: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), *parts)

    def pairs(name: str) -> Column:
        # Sorted, so that equal maps give equal text.
        entries = F.transform(
            F.array_sort(F.map_entries(name)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )
        return F.coalesce(F.array_join(entries, ", "), F.lit(""))

    brief = F.concat_ws(
        "\n",
        line("Anomaly", text("reason_code"), F.lit(" at "), text("detected_at_ms")),
        line("Evidence", pairs("evidence")),
        line("Transaction", text("transaction_id")),
        line(
            "Amount",
            fixed(amount, 2),
            F.lit(" "),
            text("currency", "USD"),
            F.lit(", "),
            fixed(percent_of(amount, credit), 1),
            F.lit("% of the credit limit"),
        ),
        line("Event time", text("event_time_ms")),
        line("Location", text("latitude", "N/A"), F.lit(", "), text("longitude", "N/A")),
        line("Owner", text("owner_name"), F.lit(", "), text("tier", "STANDARD"), F.lit(", "), text("account_country")),
        line("Credit limit", fixed(credit, 2)),
        line("Account risk", fixed(F.coalesce("account_risk_score", num), 2)),
        line(
            "Merchant",
            text("merchant_name"),
            F.lit(", "),
            text("merchant_category"),
            F.lit(", "),
            text("merchant_country"),
        ),
        line("Merchant risk", text("merchant_risk_category", "UNKNOWN")),
        line("Rule score", fixed(F.coalesce("rule_risk_score", num), 4)),
        line("Score terms", pairs("score_breakdown")),
    )
    return cases.withColumn("brief", brief)
