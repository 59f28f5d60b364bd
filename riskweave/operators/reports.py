"""Dashboard queries. ``as_of_ms`` stands where a live panel would read the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scores import score_band, score_percent
from riskweave.functions.times import HOUR_MS, window_start
from riskweave.params import MINUTE_MS

MIN_RATE = 0.001  # floor of the event rate in the fraud rate (fixed value)


def _recent(spend: DataFrame, dimension: str, as_of_ms: Column | int, lookback_ms: int) -> DataFrame:
    since = F.lit(as_of_ms) - F.lit(lookback_ms)
    recent = spend.where((F.col("dimension") == dimension) & (F.col("window_start_ms") >= since))
    # On a table stored by day only the days in question are listed and read.
    return recent.where(F.col("day") >= F.to_date(F.timestamp_millis(since))) if "day" in spend.columns else recent


def top_spend(
    spend: DataFrame, dimension: str, as_of_ms: Column | int, lookback_ms: int = HOUR_MS, k: int = 20
) -> DataFrame:
    """The ``k`` values of a dimension with the highest spend since ``as_of_ms - lookback_ms``."""
    return (
        _recent(spend, dimension, as_of_ms, lookback_ms)
        .groupBy("dimension_value")
        .agg(F.sum("total_amount").alias("total_spend"), F.sum("txn_count").alias("transaction_count"))
        .orderBy(F.desc("total_spend"), "dimension_value")
        .limit(k)
    )


def spend_timeseries(
    spend: DataFrame, dimension: str, as_of_ms: Column | int, lookback_ms: int = HOUR_MS
) -> DataFrame:
    """Windows of a dimension in time order."""
    return (
        _recent(spend, dimension, as_of_ms, lookback_ms)
        .select(
            F.col("window_start_ms").alias("time_ms"),
            F.col("dimension_value").alias("metric"),
            F.col("total_amount").alias("value"),
        )
        .orderBy("time_ms", "metric")
    )


def _windowed(df: DataFrame, time_col: str, width_ms: int) -> DataFrame:
    return df.withColumn("window_start_ms", window_start(F.col(time_col), width_ms))


def _seconds(width_ms: int) -> Column:
    return F.lit(width_ms / 1000.0)


def anomalies_by_reason(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.groupBy("reason_code")
        .agg(F.count(F.lit(1)).alias("anomaly_count"))
        .orderBy(F.desc("anomaly_count"), "reason_code")
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("classification").agg(F.count(F.lit(1)).alias("verdict_count"))


def scored_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("scored_count"), F.avg("risk_score").alias("avg_risk_score"))


def transaction_count(txns: DataFrame) -> DataFrame:
    return txns.agg(F.count(F.lit(1)).alias("transaction_count"))


def score_bands(scored: DataFrame) -> DataFrame:
    """Transactions per score band."""
    band = score_band(score_percent(F.col("risk_score")))
    return scored.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("txn_count"))


def anomaly_counts(anomalies: DataFrame, width_ms: int = 5 * MINUTE_MS) -> DataFrame:
    """Anomalies per window, in total and by rule."""
    by_rule = {
        "velocity_count": "VELOCITY",
        "amount_spike_count": "AMOUNT_SPIKE",
        "geo_travel_count": "GEO_TRAVEL",
    }
    return (
        _windowed(anomalies, "detected_at_ms", width_ms)
        .groupBy("window_start_ms")
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            *[F.count_if(F.col("reason_code") == code).alias(name) for name, code in by_rule.items()],
        )
    )


def anomaly_rate(anomalies: DataFrame, width_ms: int = MINUTE_MS) -> DataFrame:
    """Anomalies per second by window and rule."""
    return (
        _windowed(anomalies, "detected_at_ms", width_ms)
        .groupBy("window_start_ms", "reason_code")
        .agg((F.count(F.lit(1)) / _seconds(width_ms)).alias("per_second"))
    )


def reason_share(anomalies: DataFrame, width_ms: int = 30 * MINUTE_MS) -> DataFrame:
    """Share of each rule among the anomalies of a window."""
    counts = (
        _windowed(anomalies, "detected_at_ms", width_ms)
        .groupBy("window_start_ms", "reason_code")
        .agg(F.count(F.lit(1)).alias("anomaly_count"))
    )
    # Behind the aggregate a window has one row per rule.
    total = F.sum("anomaly_count").over(Window.partitionBy("window_start_ms"))
    return counts.withColumn("share", F.col("anomaly_count") / total)


def fraud_rate(scored: DataFrame, anomalies: DataFrame, width_ms: int = 5 * MINUTE_MS) -> DataFrame:
    """Anomalies per hundred events and window; both inputs are counted before they meet."""
    events = (
        _windowed(scored, "event_time_ms", width_ms)
        .groupBy("window_start_ms")
        .agg(F.count(F.lit(1)).alias("_events"))
    )
    flags = (
        _windowed(anomalies, "detected_at_ms", width_ms)
        .groupBy("window_start_ms")
        .agg(F.count(F.lit(1)).alias("_flags"))
    )
    both = events.join(flags, "window_start_ms", "full_outer")
    n_events = F.coalesce("_events", F.lit(0))
    n_flags = F.coalesce("_flags", F.lit(0))
    seconds = _seconds(width_ms)
    return both.select(
        "window_start_ms",
        n_events.alias("event_count"),
        n_flags.alias("anomaly_count"),
        (n_flags / seconds * 100 / F.greatest(n_events / seconds, F.lit(MIN_RATE))).alias("fraud_rate_pct"),
    )


def miss_rate(enriched: DataFrame, width_ms: int = MINUTE_MS) -> DataFrame:
    """Share of profile look-ups that found nothing, by window and kind of profile."""
    merchant, account = F.count_if("merchant_miss"), F.count_if("account_miss")
    events = F.count(F.lit(1))
    return (
        _windowed(enriched, "event_time_ms", width_ms)
        .groupBy("window_start_ms")
        .agg(
            events.alias("event_count"),
            merchant.alias("merchant_misses"),
            account.alias("account_misses"),
            ((merchant + account) / events).alias("misses_per_event"),
        )
    )


def enrichment_misses(enriched: DataFrame) -> DataFrame:
    """Look-up misses per missing id and kind."""
    kinds = F.filter(
        F.array(
            F.struct(
                F.lit("MERCHANT").alias("kind"), F.col("merchant_id").alias("id"), F.col("merchant_miss").alias("miss")
            ),
            F.struct(
                F.lit("ACCOUNT").alias("kind"), F.col("account_id").alias("id"), F.col("account_miss").alias("miss")
            ),
        ),
        lambda entry: entry["miss"],
    )
    return enriched.select(F.inline(kinds)).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("miss_count"))


def throughput(df: DataFrame, stage: str, width_ms: int = MINUTE_MS, time_col: str = "event_time_ms") -> DataFrame:
    """Records per second of one stage, by window."""
    return (
        _windowed(df, time_col, width_ms)
        .groupBy("window_start_ms")
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            (F.count(F.lit(1)) / _seconds(width_ms)).alias("per_second"),
        )
        .withColumn("stage", F.lit(stage))
    )


def recent_anomalies(anomalies: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest anomalies."""
    return (
        anomalies.orderBy(F.desc("detected_at_ms"), "id")
        .limit(n)
        .select("detected_at_ms", "transaction_id", "account_id", "reason_code", "evidence")
    )
