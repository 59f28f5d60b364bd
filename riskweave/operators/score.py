"""Explainable risk score: five additive terms, all computed per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.times import utc_hour
from riskweave.params import Weights
from riskweave.schemas import SCORED

COMPONENTS = ("amount", "merchant_risk", "account_baseline", "time_of_day", "cross_border")


def amount_score(amount: Column, weights: Weights) -> Column:
    """Logarithmic in the amount, full weight from the ceiling on.

    Spark's log1p is null where the function is not finite; those amounts give -Infinity and NaN
    here, as double arithmetic does.
    """
    share = F.least(F.log1p(amount) / F.log1p(F.lit(weights.amount_ceiling)), F.lit(1.0))
    return (
        F.when(amount == -1.0, F.lit(float("-inf")))
        .when((amount < -1.0) | F.isnan(amount), F.lit(float("nan")))
        .otherwise(share * weights.amount)
    )


def merchant_score(risk: Column, weights: Weights) -> Column:
    return (
        F.when(risk == "HIGH", weights.merchant_high)
        .when(risk == "MEDIUM", weights.merchant_medium)
        .otherwise(weights.merchant_other)
    )


def night_score(event_time_ms: Column, weights: Weights) -> Column:
    return F.when(utc_hour(event_time_ms) < weights.night_until_hour, weights.night).otherwise(0.0)


def cross_border_score(merchant_risk: Column, country: Column, weights: Weights) -> Column:
    abroad = ~country.eqNullSafe(F.lit(weights.home_country))
    return F.when((merchant_risk == "HIGH") & abroad, weights.cross_border).otherwise(0.0)


def score_components(enriched: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Add one column ``score_<term>`` per term and the map ``score_breakdown``."""
    terms = {
        "amount": amount_score(F.col("amount"), weights),
        "merchant_risk": merchant_score(F.col("merchant_risk"), weights),
        "account_baseline": F.coalesce(F.col("account_risk"), F.lit(0.0)) * weights.account,
        "time_of_day": night_score(F.col("event_time_ms"), weights),
        "cross_border": cross_border_score(F.col("merchant_risk"), F.col("account_country"), weights),
    }
    scored = enriched.withColumns({f"score_{name}": terms[name] for name in COMPONENTS})
    entries = [part for name in COMPONENTS for part in (F.lit(name), F.col(f"score_{name}"))]
    return scored.withColumn("score_breakdown", F.create_map(*entries))


def total_score() -> Column:
    total = sum((F.col(f"score_{name}") for name in COMPONENTS[1:]), F.col(f"score_{COMPONENTS[0]}"))
    # Spark orders NaN above every number, so least() would hide it.
    return F.when(F.isnan(total), total).otherwise(F.least(total, F.lit(1.0)))


def score_transactions(enriched: DataFrame, weights: Weights = Weights(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Scored record: the transaction without its change code, the profile labels, score and breakdown; ``keep`` adds columns."""
    scored = score_components(enriched, weights).withColumn("risk_score", total_score())
    return scored.select(*SCORED.fieldNames(), *keep)
