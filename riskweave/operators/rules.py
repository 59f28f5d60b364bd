"""Per-account anomaly rules in event-time order.

All three rules read one pass over the account's rows, so they share one exchange and one sort.

Velocity counts the rows of the last ``window_ms``. A sliding range frame would re-read its frame for
every row; instead each row enters the count at its time and leaves it just after ``time + window_ms``,
and the count is a running sum of those +1 and -1 marks. Rows with equal time count in arrival order,
which a range frame cannot express either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.geo import elapsed_hours, has_location, haversine_km, speed_kmh
from riskweave.functions.scores import fixed, z_score
from riskweave.operators.ordered import SLOT, SplitPolicy, earlier_slots, large_keys, spread, with_carry
from riskweave.params import RuleParams
from riskweave.schemas import ANOMALY

KEYS = ["account_id"]
ENTERS, LEAVES = 0, 1
FACTS = (
    "recent_count",
    "prior_count",
    "prior_mean",
    "prior_stddev",
    "previous",
)


@dataclass(frozen=True)
class Rule:
    """A rule over the facts of ``account_history``: when it fires and what it reports."""

    code: str
    fires: Callable[[RuleParams], Column]
    evidence: Callable[[RuleParams], Column]


def history_rows(scored: DataFrame, ties: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """What the rules read of a row, in batch and in streams; a missing amount or place counts as zero."""
    numbers = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("amount", "latitude", "longitude")]
    return scored.select("account_id", *ties, "event_time_ms", *numbers, *more)


def account_history(
    scored: DataFrame,
    params: RuleParams = RuleParams(),
    policy: SplitPolicy = SplitPolicy(),
    sequence: str | None = None,
    with_recent: bool = True,
) -> DataFrame:
    """Facts about the account just before each transaction.

    Adds recent_count (rows of the last ``window_ms`` including this one), prior_count, prior_mean and
    prior_stddev of the amounts, and previous (latitude, longitude, event_time_ms of the last located
    row). Order is (event_time_ms, transaction_id); ``sequence`` names a source offset to break ties of
    repeated transaction ids. Without ``with_recent`` the count is left out, which halves the rows sorted.
    """
    ties = ["transaction_id"] + ([sequence] if sequence else [])
    base = history_rows(scored, ties)
    large = large_keys(base, KEYS, policy)
    # The rows are exchanged before their leaving marks are added, which halves what is shuffled.
    whole = (large.others(base) if large else base).repartition(*KEYS)
    columns = ["account_id", *ties, "event_time_ms", "amount", "latitude", "longitude", *FACTS]
    facts = _local_facts(_marked(whole, params, with_recent), KEYS, ties).withColumns(_facts_alone()).select(*columns)
    if large:
        rows = spread(_marked(large.of(base), params, with_recent), KEYS, ["_at", "_mark", *ties], large.slots)
        carried = with_carry(_local_facts(rows, [*KEYS, SLOT], ties), _carry(rows, ties), KEYS)
        facts = facts.unionByName(carried.withColumns(_facts_with_carry()).select(*columns))
    return facts


def _marked(rows: DataFrame, params: RuleParams, with_recent: bool) -> DataFrame:
    """Each row once when it enters the window and, if that is counted, once when it leaves."""
    marks = F.array(F.lit(ENTERS), F.lit(LEAVES)) if with_recent else F.array(F.lit(ENTERS))
    marked = rows.withColumn("_mark", F.explode(marks))
    return marked.withColumn(
        "_at", F.col("event_time_ms") + F.col("_mark") * F.lit(params.window_ms).cast("bigint")
    ).withColumns(_only_on_entry())


def _local_facts(rows: DataFrame, parts: list[str], ties: list[str]) -> DataFrame:
    """Facts from the rows of one window partition only."""
    window = Window.partitionBy(*parts).orderBy("_at", "_mark", *ties)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns(
        {
            "_live": F.sum("_change").over(upto),
            "_n": F.count("_amount").over(before),
            "_mean": F.avg("_amount").over(before),
            "_var": F.var_samp("_amount").over(before),
            "_point": F.last("_located", ignorenulls=True).over(before),
        }
    ).where(F.col("_mark") == ENTERS)


def _only_on_entry() -> dict[str, Column]:
    enters = F.col("_mark") == ENTERS
    point = F.struct("latitude", "longitude", "event_time_ms")
    return {
        "_change": F.when(enters, 1).otherwise(-1),
        "_amount": F.when(enters, F.col("amount")),
        "_located": F.when(enters & has_location(F.col("latitude"), F.col("longitude")), point),
    }


def _carry(rows: DataFrame, ties: list[str]) -> DataFrame:
    """State of each cut account at the start of each of its slots."""
    rank = F.struct("event_time_ms", *ties)
    slots = rows.groupBy(*KEYS, SLOT).agg(
        F.sum("_change").alias("_change"),
        F.count("_amount").alias("_n"),
        F.avg("_amount").alias("_mean"),
        F.var_pop("_amount").alias("_var"),
        F.max_by("_located", F.when(F.col("_located").isNotNull(), rank)).alias("_located"),
    )
    # Means are taken relative to the account's first slot so that large amounts with a small
    # spread keep their digits.
    whole = Window.partitionBy(*KEYS).orderBy(SLOT)
    centred = slots.withColumn(
        "_origin", F.first("_mean", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumns(
        {
            "_shift": F.coalesce(F.col("_n") * (F.col("_mean") - F.col("_origin")), F.lit(0.0)),
            "_square": F.coalesce(
                F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_origin"), F.lit(2.0))), F.lit(0.0)
            ),
        }
    )
    earlier = earlier_slots(KEYS)
    sums = centred.select(
        *KEYS,
        SLOT,
        F.first("_origin", ignorenulls=True).over(earlier).alias("_origin"),
        F.sum("_change").over(earlier).alias("_live_c"),
        F.sum("_n").over(earlier).alias("_n_c"),
        F.sum("_shift").over(earlier).alias("_shift"),
        F.sum("_square").over(earlier).alias("_square"),
        F.last("_located", ignorenulls=True).over(earlier).alias("_point_c"),
    )
    some = F.col("_n_c") > 0
    return sums.select(
        *KEYS,
        SLOT,
        "_live_c",
        "_n_c",
        F.when(some, F.col("_origin") + F.col("_shift") / F.col("_n_c")).alias("_mean_c"),
        F.when(some, F.col("_square") - F.col("_shift") * F.col("_shift") / F.col("_n_c")).alias("_m2_c"),
        "_point_c",
    )


def _facts_alone() -> dict[str, Column]:
    """Facts of rows whose account is in one window partition."""
    return {
        "recent_count": F.col("_live"),
        "prior_count": F.col("_n"),
        "prior_mean": F.col("_mean"),
        "prior_stddev": F.sqrt(F.coalesce("_var", F.lit(0.0))),
        "previous": F.col("_point"),
    }


def _facts_with_carry() -> dict[str, Column]:
    """Facts of rows in a slot: the pairwise update of count, mean and squares with the carry."""
    zero = F.lit(0.0)
    n_local, n_carry = F.col("_n"), F.coalesce("_n_c", F.lit(0))
    n = n_local + n_carry
    gap = F.when((n_local > 0) & (n_carry > 0), F.col("_mean") - F.col("_mean_c")).otherwise(zero)
    squares = (
        F.coalesce(F.col("_var") * (n_local - 1), zero)
        + F.coalesce("_m2_c", zero)
        + F.when(n > 0, gap * gap * n_local * n_carry / n).otherwise(zero)
    )
    return {
        "recent_count": F.col("_live") + F.coalesce("_live_c", F.lit(0)),
        "prior_count": n,
        "prior_mean": F.when(n_carry == 0, F.col("_mean")).otherwise(F.col("_mean_c") + gap * n_local / n),
        "prior_stddev": F.when(n > 1, F.sqrt(F.greatest(squares, zero) / (n - 1))).otherwise(zero),
        "previous": F.coalesce("_point", "_point_c"),
    }


def _text(value: Column) -> Column:
    return value.cast("string")


def _above(value: Column, limit: float) -> Column:
    """A value that is no number is above nothing; Spark orders it above all numbers."""
    return ~F.isnan(value) & (value > limit)


def _spike_z() -> Column:
    return z_score(F.col("amount"), F.col("prior_mean"), F.col("prior_stddev"))


def _trip() -> tuple[Column, Column]:
    """Kilometres and milliseconds from the previous located row."""
    km = haversine_km(F.col("previous.latitude"), F.col("previous.longitude"), F.col("latitude"), F.col("longitude"))
    return km, F.col("event_time_ms") - F.col("previous.event_time_ms")


def _too_fast(params: RuleParams) -> Column:
    km, ms = _trip()
    return (
        has_location(F.col("latitude"), F.col("longitude"))
        & (F.col("previous.event_time_ms") > 0)
        & _above(speed_kmh(km, ms), params.max_kmh)
    )


def _trip_evidence(params: RuleParams) -> Column:
    km, ms = _trip()
    return F.create_map(
        F.lit("distance_km"), fixed(km, 1),
        F.lit("elapsed_hours"), fixed(elapsed_hours(ms), 3),
        F.lit("implied_speed_kmh"), fixed(speed_kmh(km, ms), 1),
        F.lit("max_speed_kmh"), _text(F.lit(float(params.max_kmh))),
        F.lit("prev_lat"), _text(F.col("previous.latitude")),
        F.lit("prev_lon"), _text(F.col("previous.longitude")),
        F.lit("curr_lat"), _text(F.col("latitude")),
        F.lit("curr_lon"), _text(F.col("longitude")),
    )


VELOCITY = Rule(
    "VELOCITY",
    fires=lambda p: F.col("recent_count") > p.max_txn,
    evidence=lambda p: F.create_map(
        F.lit("txn_count"), _text(F.col("recent_count")),
        F.lit("window_ms"), F.lit(str(p.window_ms)),
        F.lit("threshold"), F.lit(str(p.max_txn)),
    ),
)

AMOUNT_SPIKE = Rule(
    "AMOUNT_SPIKE",
    fires=lambda p: (F.col("prior_count") >= p.min_history) & _above(_spike_z(), p.z_threshold),
    evidence=lambda p: F.create_map(
        F.lit("amount"), fixed(F.col("amount"), 2),
        F.lit("mean"), fixed(F.col("prior_mean"), 2),
        F.lit("stddev"), fixed(F.col("prior_stddev"), 2),
        F.lit("z_score"), fixed(_spike_z(), 2),
        F.lit("threshold"), _text(F.lit(float(p.z_threshold))),
    ),
)

GEO_TRAVEL = Rule("GEO_TRAVEL", fires=_too_fast, evidence=_trip_evidence)

DEFAULT_RULES = (VELOCITY, AMOUNT_SPIKE, GEO_TRAVEL)


def apply_rules(
    facts: DataFrame, params: RuleParams, rules: tuple[Rule, ...] = DEFAULT_RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One anomaly row per rule that fires, from the facts of ``account_history``; ``keep`` names facts to add."""
    candidates = [
        F.when(
            rule.fires(params),
            F.struct(F.lit(rule.code).alias("reason_code"), rule.evidence(params).alias("evidence")),
        )
        for rule in rules
    ]
    hits = facts.withColumn("_hit", F.explode(F.array_compact(F.array(*candidates))))
    return hits.select(
        F.concat_ws(":", "transaction_id", "_hit.reason_code").alias("id"),
        "transaction_id",
        "account_id",
        "_hit.reason_code",
        "_hit.evidence",
        F.col("event_time_ms").alias("detected_at_ms"),
        *keep,
    ).select(*ANOMALY.fieldNames(), *keep)


def detect_anomalies(
    scored: DataFrame,
    params: RuleParams = RuleParams(),
    policy: SplitPolicy = SplitPolicy(),
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    sequence: str | None = None,
) -> DataFrame:
    """Anomalies of all rules, one pass over the account histories."""
    needs_recent = any(rule.code == VELOCITY.code or rule not in DEFAULT_RULES for rule in rules)
    facts = account_history(scored, params, policy, sequence, with_recent=needs_recent)
    return apply_rules(facts, params, rules)


def velocity_flags(
    scored: DataFrame, max_txn: int = 10, window_ms: int = 60_000, policy: SplitPolicy = SplitPolicy()
) -> DataFrame:
    return detect_anomalies(scored, RuleParams(max_txn=max_txn, window_ms=window_ms), policy, (VELOCITY,))


def amount_spikes(
    scored: DataFrame, z: float = 3.0, min_history: int = 5, policy: SplitPolicy = SplitPolicy()
) -> DataFrame:
    return detect_anomalies(scored, RuleParams(z_threshold=z, min_history=min_history), policy, (AMOUNT_SPIKE,))


def geo_travel(scored: DataFrame, max_kmh: float = 900.0, policy: SplitPolicy = SplitPolicy()) -> DataFrame:
    return detect_anomalies(scored, RuleParams(max_kmh=max_kmh), policy, (GEO_TRAVEL,))
