"""How late a row is, relative to the watermark at its arrival."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.times import window_start
from riskweave.operators.ordered import LARGEST, SplitPolicy, running
from riskweave.params import LATE_DROP_MS, LATE_TOLERANCE_MS, MINUTE_MS

ON_TIME, LATE, DROPPED = "on_time", "late", "dropped"


def classify_lateness(
    txns: DataFrame,
    arrival_col: str,
    tolerance_ms: int = LATE_TOLERANCE_MS,
    drop_ms: int = LATE_DROP_MS,
    by: tuple[str, ...] = (),
    policy: SplitPolicy = SplitPolicy(),
    seen_ms: int | None = None,
) -> DataFrame:
    """Add watermark_ms, lag_ms and lateness (on_time, late, dropped).

    The watermark trails the largest event time that arrived before the row by ``tolerance_ms``.
    ``arrival_col`` is an integer that grows with arrival (an offset). ``by`` names the columns with
    a watermark of their own, such as the source partition; without it there is one for all rows, which
    are then cut into slots however few they are. ``seen_ms`` is the largest event time before all rows.
    """
    if not by:
        policy = replace(policy, min_rows=0, slot=policy.slot_rows)
    keys = list(by) or ["_all"]
    keyed = txns if by else txns.withColumn("_all", F.lit(0))
    seen = running(keyed, keys, [arrival_col], F.col("event_time_ms"), "_seen", LARGEST, policy)
    watermark = F.greatest("_seen", F.lit(seen_ms).cast("bigint")) - F.lit(tolerance_ms)
    lag = F.greatest(watermark - F.col("event_time_ms"), F.lit(0))
    return (
        seen.withColumn("watermark_ms", watermark)
        .withColumn("lag_ms", F.coalesce(lag, F.lit(0)).cast("bigint"))
        .withColumn(
            "lateness",
            F.when(F.col("lag_ms") == 0, ON_TIME).when(F.col("lag_ms") <= drop_ms, LATE).otherwise(DROPPED),
        )
        .drop("_seen", "_all")
    )


def late_counts(classified: DataFrame, width_ms: int = MINUTE_MS) -> DataFrame:
    """Rows per window and lateness."""
    return classified.groupBy(
        window_start(F.col("event_time_ms"), width_ms).alias("window_start_ms"), "lateness"
    ).agg(F.count(F.lit(1)).alias("row_count"))
