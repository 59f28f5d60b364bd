"""Rates of sliding windows at every step, from one count per step instead of one row per row and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.reports import MIN_RATE
from riskweave.params import MINUTE_MS

#: Steps of a block at least. Blocks are summed apart, so no task holds a whole history.
BLOCK_STEPS = 2880


def stepped_counts(
    df: DataFrame, time_col: str, width_ms: int, step_ms: int, by: tuple[str, ...] = (), block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Rows of ``[at_ms - width_ms, at_ms)`` at every multiple of ``step_ms`` where there are any: ``by``, ``at_ms``, ``row_count``.

    The width must be a multiple of the step. Rows without a time lie in no window.

    The rows of a step form a pane, counted before anything moves. A pane raises the count at the next step and lowers
    it when it leaves the window; the running sum of these marks holds until the next mark. A pane whose stay
    crosses the end of a block is one mark pair in each, so blocks need nothing from each other.
    """
    if width_ms % step_ms or width_ms <= 0:
        raise ValueError("the width must be a multiple of the step")
    panes_per_window = width_ms // step_ms
    block = max(block_steps, panes_per_window)  # a stay reaches into one further block at most
    first = F.floor(F.col(time_col) / F.lit(step_ms)).cast("bigint") + 1
    panes = df.where(F.col(time_col).isNotNull()).groupBy(*by, first.alias("_from")).agg(F.count(F.lit(1)).alias("_n"))

    def block_of(step: Column) -> Column:
        return F.floor(step / F.lit(block)).cast("bigint")

    until = F.col("_from") + panes_per_window  # first step without the pane
    next_block = (block_of(F.col("_from")) + 1) * block

    def mark(step: Column, change: Column) -> Column:
        return F.struct(step.alias("_step"), change.alias("_change"))

    gain, loss = F.col("_n"), -F.col("_n")
    marks = F.when(
        until < next_block, F.array(mark(F.col("_from"), gain), mark(until, loss))
    ).otherwise(
        # The rest of the stay starts the next block; what it holds at its end falls away with the block.
        F.when(until == next_block, F.array(mark(F.col("_from"), gain))).otherwise(
            F.array(mark(F.col("_from"), gain), mark(next_block, gain), mark(until, loss))
        )
    )
    changes = (
        panes.select(*by, F.inline(marks))
        .groupBy(*by, "_step")
        .agg(F.sum("_change").alias("_change"))
        .withColumn("_block", block_of(F.col("_step")))
    )
    order = Window.partitionBy(*by, "_block").orderBy("_step")
    end = F.coalesce(F.lead("_step").over(order), (F.col("_block") + 1) * block)
    held = changes.select(*by, "_step", F.sum("_change").over(order).alias("row_count"), end.alias("_end"))
    steps = F.sequence(F.col("_step") * step_ms, (F.col("_end") - 1) * step_ms, F.lit(step_ms).cast("bigint"))
    return held.where(F.col("row_count") > 0).select(*by, F.explode(steps).alias("at_ms"), "row_count")


def stepped_rate(df: DataFrame, time_col: str, width_ms: int, step_ms: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per second over the last ``width_ms`` at every step: ``stepped_counts`` with ``per_second``."""
    counts = stepped_counts(df, time_col, width_ms, step_ms, by)
    return counts.withColumn("per_second", F.col("row_count") / F.lit(width_ms / 1000.0))


def stepped_fraud_rate(
    scored: DataFrame, anomalies: DataFrame, width_ms: int = 5 * MINUTE_MS, step_ms: int = MINUTE_MS // 2
) -> DataFrame:
    """Anomalies per hundred events over the last ``width_ms``, at every step where either occurs."""
    events = stepped_counts(scored, "event_time_ms", width_ms, step_ms).withColumnRenamed("row_count", "_events")
    flags = stepped_counts(anomalies, "detected_at_ms", width_ms, step_ms).withColumnRenamed("row_count", "_flags")
    n_events, n_flags = F.coalesce("_events", F.lit(0)), F.coalesce("_flags", F.lit(0))
    seconds = F.lit(width_ms / 1000.0)
    return events.join(flags, "at_ms", "full_outer").select(
        "at_ms",
        n_events.alias("event_count"),
        n_flags.alias("anomaly_count"),
        (n_flags / seconds * 100 / F.greatest(n_events / seconds, F.lit(MIN_RATE))).alias("fraud_rate_pct"),
    )
