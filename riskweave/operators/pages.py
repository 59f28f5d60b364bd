"""Pages far down a list that is ordered by time, found by counts instead of by sorting all that lies before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.times import HOUR_MS, window_start


def time_counts(rows: DataFrame, time_col: str = "detected_at_ms", width_ms: int = HOUR_MS) -> DataFrame:
    """Rows per ``width_ms``: ``bin_start_ms``, ``row_count``. Kept beside a table, it is some ten thousand rows a year."""
    return rows.groupBy(window_start(F.col(time_col), width_ms).alias("bin_start_ms")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def deep_page(
    rows: DataFrame,
    counts: DataFrame,
    limit: int = 100,
    offset: int = 0,
    time_col: str = "detected_at_ms",
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """The rows of ``newest_page``: newest first, then by id; rows without a time come last.

    ``counts`` are the ``time_counts`` of the same rows with the same width. They tell which bins the page lies in and how many
    rows come before those; three numbers of that reach the driver, and the bounds reach the scan as values. Only the
    rows of the page's bins are sorted. A page beyond the end is empty.
    """
    # A row per hour: a century is less than a million of them.
    newest = Window.orderBy(F.desc_nulls_last("bin_start_ms"))
    running = counts.withColumn("_through", F.sum("row_count").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_through") - F.col("row_count")
    wanted = running.where((F.col("_through") > offset) & (before < offset + limit))
    found = wanted.agg(
        F.min("bin_start_ms").alias("low"),
        F.max("bin_start_ms").alias("high"),
        F.min(before).alias("skipped"),
        F.coalesce(F.bool_or(F.col("bin_start_ms").isNull()), F.lit(False)).alias("untimed"),
    ).first()
    if found["skipped"] is None:
        return rows.limit(0)
    time = F.col(time_col)
    inside = F.lit(False)
    if found["low"] is not None:
        inside = (time >= found["low"]) & (time < found["high"] + width_ms)
    if found["untimed"]:
        inside = inside | time.isNull()
    ordered = rows.where(inside).orderBy(F.desc_nulls_last(time_col), "id")
    return ordered.offset(offset - found["skipped"]).limit(limit)
