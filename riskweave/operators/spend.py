"""Event-time spend aggregates."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.times import to_millis, to_timestamp, window_start
from riskweave.params import SPEND_SPECS, SpendSpec
from riskweave.schemas import SPEND

EVENT_TIME = "event_time"


def spend_by(scored: DataFrame, dimension: str, column: str, width_ms: int) -> DataFrame:
    """Amount and count per value of ``column`` and tumbling window; batch or stream."""
    return spend_union(scored, (SpendSpec(dimension, column, width_ms),))


def spend_union(scored: DataFrame, specs: tuple[SpendSpec, ...] = SPEND_SPECS) -> DataFrame:
    """All roll-ups in one table.

    Batch: every row is expanded to its (dimension, value, window) keys and summed map-side first,
    so the input is scanned once and only partial sums are shuffled. Stream: one watermarked
    aggregate per window length, because state is evicted by the window column; the input must carry
    a watermark on ``event_time``.
    """
    return _stream(scored, specs) if scored.isStreaming else _batch(scored, specs)


def _batch(scored: DataFrame, specs: tuple[SpendSpec, ...]) -> DataFrame:
    keys = [
        F.struct(
            F.lit(spec.dimension).alias("dimension"),
            F.col(spec.column).alias("dimension_value"),
            window_start(F.col("event_time_ms"), spec.width_ms).alias("window_start_ms"),
            F.lit(spec.width_ms).cast("bigint").alias("width_ms"),
        )
        for spec in specs
    ]
    # A single roll-up needs no generator, which filters can't pass.
    expanded = scored.select("amount", F.inline(F.array(*keys))) if len(keys) > 1 else scored.select("amount", keys[0].alias("k")).select("amount", "k.*")
    sums = expanded.groupBy("dimension", "dimension_value", "window_start_ms", "width_ms").agg(
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("txn_count")
    )
    return sums.withColumn("window_end_ms", F.col("window_start_ms") + F.col("width_ms")).select(*SPEND.fieldNames())


def _stream(scored: DataFrame, specs: tuple[SpendSpec, ...]) -> DataFrame:
    by_width = groupby(sorted(specs, key=lambda spec: spec.width_ms), key=lambda spec: spec.width_ms)
    parts = [_stream_of_width(scored, width, tuple(same)) for width, same in by_width]
    return reduce(DataFrame.unionByName, parts)


def _stream_of_width(scored: DataFrame, width_ms: int, specs: tuple[SpendSpec, ...]) -> DataFrame:
    keys = [
        F.struct(F.lit(spec.dimension).alias("dimension"), F.col(spec.column).alias("dimension_value"))
        for spec in specs
    ]
    expanded = scored.select(EVENT_TIME, "amount", F.inline(F.array(*keys)))
    window = F.window(EVENT_TIME, f"{width_ms} milliseconds")
    sums = expanded.groupBy(window, "dimension", "dimension_value").agg(
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("txn_count")
    )
    return sums.select(
        to_millis(F.col("window.start")).alias("window_start_ms"),
        to_millis(F.col("window.end")).alias("window_end_ms"),
        "dimension",
        "dimension_value",
        "total_amount",
        "txn_count",
    )


def with_event_time(df: DataFrame, ms_col: str = "event_time_ms", tolerance: str = "5 seconds") -> DataFrame:
    """Add ``event_time`` and, on a stream, a watermark that trails it by ``tolerance``."""
    timed = df.withColumn(EVENT_TIME, to_timestamp(F.col(ms_col)))
    return timed.withWatermark(EVENT_TIME, tolerance) if df.isStreaming else timed
