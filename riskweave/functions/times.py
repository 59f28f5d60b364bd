"""Event time as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def utc_hour(ms: Column) -> Column:
    """Hour of the day in UTC, whatever the session's time zone."""
    return F.pmod(F.floor(ms / F.lit(HOUR_MS)), F.lit(24))


def window_start(ms: Column, width_ms: int | Column) -> Column:
    """Start of the epoch-aligned tumbling window that holds ``ms``."""
    width = F.lit(width_ms).cast("bigint") if isinstance(width_ms, int) else width_ms
    return ms - F.pmod(ms, width)


# Shapes of numbers; 18 digits always fit a long (fixed values).
WHOLE_NUMBER = r"^\s*[+-]?\d{1,18}\s*$"
DECIMAL_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_millis(text: Column) -> Column:
    """Epoch milliseconds or ISO-8601 text to epoch milliseconds, else null.

    The shape decides which cast is tried, because a failing numeric cast is costly.
    """
    return (
        F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
        .when(text.rlike(DECIMAL_NUMBER), text.try_cast("double").try_cast("bigint"))
        .otherwise(F.unix_millis(text.try_cast("timestamp")))
    )


def if_positive(ms: Column) -> Column:
    """Times that are not after 1970 count as unknown."""
    return F.when(ms > 0, ms)
