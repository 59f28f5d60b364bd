"""Numbers shown to analysts: percentages, bands, z-scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the score bands, in percent (fixed values).
BANDS = (("critical", 80), ("high", 60), ("medium", 40))
LOWEST_BAND = "low"

PENDING = "pending"


def score_percent(score: Column) -> Column:
    """Rule score 0..1 as a whole percentage; null for a score that is no number."""
    return F.when(~F.isnan(score), F.round(score * 100).cast("int"))


def score_band(percent: Column) -> Column:
    band = None
    for name, floor in BANDS:
        band = F.when(percent >= floor, name) if band is None else band.when(percent >= floor, name)
    return F.when(percent.isNotNull(), band.otherwise(LOWEST_BAND))


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    """Standard score; zero where there is no spread."""
    return F.when(stddev == 0.0, F.lit(0.0)).otherwise((value - mean) / stddev)


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; zero where the whole is zero or unknown."""
    part = F.coalesce(part.cast("double"), F.lit(0.0))
    whole = whole.cast("double")
    return F.when(whole.isNull() | (whole == 0.0), F.lit(0.0)).otherwise(part / whole * 100)


def label_or_pending(label: Column) -> Column:
    return F.coalesce(label, F.lit(PENDING))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", value)
