"""Distance and speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
MS_PER_HOUR = 3_600_000.0
LEAST_HOURS = 1e-9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance between two points given in degrees."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    # Rounding can lift the chord of two opposite points above 1.
    # What is no number or unknown stays so; least() would hide it.
    chord = F.when(F.isnan(chord) | chord.isNull(), chord).otherwise(F.least(chord, F.lit(1.0)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def elapsed_hours(ms: Column) -> Column:
    """Milliseconds as hours, never zero or negative."""
    return F.greatest(ms / F.lit(MS_PER_HOUR), F.lit(LEAST_HOURS))


def speed_kmh(km: Column, ms: Column) -> Column:
    """Speed that covers ``km`` in ``ms`` milliseconds."""
    return km / elapsed_hours(ms)


def has_location(latitude: Column, longitude: Column) -> Column:
    """The point 0/0 stands for a missing location."""
    return ~((latitude == 0.0) & (longitude == 0.0))
