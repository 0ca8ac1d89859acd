"""Column expressions for times, places and bands of trips."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with minus zero as zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def duration_minutes(start: Column, end: Column, fractional: bool = False) -> Column:
    """Minutes between two times: by second boundaries crossed, or with fractions of seconds."""
    if fractional:
        return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60e6)
    whole = lambda t: F.date_trunc("second", t).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", whole(start), whole(end)) / F.lit(60.0)


def floor_hour(t: Column) -> Column:
    return F.date_trunc("hour", t).cast("timestamp_ntz")


def weekday0(t: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(t)


def date_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def month_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def day_name(t: Column) -> Column:
    """English name of the day."""
    return F.date_format(t, "EEEE")


def is_weekend(day: Column) -> Column:
    return F.when(day.isin(5, 6), 1).otherwise(0)


def same_station(start: Column, end: Column) -> Column:
    """1 where both ids are known and equal."""
    return F.when(F.coalesce(start == end, F.lit(False)), 1).otherwise(0)


def part_of_day(hour: Column) -> Column:
    return F.when(hour.between(5, 10), "morning_peak").when(hour.between(11, 15), "midday").when(hour.between(16, 19), "evening_peak").otherwise("night")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2.0)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    raw = F.degrees(F.atan2(y, x))
    return F.when(raw < 0, raw + 360.0).otherwise(raw)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period."""
    angle = x * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def temperature_band(t: Column) -> Column:
    """Bands closed on the right; the labels are the published ones, though 0, 10, 20 and 30 fall into the lower band."""
    return F.when(t <= 0, "< 0C").when(t <= 10, "0-10C").when(t <= 20, "10-20C").when(t <= 30, "20-30C").when(t > 30, ">= 30C")


def flag(x: Column) -> Column:
    """1 where positive; 0 also for null."""
    return F.when(x > 0, 1).otherwise(0)


def relabel(x: Column, names: dict[str, str]) -> Column:
    """Replace the values named; others stay."""
    out = x
    for old, new in names.items():
        out = F.when(x == old, new).otherwise(out)
    return out
