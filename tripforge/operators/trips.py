"""Cleaning, features and the trip rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import FEATURED, FILTERED, require_columns
from ..functions import exprs as X

RAW = ["rideable_type", "started_at", "ended_at", "start_station_id", "end_station_id", "start_lat", "start_lng", "end_lat", "end_lng", "member_casual", "city"]


@dataclass(frozen=True)
class TripRule:
    """Limits of a trip that is kept; all are strict."""

    min_minutes: float = 1.0
    max_minutes: float = 100.0
    min_km: float = 0.05
    max_km: float = 12.0

    def duration_ok(self) -> Column:
        return (F.col("trip_duration") > self.min_minutes) & (F.col("trip_duration") < self.max_minutes)

    def near_ok(self) -> Column:
        return (F.col("haversine_distance_km") > self.min_km) | (F.col("same_station") == 1)

    def far_ok(self) -> Column:
        return F.col("haversine_distance_km") < self.max_km

    def odd(self) -> Column:
        """Whether one of the outlier flags is set."""
        minutes, km = F.col("trip_duration"), F.col("haversine_distance_km")
        return (minutes <= self.min_minutes) | (minutes >= self.max_minutes) | (km >= self.max_km) | (km <= self.min_km)

    def keep(self) -> Column:
        return self.duration_ok() & self.near_ok() & self.far_ok()


RULE = TripRule()


def type_trips(raw: DataFrame, keep: bool = False) -> DataFrame:
    """Raw columns with their types; what can't be read becomes null. ``keep`` leaves further columns as they are."""
    require_columns(raw, RAW, "raw trips")
    kinds = {"started_at": "timestamp_ntz", "ended_at": "timestamp_ntz"} | dict.fromkeys(["start_lat", "start_lng", "end_lat", "end_lng"], "double")
    more = [F.col(f"`{c}`") for c in raw.columns if keep and c not in RAW]
    return raw.select(*[F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in RAW], *more)


def usable() -> Column:
    """Whether a typed trip has both times and valid coordinates; NaN is beyond every bound."""
    ok = F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()
    for c, limit in (("start_lat", 90.0), ("end_lat", 90.0), ("start_lng", 180.0), ("end_lng", 180.0)):
        ok = ok & F.col(c).between(-limit, limit)
    return ok


def clean_trips(raw: DataFrame, distinct: bool = False, keep: bool = False) -> DataFrame:
    """Typed trips with times and valid coordinates; ``distinct`` drops full-row repeats over all files, ``keep`` keeps columns beyond ``RAW``."""
    out = type_trips(raw, keep).where(usable())
    return out.distinct() if distinct else out


def trip_features(clean: DataFrame, fractional: bool = False) -> DataFrame:
    """The featured stage; ``fractional`` counts fractions of seconds in durations."""
    place = [F.col(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng")]
    hour, day = F.hour("started_at"), X.weekday0(F.col("started_at"))
    hour_sin, hour_cos = X.cyclic(hour, 24)
    out = clean.withColumns({
        "trip_duration": X.duration_minutes(F.col("started_at"), F.col("ended_at"), fractional),
        "same_station": X.same_station(F.col("start_station_id"), F.col("end_station_id")),
        "hour": hour, "day_of_week": day, "month": F.month("started_at"), "is_weekend": X.is_weekend(day), "part_of_day": X.part_of_day(hour),
        "hour_sin": hour_sin, "hour_cos": hour_cos,
        "delta_lat": F.col("end_lat") - F.col("start_lat"), "delta_lng": F.col("end_lng") - F.col("start_lng"),
        "haversine_distance_km": X.haversine_km(*place), "bearing": X.bearing_deg(*place),
    })
    turn = F.radians("bearing")
    return out.withColumns({"bearing_sin": F.sin(turn), "bearing_cos": F.cos(turn)}).select(*FEATURED)


def filter_trips(featured: DataFrame, rule: TripRule = RULE) -> DataFrame:
    """The filtered stage."""
    return featured.where(rule.keep()).select(*FILTERED)


def rule_report(featured: DataFrame, rule: TripRule = RULE) -> DataFrame:
    """One row: totals, and for each part of the rule the rows that break it. Rows on which it is unknown are removed, but break no part."""
    broken = lambda c: F.count_if(~c)
    kept = F.count_if(rule.keep())
    return featured.agg(
        F.count("*").alias("total_rows"), kept.alias("kept_rows"), (F.count("*") - kept).alias("removed_rows"),
        broken(F.col("trip_duration") > rule.min_minutes).alias("too_short"), broken(F.col("trip_duration") < rule.max_minutes).alias("too_long"),
        broken(rule.near_ok()).alias("too_near"), broken(rule.far_ok()).alias("too_far"), broken(rule.keep()).alias("breaks_rule"),
    )


def impact_by_city(featured: DataFrame, rule: TripRule = RULE) -> DataFrame:
    """Per city: rows, rows that break the rule, and their share in per cent."""
    broken = F.count_if(~rule.keep())
    return featured.groupBy("city").agg(F.count("*").alias("total_rows"), broken.alias("removed_rows"), X.rounded(F.lit(100.0) * broken / F.count("*"), 4).alias("removed_pct"))


def with_outlier_flags(featured: DataFrame, rule: TripRule = RULE) -> DataFrame:
    """Add duration_flag and distance_flag; the far limit is looked at first."""
    km, minutes = F.col("haversine_distance_km"), F.col("trip_duration")
    return featured.withColumns({
        "duration_flag": F.when(minutes <= rule.min_minutes, "too_short").when(minutes >= rule.max_minutes, "too_long").otherwise("normal"),
        "distance_flag": F.when(km >= rule.max_km, "too_far").when((km <= rule.min_km) & (F.col("same_station") == 1), "same_station_near_zero")
        .when(km <= rule.min_km, "different_station_near_zero").otherwise("normal"),
    })
