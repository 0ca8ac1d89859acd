"""Joins that add weather and stations to trips, and the choice of a weather source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import WEATHER, WEATHER_VALUES, ContractError, require_columns
from ..functions import exprs as X
from ..sources.scratch import Scratch


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in the order given, as an aggregate (no sort of a key's rows)."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return kept.select(*keys, "__row.*").select(*df.columns)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself, or an error if a key repeats."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ContractError(f"keys repeat: {', '.join(keys)}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], checked: bool = True) -> DataFrame:
    """Left join in which null keys match null keys and the right side has each key once.

    The right side is written first, so Spark knows its size: where it is small it is broadcast, and the left side is not
    shuffled; else Spark splits hot keys of the shuffled left side. ``checked`` False takes the right side as it is.
    """
    require_columns(left, keys, "left side")
    require_columns(right, keys, "right side")
    if checked:
        with Scratch(left.sparkSession) as own:
            right = require_unique(own.keep(right, "right-side"), keys)
    same = [left[k].eqNullSafe(right[k]) for k in keys]
    return left.join(right, same, "left").drop(*[right[k] for k in keys])


def normalize_weather(raw: DataFrame, city: Column) -> DataFrame:
    """Provider columns (time, temp, prcp, wspd, snow or snwd, any of them missing) as the weather stage."""
    has = lambda c: F.col(c).cast("double") if c in raw.columns else F.lit(None).cast("double")
    snow = F.coalesce(has("snow"), has("snwd"), F.lit(0.0))
    out = raw.select(
        city.alias("city"), X.floor_hour(F.col("time").cast("timestamp_ntz")).alias("weather_hour"), has("temp").alias("temperature_c"),
        F.coalesce(has("prcp"), F.lit(0.0)).alias("precipitation_mm"), has("wspd").alias("wind_speed_kph"), snow.alias("snow_mm"),
    )
    return out.withColumns({"rain_flag": X.flag(F.col("precipitation_mm")), "snow_flag": X.flag(F.col("snow_mm"))}).select(*WEATHER)


def with_weather(trips: DataFrame, weather: DataFrame, hour: Column | None = None) -> DataFrame:
    """Add the six weather columns by city and hour; trips without weather keep nulls."""
    keyed = trips.withColumn("weather_hour", X.floor_hour(F.col("started_at")) if hour is None else hour)
    joined = join_many_to_one(keyed, weather.select("city", "weather_hour", *WEATHER_VALUES), ["city", "weather_hour"])
    return joined.drop("weather_hour")


def hour_coverage(weather: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per city: hours between two bounds, how many of them have a known temperature, and that share."""
    hours = weather.sparkSession.range(1).select(F.explode(F.sequence(X.floor_hour(start), X.floor_hour(end), F.expr("interval 1 hour"))).alias("weather_hour"))
    wanted = hours.agg(F.count("*").alias("hours_expected"))
    have = weather.where("temperature_c is not null").join(hours, "weather_hour", "left_semi").groupBy("city").agg(F.count_distinct("weather_hour").alias("hours_covered"))
    return have.crossJoin(F.broadcast(wanted)).withColumn("coverage", F.col("hours_covered") / F.col("hours_expected"))  # one row


def choose_source(candidates: DataFrame) -> DataFrame:
    """The candidate (source, coverage_hours, distance_km) with most hours, then the nearest; those without hours don't count."""
    return candidates.where("coverage_hours > 0").orderBy(F.col("coverage_hours").desc(), F.col("distance_km").asc_nulls_last(), "source").limit(1)


def nearby_stations(places: DataFrame, stations: DataFrame, max_km: float = 100.0, most: int = 25) -> DataFrame:
    """For each place (city, lat, lng): the stations (source, lat, lng) within ``max_km``, nearest first, at most ``most``, with ``distance_km``.

    Stations are matched by cells of latitude as high as the limit, so only those of the place's band and its neighbours meet it.
    """
    height = max_km / (math.radians(1) * X.EARTH_KM)
    band = lambda lat: F.floor(F.col(lat) / F.lit(height))
    near = stations.select("source", F.col("lat").alias("st_lat"), F.col("lng").alias("st_lng"), band("lat").alias("band"))
    asked = places.select("*", F.explode(F.array(*[band("lat") + d for d in (-1, 0, 1)])).alias("band"))
    km = X.haversine_km(F.col("lat"), F.col("lng"), F.col("st_lat"), F.col("st_lng"))
    rank = F.row_number().over(Window.partitionBy("city").orderBy("distance_km", "source"))
    return asked.join(near, "band").withColumn("distance_km", km).where(F.col("distance_km") <= max_km).withColumn("rank", rank).where(F.col("rank") <= most).drop("band")


def with_stations(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Inner join of the stations (station_id, station_name, lat, lng) at both ends; a station that repeats is an error."""
    out = trips
    require_unique(stations, ["station_id"])
    for end in ("start", "end"):
        side = stations.select(F.col("station_id").alias(f"{end}_station_id"), F.col("station_name").alias(f"{end}_name"), F.col("lat").alias(f"{end}_st_lat"), F.col("lng").alias(f"{end}_st_lng"))
        out = out.join(side, f"{end}_station_id")
    return out


def extent(trips: DataFrame) -> DataFrame:
    """Per city: the mean place and the first and last start."""
    return trips.groupBy("city").agg(F.avg("start_lat").alias("lat"), F.avg("start_lng").alias("lng"), F.min("started_at").alias("first_start"), F.max("started_at").alias("last_start"))
