"""Trips and hourly weather derived from the driver tables, as ``FIXTURES.md`` specifies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import WEATHER
from ..functions import exprs as X
from ..operators.trips import clean_trips, filter_trips, trip_features
from ..session import limit_methods

CITY = {"F": "chicago", "O": "nyc", "P": "london"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(column: str, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def raw_trips(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The trip proxy; ``more`` names further columns to keep."""
    limit_methods(spark)
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s = F.pmod(F.col("o_orderkey") * 7919 + F.col("l_partkey") * 104729, F.lit(86400))
    d = F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 13, F.lit(7200))
    e = F.pmod(F.col("l_suppkey") + F.pmod("l_partkey", F.lit(12)), F.lit(100))
    seconds = lambda n: F.expr("interval '1' second") * n
    sup = F.col("l_suppkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _named("l_returnflag", {"N": "classic_bike", "R": "electric_bike", "A": "docked_bike"}).alias("rideable_type"),
        (F.col("o_orderdate") + seconds(s)).alias("started_at"),
        (F.col("o_orderdate") + seconds(s + d)).alias("ended_at"),
        F.when(F.col("l_linenumber") != 7, sup.cast("string")).alias("start_station_id"),
        e.cast("string").alias("end_station_id"),
        (F.lit(41.80) + F.pmod(sup, F.lit(10)) * F.lit(0.013)).alias("start_lat"),
        (F.lit(-87.70) + F.floor(sup / F.lit(10)) * F.lit(0.017)).alias("start_lng"),
        F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1), F.lit(95.0)).otherwise(F.lit(41.80) + F.pmod(e, F.lit(10)) * F.lit(0.013)).alias("end_lat"),
        F.when(~((F.col("l_quantity") == 49) & (F.col("l_linenumber") == 2)), F.lit(-87.70) + F.floor(e / F.lit(10)) * F.lit(0.017)).alias("end_lng"),
        _named("l_linestatus", {"O": "member", "F": "casual"}).alias("member_casual"),
        _named("o_orderstatus", CITY).alias("city"),
        *more,
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trip_features(clean_trips(raw_trips(spark, sf_dir)))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_trips(featured(spark, sf_dir))


def weather_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather rows before one is chosen per city and hour; event_id decides among them."""
    value = F.col("value")
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "purchase"))
    return ev.select(
        _named("event_type", {"click": "chicago", "error": "nyc", "purchase": "london"}).alias("city"),
        X.floor_hour(F.col("ts")).alias("weather_hour"),
        (value / F.lit(10.0) - F.lit(10.0)).alias("temperature_c"),
        F.when(value > 100, value / F.lit(100.0)).otherwise(F.lit(0.0)).alias("precipitation_mm"),
        F.when(F.pmod("event_id", F.lit(17)) != 0, value / F.lit(20.0)).alias("wind_speed_kph"),
        F.when(value > 300, F.lit(1.0)).otherwise(F.lit(0.0)).alias("snow_mm"),
        "event_id",
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import first_by

    rows = first_by(weather_observations(spark, sf_dir), ["city", "weather_hour"], ["event_id"])
    return rows.withColumns({"rain_flag": X.flag(F.col("precipitation_mm")), "snow_flag": X.flag(F.col("snow_mm"))}).select(*WEATHER)


def trips_with_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned trips keyed into the 30 days that the weather covers."""
    seconds = F.pmod(F.col("o_orderkey") * 7919 + F.col("l_partkey") * 104729, F.lit(2592000))
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.expr("interval '1' second") * seconds
    rows = raw_trips(spark, sf_dir, ("o_orderkey", "l_partkey"))
    return rows.withColumn("weather_hour", X.floor_hour(at)).drop("o_orderkey", "l_partkey")


#: DuckDB: t raw trips, c cleaned, f featured, k filtered.
SQL_TRIPS = """
t as (
  select case l_returnflag when 'N' then 'classic_bike' when 'R' then 'electric_bike' when 'A' then 'docked_bike' end as rideable_type,
    o_orderdate + to_seconds((o_orderkey * 7919 + l_partkey * 104729) % 86400) as started_at,
    o_orderdate + to_seconds((o_orderkey * 7919 + l_partkey * 104729) % 86400 + (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 13) % 7200) as ended_at,
    case when l_linenumber <> 7 then l_suppkey::varchar end as start_station_id, e::varchar as end_station_id,
    41.80e0 + (l_suppkey % 10) * 0.013e0 as start_lat, -87.70e0 + floor(l_suppkey / 10.0e0) * 0.017e0 as start_lng,
    case when l_quantity = 50 and l_linenumber = 1 then 95.0e0 else 41.80e0 + (e % 10) * 0.013e0 end as end_lat,
    case when l_quantity = 49 and l_linenumber = 2 then null else -87.70e0 + floor(e / 10.0e0) * 0.017e0 end as end_lng,
    case l_linestatus when 'O' then 'member' when 'F' then 'casual' end as member_casual,
    case o_orderstatus when 'F' then 'chicago' when 'O' then 'nyc' when 'P' then 'london' end as city,
    timestamp '2024-01-01' + to_seconds((o_orderkey * 7919 + l_partkey * 104729) % 2592000) as weather_at, l_linenumber
  from (select *, (l_suppkey + l_partkey % 12) % 100 as e from lineitem) join orders on l_orderkey = o_orderkey),
c as (select * from t where started_at is not null and ended_at is not null and start_lat between -90 and 90 and end_lat between -90 and 90
  and start_lng between -180 and 180 and end_lng between -180 and 180),
g as (select *, date_diff('second', started_at, ended_at) / 60.0e0 as trip_duration, case when start_station_id = end_station_id then 1 else 0 end as same_station,
    extract(hour from started_at)::int as hour, ((extract(isodow from started_at) + 6) % 7)::int as day_of_week, extract(month from started_at)::int as month,
    end_lat - start_lat as delta_lat, end_lng - start_lng as delta_lng,
    2 * 6371.0e0 * asin(sqrt(power(sin(radians(end_lat - start_lat) / 2), 2) + cos(radians(start_lat)) * cos(radians(end_lat)) * power(sin(radians(end_lng - start_lng) / 2), 2))) as haversine_distance_km,
    degrees(atan2(sin(radians(end_lng - start_lng)) * cos(radians(end_lat)),
      cos(radians(start_lat)) * sin(radians(end_lat)) - sin(radians(start_lat)) * cos(radians(end_lat)) * cos(radians(end_lng - start_lng)))) as raw_bearing
  from c),
f as (select *, case when day_of_week in (5, 6) then 1 else 0 end as is_weekend,
    case when hour between 5 and 10 then 'morning_peak' when hour between 11 and 15 then 'midday' when hour between 16 and 19 then 'evening_peak' else 'night' end as part_of_day,
    sin(hour * 2 * pi() / 24.0e0) as hour_sin, cos(hour * 2 * pi() / 24.0e0) as hour_cos, case when raw_bearing < 0 then raw_bearing + 360.0e0 else raw_bearing end as bearing,
    sin(radians(case when raw_bearing < 0 then raw_bearing + 360.0e0 else raw_bearing end)) as bearing_sin, cos(radians(case when raw_bearing < 0 then raw_bearing + 360.0e0 else raw_bearing end)) as bearing_cos
  from g),
k as (select * from f where trip_duration > 1 and trip_duration < 100 and (haversine_distance_km > 0.05 or same_station = 1) and haversine_distance_km < 12)"""
SQL_WEATHER = """
wo as (select case event_type when 'click' then 'chicago' when 'error' then 'nyc' when 'purchase' then 'london' end as city, date_trunc('hour', ts) as weather_hour,
    value / 10.0e0 - 10.0e0 as temperature_c, case when value > 100 then value / 100.0e0 else 0.0e0 end as precipitation_mm, case when event_id % 17 <> 0 then value / 20.0e0 end as wind_speed_kph,
    case when value > 300 then 1.0e0 else 0.0e0 end as snow_mm, event_id from events where event_type in ('click', 'error', 'purchase')),
w as (select * exclude (event_id, rn), case when precipitation_mm > 0 then 1 else 0 end as rain_flag, case when snow_mm > 0 then 1 else 0 end as snow_flag
  from (select *, row_number() over (partition by city, weather_hour order by event_id) as rn from wo) where rn = 1)"""
