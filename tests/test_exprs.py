import math

import pytest
from pyspark.sql import functions as F

from tripforge.functions import exprs as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_duration_counts_second_boundaries(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.9' a, timestamp_ntz'2024-01-01 00:01:00.1' b")
    row = df.select(X.duration_minutes(F.col("a"), F.col("b")), X.duration_minutes(F.col("a"), F.col("b"), fractional=True)).first()
    assert row[0] == 1.0
    assert row[1] == pytest.approx(59.2 / 60)


def test_haversine_and_bearing(spark):
    at = lambda a, b, c, d: (F.lit(float(a)), F.lit(float(b)), F.lit(float(c)), F.lit(float(d)))
    assert one(spark, X.haversine_km(*at(1, 2, 1, 2)), x=1) == 0.0
    assert one(spark, X.haversine_km(*at(0, 0, 0, 180)), x=1) == pytest.approx(math.pi * 6371.0)
    assert one(spark, X.bearing_deg(*at(0, 0, 1, 0)), x=1) == 0.0
    assert one(spark, X.bearing_deg(*at(0, 0, 0, -1)), x=1) == pytest.approx(270.0)


@pytest.mark.parametrize(("hour", "part"), [(4, "night"), (5, "morning_peak"), (10, "morning_peak"), (11, "midday"), (15, "midday"), (16, "evening_peak"), (19, "evening_peak"), (20, "night")])
def test_part_of_day(spark, hour, part):
    assert one(spark, X.part_of_day(F.col("h")), h=hour) == part


@pytest.mark.parametrize(("t", "band"), [(0.0, "< 0C"), (10.0, "0-10C"), (30.0, "20-30C"), (30.1, ">= 30C")])
def test_bands_are_closed_on_the_right(spark, t, band):
    assert one(spark, X.temperature_band(F.col("t")), t=t) == band


def test_same_station_is_null_safe(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.same_station(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 0]


def test_floor_hour_stays_without_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 03:59:59' t").select(X.floor_hour(F.col("t")).alias("h"))
    assert dict(df.dtypes)["h"] == "timestamp_ntz"


def test_relabel_falls_through(spark):
    df = spark.createDataFrame([("CLASSIC",), ("other",), (None,)], "m string")
    assert [r[0] for r in df.select(X.relabel(F.col("m"), {"CLASSIC": "classic_bike"})).collect()] == ["classic_bike", "other", None]
