"""Column contracts of the stages, and the checks that enforce them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Column names and orders of the published stage files.
FEATURED = [
    "rideable_type", "started_at", "ended_at", "start_lat", "start_lng", "end_lat", "end_lng", "member_casual", "city", "trip_duration", "same_station",
    "hour", "day_of_week", "month", "is_weekend", "part_of_day", "hour_sin", "hour_cos", "delta_lat", "delta_lng", "haversine_distance_km", "bearing",
    "bearing_sin", "bearing_cos",
]
FILTERED = [
    "rideable_type", "started_at", "member_casual", "city", "trip_duration", "same_station", "day_of_week", "month", "is_weekend", "part_of_day",
    "hour_sin", "hour_cos", "haversine_distance_km", "bearing_sin", "bearing_cos", "hour",
]
# Weather columns, category values and the column groups of the published model tables.
WEATHER_VALUES = ["temperature_c", "precipitation_mm", "wind_speed_kph", "snow_mm", "rain_flag", "snow_flag"]
WEATHER = ["city", "weather_hour", *WEATHER_VALUES]
CATEGORIES = {"rideable_type": ["classic_bike", "electric_bike"], "part_of_day": ["morning_peak", "midday", "evening_peak", "night"]}
DISCRETE = ["day_of_week", "month"]
BINARY = ["is_weekend", "same_station", "rain_flag", "snow_flag"]
CYCLICAL = ["hour_sin", "hour_cos", "bearing_sin", "bearing_cos"]
CONTINUOUS = ["trip_duration", "haversine_distance_km", "precipitation_mm", "wind_speed_kph", "snow_mm", "temperature_c"]
SKEWED = ["trip_duration", "haversine_distance_km", "precipitation_mm", "wind_speed_kph", "snow_mm"]
MODEL_INPUT = [*DISCRETE, *BINARY, *CYCLICAL, *CONTINUOUS, *(f"{c}_{v}" for c, values in CATEGORIES.items() for v in values)]
GENERATIVE_CATEGORICAL = ["rideable_type", "day_of_week", "month", "hour", "is_weekend", "same_station", "rain_flag", "snow_flag"]
GENERATIVE_CONTINUOUS = ["bearing_sin", "bearing_cos", *CONTINUOUS]
STRATA = ["month", "rideable_type", "part_of_day", "is_weekend"]


class ContractError(ValueError):
    """A table doesn't have the columns that a stage needs."""


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_same_columns(frames: dict[str, list[str]]) -> None:
    """All lists of feature names must be equal, in order."""
    names = list(frames)
    for other in names[1:]:
        if frames[other] != frames[names[0]]:
            odd = sorted(set(frames[other]) ^ set(frames[names[0]])) or ["order differs"]
            raise ContractError(f"{names[0]} and {other} differ: {', '.join(odd)}")
