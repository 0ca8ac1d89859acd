"""The stages as jobs from files to files. Paths may be on any file system that Spark reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FILTERED, GENERATIVE_CATEGORICAL, GENERATIVE_CONTINUOUS, MODEL_INPUT, STRATA, ContractError, require_columns, require_same_columns
from ..functions import exprs as X
from ..operators import enrich, evaluate, mlprep, profile, sample, trips
from ..sources import io


@dataclass(frozen=True)
class Layout:
    """Where stage files lie: ``<root>/<city>_<stage>.parquet``."""

    root: str

    def path(self, name: str, stage: str) -> str:
        return f"{self.root.rstrip('/')}/{name}_{stage}.parquet"


def build_features(spark: SparkSession, files: list[str], city: str, layout: Layout, distinct: bool = False) -> str:
    """Monthly files of one city, whose columns and types may differ, to its featured stage."""
    if not files:
        raise FileNotFoundError(f"no files for {city}")
    raw = io.read_union_by_name(spark, files)
    for c in trips.RAW:
        if c not in raw.columns and c != "city":
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    out = layout.path(city, "featured")
    io.write_parquet(trips.trip_features(trips.clean_trips(raw.withColumn("city", F.lit(city)), distinct)), out, "overwrite")
    return out


def filter_city(spark: SparkSession, city: str, layout: Layout, rule: trips.TripRule = trips.RULE) -> dict:
    """The filtered stage of a city; returns the rule report."""
    featured = spark.read.parquet(layout.path(city, "featured"))
    io.write_parquet(trips.filter_trips(featured, rule), layout.path(city, "filtered"), "overwrite")
    return trips.rule_report(featured, rule).first().asDict()


# Names of the raw columns of the all-text files, and the values of the bike model column.
LONDON_NAMES = {"Start date": "started_at", "End date": "ended_at", "Start station number": "start_station_id", "End station number": "end_station_id", "Bike model": "rideable_type", "Total duration (ms)": "duration_ms"}
LONDON_MODELS = {"CLASSIC": "classic_bike", "PBSC_EBIKE": "electric_bike"}


def london_features(raw: DataFrame, stations: DataFrame, rule: trips.TripRule = trips.RULE) -> DataFrame:
    """Trips without coordinates: places come from their stations, durations from milliseconds; the trip rule is applied."""
    require_columns(raw, list(LONDON_NAMES), "raw trips")
    named = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in LONDON_NAMES.items()])
    typed = named.withColumns({
        "started_at": F.col("started_at").try_cast("timestamp_ntz"), "ended_at": F.col("ended_at").try_cast("timestamp_ntz"),
        "trip_duration": F.col("duration_ms").try_cast("double") / F.lit(60000.0), "rideable_type": X.relabel(F.col("rideable_type"), LONDON_MODELS),
        "city": F.lit("london"), "member_casual": F.lit("unknown"),
    }).na.drop(subset=["started_at", "ended_at", "trip_duration", "start_station_id", "end_station_id"]).where("trip_duration > 0")
    placed = enrich.with_stations(typed, stations)
    place = [F.col(c) for c in ("start_st_lat", "start_st_lng", "end_st_lat", "end_st_lng")]
    hour, day = F.hour("started_at"), X.weekday0(F.col("started_at"))
    hour_sin, hour_cos = X.cyclic(hour, 24)
    out = placed.withColumns({
        "same_station": X.same_station(F.col("start_station_id"), F.col("end_station_id")), "hour": hour, "day_of_week": day, "month": F.month("started_at"),
        "is_weekend": X.is_weekend(day), "part_of_day": X.part_of_day(hour), "hour_sin": hour_sin, "hour_cos": hour_cos,
        "haversine_distance_km": X.haversine_km(*place), "bearing": X.bearing_deg(*place),
    })
    turn = F.radians("bearing")
    return out.withColumns({"bearing_sin": F.sin(turn), "bearing_cos": F.cos(turn)}).where(rule.keep()).select(*FILTERED)


def sample_city(spark: SparkSession, city: str, layout: Layout, target: int = 1_000_000, seed: int = 42) -> str:
    """The sampled stage of a city: exact and proportional over its strata."""
    out = layout.path(city, "sampled")
    io.write_parquet(sample.stratified_sample(spark.read.parquet(layout.path(city, "filtered")), target, STRATA, seed), out, "overwrite")
    return out


def combine(spark: SparkSession, cities: list[str], layout: Layout, name: str) -> str:
    """The sampled stages of several cities as one."""
    out = layout.path(name, "sampled")
    io.write_parquet(io.read_same_schema(spark, [layout.path(c, "sampled") for c in cities]), out, "overwrite")
    return out


def build_weather(spark: SparkSession, candidates: dict[str, tuple[DataFrame, float]], trips_df: DataFrame, city: str, layout: Layout) -> str:
    """The weather stage of a city from the candidate source (frame, distance) that covers most hours of its trips."""
    bounds = trips_df.agg(F.min("started_at").alias("a"), F.max("started_at").alias("b")).first()
    if bounds.a is None:
        raise ContractError(f"{city} has no trips")
    scored = []
    for name, (frame, distance) in candidates.items():
        got = enrich.hour_coverage(enrich.normalize_weather(frame, F.lit(city)), F.to_timestamp_ntz(F.lit(str(bounds.a))), F.to_timestamp_ntz(F.lit(str(bounds.b)))).first()
        scored.append((name, int(got.hours_covered) if got else 0, float(distance)))
    best = enrich.choose_source(spark.createDataFrame(scored, "source string, coverage_hours long, distance_km double")).first()
    if best is None:
        raise ContractError(f"no weather covers {city}")
    rows = enrich.first_by(enrich.normalize_weather(candidates[best.source][0], F.lit(city)).withColumn("__order", F.lit(0)), ["city", "weather_hour"], ["__order", "temperature_c"]).drop("__order")
    out = layout.path(city, "weather")
    io.write_parquet(rows, out, "overwrite")
    return out


def add_weather(spark: SparkSession, name: str, cities: list[str], layout: Layout) -> str:
    """The sampled stage with weather."""
    weather = io.union_by_name([spark.read.parquet(layout.path(c, "weather")) for c in cities])
    out = layout.path(name, "with_weather")
    io.write_parquet(enrich.with_weather(spark.read.parquet(layout.path(name, "sampled")), weather), out, "overwrite")
    return out


def prepare_model_input(spark: SparkSession, name: str, source: str, layout: Layout) -> list[str]:
    """The model table and what it was made with, as files; returns the feature names."""
    table, fitted = mlprep.model_input(spark.read.parquet(source))
    io.write_parquet(table, layout.path(name, "model_input"), "overwrite")
    io.write_json(spark, MODEL_INPUT, f"{layout.root}/final_feature_columns_{name}.json")
    io.write_json(spark, fitted, f"{layout.root}/feature_info_{name}.json")
    return MODEL_INPUT


def check_model_inputs(spark: SparkSession, names: list[str], layout: Layout) -> None:
    """All prepared tables must have the same features."""
    require_same_columns({n: io.read_json(spark, f"{layout.root}/final_feature_columns_{n}.json") for n in names})


def locked_split(spark: SparkSession, name: str, source: str, layout: Layout, keys: list[str] = STRATA, force: bool = False) -> tuple[str, str]:
    """Train and test files; those that are there stay, unless forced."""
    train, test = layout.path(name, "train"), layout.path(name, "test")
    if force or not (io.exists(spark, train) and io.exists(spark, test)):
        split = sample.stratified_split(spark.read.parquet(source), keys)  # the source is read once
        for path, side in ((train, "train"), (test, "test")):
            io.write_parquet(split.where(F.col("split") == side).drop("split"), path, "overwrite")
    return train, test


def quality_files(spark: SparkSession, files: list[str], out: str) -> DataFrame:
    """Null report of Parquet files, worst columns first, also as CSV."""
    if not files:
        raise FileNotFoundError("no Parquet files")
    report = profile.quality_report({f.rsplit("/", 1)[-1]: spark.read.parquet(f) for f in files})
    report = report.orderBy(F.col("null_percent").desc_nulls_last(), "file", "column")
    io.write_csv(report, out)
    return report


def cross_city_report(spark: SparkSession, name: str, train: str, test: str, generate, n: int, layout: Layout, **forest) -> dict:
    """Fidelity, utility and transfer gap of a generator fitted on one city and tested on another."""
    table, other = (mlprep.generative_table(spark.read.parquet(p)) for p in (train, test))
    filled = lambda df: df.na.fill(0.0, GENERATIVE_CONTINUOUS).na.fill(0)
    written = layout.path(name, "synthetic")
    io.write_parquet(generate(filled(table), n), written, "overwrite")
    report = {"experiment": name, "train_rows": table.count(), "n_synth": n}
    report |= evaluate.evaluate_synthetic(filled(table), filled(other), spark.read.parquet(written), GENERATIVE_CONTINUOUS, GENERATIVE_CATEGORICAL, **forest)
    report["transfer_label"] = spark.range(1).select(evaluate.gap_label(F.lit(report["transfer_gap"]))).first()[0]
    io.write_json(spark, report, f"{layout.root}/eval_report_{name}.json")
    return report
