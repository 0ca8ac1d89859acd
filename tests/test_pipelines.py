import os
import random

import pytest

from tripforge.contracts import FEATURED, FILTERED, MODEL_INPUT, ContractError
from tripforge.operators import evaluate
from tripforge.plans import pipelines as P


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    rng = random.Random(1)
    root = str(tmp_path_factory.mktemp("stages"))
    for city in ("chicago", "nyc"):
        for month in (1, 2):
            rows = [
                (rng.choice(["classic_bike", "electric_bike"]), f"2024-0{month}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", f"2024-0{month}-28 23:{rng.randint(10, 59)}:00", str(i % 5), str(i % 7), 41.8 + (i % 5) / 100, -87.7, 41.8 + (i % 7) / 100, -87.71, "member")
                for i in range(300)
            ]
            rows = [(*r[:2], r[1][:-5] + f"{rng.randint(5, 59)}:00", *r[3:]) for r in rows]
            kind = "string" if month == 1 else "int"
            names = f"rideable_type string, started_at string, ended_at string, start_station_id {kind}, end_station_id {kind}, start_lat double, start_lng double, end_lat double, end_lng double, member_casual string"
            cast = rows if month == 1 else [(*r[:3], int(r[3]), int(r[4]), *r[5:]) for r in rows]
            spark.createDataFrame(cast, names).write.parquet(f"{root}/raw/{city}-{month}.parquet")
    return P.Layout(root)


def test_files_to_report(spark, layout):
    cities = ["chicago", "nyc"]
    for city in cities:
        P.build_features(spark, [f"{layout.root}/raw/{city}-{m}.parquet" for m in (1, 2)], city, layout)
        assert spark.read.parquet(layout.path(city, "featured")).columns == FEATURED
        report = P.filter_city(spark, city, layout)
        assert report["kept_rows"] + report["removed_rows"] == report["total_rows"] == 600
        P.sample_city(spark, city, layout, 200)
        assert spark.read.parquet(layout.path(city, "sampled")).count() == 200
        hours = spark.sql("select explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-20', interval 1 hour)) as time, 5.0d as temp, 1.0d as prcp")
        P.build_weather(spark, {"near": (hours.limit(10), 1.0), "full": (hours, 9.0)}, spark.read.parquet(layout.path(city, "featured")), city, layout)
    combined = P.combine(spark, cities, layout, "both")
    weather = P.add_weather(spark, "both", cities, layout)
    enriched = spark.read.parquet(weather)
    assert enriched.count() == 400 and len(enriched.columns) == len(spark.read.parquet(combined).columns) + 6
    assert enriched.where("temperature_c is null").count() > 0
    assert P.prepare_model_input(spark, "both", weather, layout) == MODEL_INPUT
    P.prepare_model_input(spark, "again", weather, layout)
    P.check_model_inputs(spark, ["both", "again"], layout)
    train, test = P.locked_split(spark, "both", weather, layout, keys=["rideable_type", "is_weekend"])
    assert spark.read.parquet(test).count() == 80
    before = sorted(r.path for r in spark.read.format("binaryFile").load(train).select("path").collect())
    P.locked_split(spark, "both", weather, layout, keys=["rideable_type", "is_weekend"])
    assert before == sorted(r.path for r in spark.read.format("binaryFile").load(train).select("path").collect())
    report = P.cross_city_report(spark, "plain", train, test, evaluate.bootstrap_generator, 100, layout, trees=3, depth=3)
    assert report["transfer_label"] in ("Excellent", "Good", "Moderate", "Poor") and report["mean_ks"] < 0.3
    assert P.quality_files(spark, [weather], f"{layout.root}/quality").count() == 22


def test_no_files_is_an_error(spark, layout):
    with pytest.raises(FileNotFoundError):
        P.build_features(spark, [], "x", layout)
    with pytest.raises(FileNotFoundError):
        P.quality_files(spark, [], f"{layout.root}/none")


def test_london(spark):
    names = ["Number", "Start date", "Start station number", "End date", "End station number", "Bike model", "Total duration (ms)"]
    rows = [
        ("1", "2024-01-01 08:00", "001", "2024-01-01 08:10", "002", "CLASSIC", "600000"), ("2", "2024-01-01 08:00", "", "2024-01-01 08:10", "002", "CLASSIC", "600000"),
        ("3", "bad", "001", "2024-01-01 08:10", "002", "X", "600000"), ("4", "2024-01-01 09:00", "002", "2024-01-01 09:10", "001", "OTHER", "-1"),
    ]
    stations = spark.createDataFrame([("001", "A", 51.5, -0.1), ("002", "B", 51.52, -0.1)], "station_id string, station_name string, lat double, lng double")
    out = P.london_features(spark.createDataFrame(rows, names), stations)
    assert out.columns == FILTERED
    assert [(r.rideable_type, r.trip_duration, r.member_casual) for r in out.collect()] == [("classic_bike", 10.0, "unknown")]
    with pytest.raises(ContractError):
        P.london_features(spark.range(1), stations)


def test_stream_equals_batch(spark, layout, tmp_path):
    from tripforge.operators.trips import clean_trips, filter_trips, trip_features
    from tripforge.streaming.trips import start

    raw = spark.read.parquet(f"{layout.root}/raw/nyc-1.parquet").selectExpr("*", "'nyc' as city")
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    start(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == filter_trips(trip_features(clean_trips(raw))).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_failed_rename_loses_nothing(spark, tmp_path, monkeypatch):
    from tripforge.sources import io

    path = f"{tmp_path}/t.parquet"
    io.write_parquet(spark.range(3), path)
    move, calls = io._move, []

    def failing(fs, source, target):
        calls.append(source.toString())
        if source.toString().endswith(".writing"):
            raise OSError("no")
        move(fs, source, target)

    monkeypatch.setattr(io, "_move", failing)
    with pytest.raises(OSError, match="no"):
        io.write_parquet(spark.range(9), path, "overwrite")
    assert len(calls) == 3 and spark.read.parquet(path).count() == 3
    monkeypatch.setattr(io, "_move", move)
    assert io.write_parquet(spark.range(9), path, "overwrite") and spark.read.parquet(path).count() == 9
    assert io.write_parquet(spark.range(2), path, "append") and spark.read.parquet(path).count() == 11
    assert not io.write_parquet(spark.range(2), path, "skip")
    with pytest.raises(FileExistsError):
        io.write_parquet(spark.range(2), path)
    assert [p for p in os.listdir(tmp_path) if p != "t.parquet"] == []
    io.write_parquet(spark.range(5), f"{tmp_path}/root/a/b")
    assert io.copy_tree(spark, f"{tmp_path}/root", f"{tmp_path}/copy") >= 1
    assert spark.read.parquet(f"{tmp_path}/copy/a/b").count() == 5


@pytest.mark.parametrize(("kinds", "wide"), [
    ({"int"}, "int"), ({"int", "bigint"}, "bigint"), ({"tinyint", "smallint"}, "smallint"), ({"int", "double"}, "double"), ({"bigint", "float"}, "double"), ({"smallint", "float"}, "float"), ({"int", "string"}, "string"),
    ({"decimal(10,2)", "int"}, "decimal(12,2)"), ({"decimal(38,10)", "bigint"}, "decimal(38,10)"), ({"decimal(5,1)", "double"}, "double"), ({"date", "timestamp_ntz"}, "timestamp_ntz"), ({"boolean", "int"}, "string"),
])
def test_types_widen(kinds, wide):
    from tripforge.sources.io import common_type

    assert common_type(kinds) == wide
