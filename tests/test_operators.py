import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripforge.contracts import MODEL_INPUT, STRATA, ContractError, require_columns, require_same_columns
from tripforge.operators import enrich, evaluate, mlprep, profile, quantiles, sample, spatial, trips
from tripforge.sources import io

RAW = "rideable_type string, started_at string, ended_at string, start_station_id string, end_station_id string, start_lat string, start_lng string, end_lat string, end_lng string, member_casual string, city string"
GOOD = ("classic_bike", "2024-01-05 08:00:00", "2024-01-05 08:10:00", "1", "2", "41.8", "-87.7", "41.9", "-87.7", "member", "nyc")


def changed(**new):
    names = [c.split()[0] for c in RAW.split(", ")]
    return tuple(new.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_clean_drops_what_cannot_be_read(spark):
    rows = [GOOD, changed(started_at="garbage"), changed(end_lat="95"), changed(end_lng=None), changed(start_lat="90"), GOOD]
    raw = spark.createDataFrame(rows, RAW)
    assert trips.clean_trips(raw).count() == 3
    assert trips.clean_trips(raw, distinct=True).count() == 2


def test_rule_is_strict_and_report_adds_up(spark):
    rows = [(1.0, 1.0, 0), (100.0, 1.0, 0), (5.0, 0.05, 0), (5.0, 0.05, 1), (5.0, 12.0, 0), (5.0, 1.0, 0), (None, 1.0, 0)]
    f = spark.createDataFrame(rows, "trip_duration double, haversine_distance_km double, same_station int")
    r = trips.rule_report(f).first()
    assert (r.total_rows, r.kept_rows, r.removed_rows, r.breaks_rule) == (7, 2, 5, 4)
    assert (r.too_short, r.too_long, r.too_near, r.too_far) == (1, 1, 1, 1)


def test_missing_columns_are_named(spark):
    with pytest.raises(ContractError, match="nope"):
        require_columns(spark.range(1), ["id", "nope"])
    with pytest.raises(ContractError):
        require_same_columns({"a": ["x"], "b": ["y"]})


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(0, 400))
def test_allocation_sums_to_the_target(spark, sizes, target):
    strata = spark.createDataFrame([(i, "a", "b", 0, n) for i, n in enumerate(sizes)], "month int, rideable_type string, part_of_day string, is_weekend int, strata_size long")
    rows = sample.allocate(strata, STRATA, target).collect()
    assert sum(r.target_in_stratum for r in rows) == min(target, sum(sizes))
    for r in rows:
        assert 0 <= r.target_in_stratum <= r.strata_size
        assert abs(r.target_in_stratum - r.strata_size * min(target, sum(sizes)) / sum(sizes)) < 1


def test_exact_samples(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("k"))
    need = sample.allocate(sample.strata_sizes(df, ["k"]), ["k"], 1001)
    got = sample.stratified_sample(df, 1001, ["k"]).groupBy("k").count()
    assert {r.k: r["count"] for r in got.collect()} == {r.k: r.target_in_stratum for r in need.collect()}
    first = {r.id for r in sample.uniform_sample(df, 100).collect()}
    assert len(first) == 100
    assert first == {r.id for r in sample.uniform_sample(df.repartition(7), 100).collect()}
    assert sample.uniform_sample(df, 9000).count() == 5000
    assert sample.uniform_sample(df, 0).count() == 0


def test_null_strata_are_never_sampled(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, k string")
    assert sample.stratified_sample(df, 4, ["k"]).count() == 2


def test_split_shares_and_singletons(spark):
    df = spark.range(997).select("id", (F.col("id") % 3).alias("k"))
    split = sample.stratified_split(df, ["k"])
    assert split.where("split = 'test'").count() == 200  # ceil(0.2 x 997)
    assert split.select("id").distinct().count() == 997
    with pytest.raises(ContractError):
        sample.stratified_split(df.withColumn("k", F.when(F.col("id") == 5, 99).otherwise(F.col("k"))), ["k"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 30)), min_size=1, max_size=60))
def test_quantiles_equal_percentile(spark, values):
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double")
    at = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.p: r.value for r in quantiles.exact_quantiles(df, [], ["x"], at).collect()}
    want = df.select(F.percentile("x", at)).first()[0] or [None] * 5
    assert [got[p] for p in at] == pytest.approx(want) if want[0] is not None else all(v is None for v in got.values())


def test_quantiles_with_tight_brackets(spark):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("x"), (F.col("id") % 2).alias("g"))
    got = {(r.g, r.p): r.value for r in quantiles.exact_quantiles(df, ["g"], ["x"], [0.05, 0.5, 0.95], accuracy=100).collect()}
    for r in df.groupBy("g").agg(F.percentile("x", [0.05, 0.5, 0.95]).alias("q")).collect():
        assert [got[r.g, p] for p in (0.05, 0.5, 0.95)] == pytest.approx(list(r.q))


def test_many_to_one_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, v double")
    rows = {r.id: r.v for r in enrich.join_many_to_one(left, right, ["k"]).collect()}
    assert rows == {1: 1.0, 2: 2.0, 3: None}
    with pytest.raises(ContractError):
        enrich.join_many_to_one(left, right.union(right), ["k"])


def test_first_by_keeps_column_order(spark):
    df = spark.createDataFrame([("x", "a", 2), ("y", "a", 1)], "v string, k string, o int")
    out = enrich.first_by(df, ["k"], ["o"])
    assert out.columns == ["v", "k", "o"]
    assert out.first().v == "y"


def test_snow_columns_coalesce(spark):
    raw = spark.sql("select timestamp_ntz'2024-01-01 01:30:00' time, 3.0d temp, cast(null as double) snow, 2.0d snwd")
    row = enrich.normalize_weather(raw, F.lit("nyc")).first()
    assert (row.snow_mm, row.snow_flag, row.precipitation_mm, row.wind_speed_kph) == (2.0, 1, 0.0, None)


def trip_rows(spark):
    rows = [("classic_bike", "midday", 1, 1, 0, 0, 0, None, 0.0, 1.0, 0.0, 1.0, float(i), 2.0, 0.0, None, 0.0, 5.0) for i in range(1, 5)] + [("docked_bike", "night", 2, 3, 1, None, 1, 1, 0.0, 1.0, 0.0, 1.0, None, 2.0, 1.0, None, 0.0, 7.0)]
    return spark.createDataFrame(rows, "rideable_type string, part_of_day string, day_of_week int, month int, is_weekend int, same_station int, rain_flag int, snow_flag int, hour_sin double, hour_cos double, bearing_sin double, bearing_cos double, trip_duration double, haversine_distance_km double, precipitation_mm double, wind_speed_kph double, snow_mm double, temperature_c double")


def test_model_input(spark):
    table, fitted = mlprep.model_input(trip_rows(spark))
    assert table.columns == MODEL_INPUT and len(MODEL_INPUT) == 22
    assert fitted["medians"]["trip_duration"] == 2.5
    assert fitted["medians"]["wind_speed_kph"] == 0.0
    assert fitted["scaler"]["haversine_distance_km"][1] == 1.0
    docked = table.where("month = 3").first()
    assert (docked.rideable_type_classic_bike, docked.rideable_type_electric_bike, docked.same_station) == (0, 0, 0)
    assert {t for _, t in table.dtypes} == {"tinyint", "float"}


def test_ks_and_tvd(spark):
    a = spark.createDataFrame([(float(i % 5), "x") for i in range(300)], "v double, c string")
    b = spark.createDataFrame([(float(i % 6), "y") for i in range(200)], "v double, c string")
    assert evaluate.ks_statistics(a, b, ["v"]).first().value == pytest.approx(1 / 6, abs=0.01)
    assert evaluate.total_variations(a, b, ["c"]).first().value == pytest.approx(1.0)
    assert evaluate.total_variations(a, a, ["c"]).first().value == pytest.approx(0.0)
    mixed = spark.createDataFrame([(None,), ("x",)], "c string")
    assert evaluate.total_variations(mixed, a.select("c"), ["c"]).first().value == pytest.approx(0.5)


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "trip_duration double, haversine_distance_km double")
    assert profile.corr_by(df.withColumn("g", F.lit(1)), ["g"]).first()["corr"] is None


def test_null_profile_counts_nan_on_request(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, "a")], "x double, s string")
    plain = {r.column: r.null_count for r in profile.null_profile(df, "t").collect()}
    both = {r.column: r.null_count for r in profile.null_profile(df, "t", nan_too=True).collect()}
    assert (plain, both) == ({"x": 0, "s": 1}, {"x": 1, "s": 1})


def test_segments_are_clipped_to_cells(spark):
    edges = spark.createDataFrame([(5.0, 5.0, 25.0, 5.0), (5.0, 5.0, 5.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    rows = spatial.segments_by_cell(edges.limit(1), (0.0, 0.0), 10.0).collect()
    assert {r.grid_x: round(r.length_m, 6) for r in rows} == {0: 5.0, 1: 10.0, 2: 5.0}


def test_sources(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, s string"), spark.createDataFrame([("k", 2.0)], "id string, d double")
    both = io.union_by_name([a, b])
    assert dict(both.dtypes)["id"] == "string" and both.count() == 2
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    with pytest.raises(ContractError):
        io.read_same_schema(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert io.write_parquet(a, f"{tmp_path}/out") is True
    assert io.write_parquet(a, f"{tmp_path}/out", mode="skip") is False
    with pytest.raises(FileExistsError):
        io.write_parquet(a, f"{tmp_path}/out")
    assert io.write_parquet(b, f"{tmp_path}/out", mode="overwrite") and spark.read.parquet(f"{tmp_path}/out").columns == ["id", "d"]
    io.write_json(spark, {"n": ["é"]}, f"{tmp_path}/x.json")
    assert io.read_json(spark, f"{tmp_path}/x.json") == {"n": ["é"]}
    assert io.group_monthly_paths(["/d/202401-citibike-tripdata_10.parquet", "/d/202401-citibike-tripdata_2.parquet", "/d/x.csv"]) == {"202401": ["/d/202401-citibike-tripdata_2.parquet", "/d/202401-citibike-tripdata_10.parquet"]}


def test_csv_keeps_empty_strings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,s\n1,""\n2,x\n')
    (tmp_path / "b.csv").write_text("s,n\ny,3\n")
    rows = io.read_csv_text(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert sorted((r.n, r.s) for r in rows.collect()) == [("1", ""), ("2", "x"), ("3", "y")]
    (tmp_path / "c.csv").write_text("n,z\n1,2\n")
    with pytest.raises(ContractError):
        io.read_csv_text(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/c.csv"])
    typed = io.read_csv_typed(spark, [f"{tmp_path}/a.csv"], {"n": "string"})
    assert dict(typed.dtypes)["n"] == "string"


def test_stations_without_terminal_are_left_out(spark, tmp_path):
    data = [{"commonName": "A", "lat": 1.0, "lon": 2.0, "additionalProperties": [{"key": "Z", "value": "0"}, {"key": "TerminalName", "value": "007"}]}, {"commonName": "B", "lat": 1.0, "lon": 2.0, "additionalProperties": []}]
    (tmp_path / "s.json").write_text(json.dumps(data))
    assert [tuple(r) for r in io.read_stations(spark, f"{tmp_path}/s.json").collect()] == [("007", "A", 1.0, 2.0)]


def test_correlations_over_rows_where_both_are_known(spark):
    import numpy as np

    from tripforge.operators.profile import correlation_matrix

    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 4)) + [0, 1e6, -3, 5]
    data[:, 2] += data[:, 0]
    data[:, 3] = 7.1
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in r) for r in data] + [(None,) * 4]
    got = {(r.x, r.y): r["corr"] for r in correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()}
    assert len(got) == 16
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            if "d" in (x, y):
                assert got[x, y] is None
            else:
                assert abs(got[x, y] - np.corrcoef(both.T)[0, 1]) < 1e-6
    empty = correlation_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert all(r["corr"] is None for r in empty)


def test_quantiles_of_large_groups_are_cut_into_slices(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tripforge.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(2)
    values = [(g, float(v)) for g, n in (("a", 3000), ("b", 500), (None, 40)) for v in np.round(rng.lognormal(size=n), 2)] + [("c", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = exact_quantiles(df, ["g"], ["v"], [0.0, 0.01, 0.25, 0.5, 0.99, 1.0], accuracy=100, more={"n": F.count("*")}).collect()
    for g in ("a", "b", None, "c"):
        own = [v for k, v in values if k == g and v is not None]
        for r in [r for r in got if r.g == g]:
            assert r.n == max(1, len(own)) and (r.value is None if not own else abs(r.value - np.quantile(own, r.p)) < 1e-9)
    assert len(got) == 24


def test_nearby_stations(spark):
    from tripforge.operators.enrich import nearby_stations

    places = spark.createDataFrame([("x", 50.0, 0.0), ("y", -0.4, 10.0)], "city string, lat double, lng double")
    stations = spark.createDataFrame([("s1", 50.5, 0.0), ("s2", 49.2, 0.1), ("s3", 51.0, 0.0), ("s4", 50.0, 0.2), ("s5", 0.4, 10.0)], "source string, lat double, lng double")
    assert [(r.city, r.source) for r in nearby_stations(places, stations).orderBy("city", "rank").collect()] == [("x", "s4"), ("x", "s1"), ("x", "s2"), ("y", "s5")]
    assert [r.source for r in nearby_stations(places, stations, most=1).orderBy("city").collect()] == ["s4", "s5"]


def test_coverage_counts_known_temperatures_only(spark):
    from pyspark.sql import functions as F

    from tripforge.operators.enrich import hour_coverage, with_stations
    from tripforge.contracts import ContractError

    weather = spark.sql("select 'x' as city, timestamp_ntz'2024-01-01 00:00:00' as weather_hour, 1d as temperature_c union all select 'x', timestamp_ntz'2024-01-01 01:00:00', null")
    bound = lambda s: F.to_timestamp_ntz(F.lit(s))
    assert hour_coverage(weather, bound("2024-01-01 00:00:00"), bound("2024-01-01 01:00:00")).first().hours_covered == 1
    twice = spark.createDataFrame([("1", "a", 0.0, 0.0)] * 2, "station_id string, station_name string, lat double, lng double")
    with pytest.raises(ContractError):
        with_stations(spark.createDataFrame([("1", "1")], "start_station_id string, end_station_id string"), twice)


def test_text_columns_become_the_same_dummies_on_both_sides(spark):
    from tripforge.operators.evaluate import coded_features

    a = spark.createDataFrame([("x", 1.0, None)], "kind string, trip_duration double, rain_flag int")
    b = spark.createDataFrame([("y z", 2.0, 1), (None, 3.0, 0)], "kind string, trip_duration double, rain_flag int")
    (ca, cb), features = coded_features([a, b], ["kind", "rain_flag"])
    assert features == ["rain_flag", "f0", "f1"]
    assert [tuple(r) for r in ca.select(*features).collect()] == [(0.0, 1, 0)]
    assert [tuple(r) for r in cb.select(*features).collect()] == [(1.0, 0, 1), (0.0, 0, 0)]


def test_the_small_side_of_a_join_is_broadcast_though_its_source_is_large(spark, tmp_path):
    spark.range(2_000_000, numPartitions=2).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 1_000_003).alias("v"), F.col("id")).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    right = enrich.first_by(source, ["k"], ["id"]).select("k", "v")
    joined = enrich.join_many_to_one(source.select("k", "id"), right, ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the left side was shuffled before the right side's size was known
    assert joined.where("v is null").count() == 0 and joined.count() == 2_000_000


def test_features_run_in_methods_that_java_compiles(spark):
    """One method of all features was over 8,000 bytes long and ran interpreted."""
    from tripforge import session

    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        session.limit_methods(spark)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "9000")
        session.limit_methods(spark)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "9000"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def test_odd_trips_are_those_with_a_flag(spark):
    nan = float("nan")
    rows = [(m, k, s) for m in (None, nan, -1.0, 1.0, 1.1, 99.9, 100.0) for k in (None, nan, 0.0, 0.05, 0.06, 11.9, 12.0) for s in (0, 1, None)]
    df = spark.createDataFrame(rows, "trip_duration double, haversine_distance_km double, same_station int").withColumn("city", F.lit("x"))
    got = [sorted(map(tuple, profile.suspicious_trips(df, before=b).collect())) for b in (True, False)]
    assert got[0] == got[1] and sum(r[-1] for r in got[0]) > 0


def test_a_stored_table_is_not_written_again(spark, tmp_path, monkeypatch):
    from tripforge.sources.scratch import Scratch

    spark.createDataFrame([(float(i), i * 0.5) for i in range(101)], "a double, b double").write.parquet(str(tmp_path / "t"))
    table, names, write = spark.read.parquet(str(tmp_path / "t")), [], Scratch._table
    monkeypatch.setattr(Scratch, "_table", lambda self, df, name, paths: names.append(name) or write(self, df, name, paths))
    assert mlprep.fit_medians(table, ["a", "b"], stored=True) == {"a": 50.0, "b": 25.0}
    assert "quantile-rows" not in names
    assert mlprep.fit_medians(table, ["a", "b"]) == {"a": 50.0, "b": 25.0} and "quantile-rows" in names


def test_forest_is_fitted_on_all_cores_at_once(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    rows = spark.range(0, 400, 1, 1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 3.0).alias("y"))
    dealt, fit = [], RandomForestRegressor.fit

    def counted(self, df):
        dealt.append(df.rdd.glom().map(len).collect())
        return fit(self, df)

    monkeypatch.setattr(RandomForestRegressor, "fit", counted)
    scores = evaluate.forest_utility(rows, rows, ["x"], label="y", trees=3, depth=4).first()
    assert scores.r2 > 0.95
    assert len(dealt[0]) == spark.sparkContext.defaultParallelism and sum(dealt[0]) == 400 and min(dealt[0]) >= 50
