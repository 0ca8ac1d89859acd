"""Layouts and algorithms for very large tables, against plain versions."""

import collections
import http.server
import itertools
import json
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from tripforge.functions import projection
from tripforge.operators import bucketed, coverage, heavy, ranks, sketches, spatial
from tripforge.sources import counted, io, schemas, snapshots
from tripforge.sources.scratch import Scratch
from tripforge.sources.stations_source import read_station_pages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- many files -----------------------------------------------------------------------------------


def small_files(root, n):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = [
        {"id": pa.int32(), "v": pa.float64()}, {"id": pa.int64(), "v": pa.float64(), "name": pa.string()}, {"v": pa.int32(), "id": pa.int64()}, {"id": pa.int64(), "odd name": pa.string()},
    ]
    for k in range(n):
        columns = {c: pa.array([str(k)] if pa.types.is_string(t) else [k], t) for c, t in kinds[k % 4].items()}
        pq.write_table(pa.table(columns), f"{root}/{k:05d}.parquet")


def test_two_thousand_files_of_four_schemas_are_four_scans(spark, tmp_path):
    small_files(tmp_path, 2000)
    paths = io.files_in(spark, str(tmp_path), "*.parquet")
    got = schemas.read_files(spark, paths)
    assert plan(got).count("FileScan parquet") == 4
    assert dict(got.dtypes) == {"id": "bigint", "v": "double", "name": "string", "odd name": "string"}
    want = sorted((k, None if k % 4 == 3 else float(k), str(k) if k % 4 == 1 else None, str(k) if k % 4 == 3 else None) for k in range(2000))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want


def test_files_that_must_be_alike(spark, tmp_path):
    from tripforge.contracts import ContractError

    small_files(tmp_path, 5)
    paths = io.files_in(spark, str(tmp_path), "*.parquet")
    assert sorted(r.id for r in schemas.read_same(spark, [paths[0], paths[4]]).collect()) == [0, 4]
    with pytest.raises(ContractError):
        schemas.read_same(spark, paths[:2])
    with pytest.raises(FileNotFoundError):
        schemas.read_files(spark, [])


# --- counters -------------------------------------------------------------------------------------


def test_counters_are_those_of_the_rows_written_and_add_up(spark, tmp_path):
    path = str(tmp_path / "t")
    counters = lambda df: {"n": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1), "none": F.sum(F.when(F.col("id") < 0, 1))}
    rows = spark.range(1000).repartition(4)
    counted.write_counted(rows, path, counters(rows))
    assert counted.read_counters(spark, path) == {"n": 1000, "odd": 500, "none": 0}
    more = spark.range(1000, 1101)
    counted.write_counted(more, path, counters(more), "append")
    assert counted.read_counters(spark, path) == {"n": 1101, "odd": 550, "none": 0}
    assert spark.read.parquet(path).count() == 1101
    assert {r["name"]: r["value"] for r in counted.counter_rows(spark, path).collect()} == {"n": 1101, "odd": 550, "none": 0}
    with pytest.raises(FileNotFoundError):
        counted.read_counters(spark, str(tmp_path))


# --- sketches, heavy hitters, bitmaps -------------------------------------------------------------


def test_stored_sketches_merge_within_their_error_and_an_added_month_reads_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "sketches")
    draw = random.Random(4)
    rows = [(c, m, draw.expovariate(0.1)) for c, m in itertools.product("ab", range(3)) for _ in range(4000)] + [("a", 0, None)]
    df = spark.createDataFrame(rows, "city string, month int, v double")
    for month in range(3):
        sketches.add_to_store(df.where(F.col("month") == month), path, ["city", "month"], ["v"])
    stored = sketches.open_store(spark, path)
    assert stored.count() == 6
    merged = sketches.merge(stored, ["city"], ["v"]).select("city", sketches.known("v").alias("n"), sketches.quantile("v", 0).alias("low"), sketches.quantile("v", 0.5).alias("mid"), sketches.quantile("v", 1).alias("high"))
    for r in merged.collect():
        values = sorted(v for c, _, v in rows if c == r.city and v is not None)
        assert (r.n, r.low, r.high) == (12000, values[0], values[-1])
        assert abs(sum(v <= r.mid for v in values) - 6000) <= sketches.RANK_ERROR * 12000 + 1


@pytest.mark.parametrize("capacity", [2, 7, 1000])
def test_heavy_hitters_equal_the_full_sort(spark, capacity):
    draw = random.Random(capacity)
    rows = [(None, "x")] * 300 + [(7, None)] * 300 + [(draw.randint(0, 400), draw.choice("xy")) for _ in range(1500)] + [(1000, "hot")] * 900
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b string").repartition(5)
    counts = collections.Counter(rows)
    first = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(counts, key=lambda k: (-counts[k], first(k[0]), (k[1] is not None, k[1] or "")))
    got = heavy.most_frequent(df, ["a", "b"], 9, capacity).collect()
    assert [(r.a, r.b, r.n) for r in got] == [(*k, counts[k]) for k in order[:9]]
    assert heavy.most_frequent(df.where("false"), ["a"], 3).collect() == []
    assert len(heavy.most_frequent(df, ["b"], 50, capacity).collect()) == 4


def test_values_of_which_none_stands_out_take_two_passes(spark, monkeypatch):
    made, summaries = [], heavy.summaries
    monkeypatch.setattr(heavy, "summaries", lambda *a: made.append(a) or summaries(*a))
    rows = spark.range(30_000, numPartitions=3).select((F.col("id") * 7919 % 9973).alias("k"))
    counts = collections.Counter(i * 7919 % 9973 for i in range(30_000))
    want = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:25]
    assert [(r.k, r.n) for r in heavy.most_frequent(rows, ["k"], 25, 20).collect()] == want
    assert len(made) == 1  # the summaries grew to all values of a task, one scan and one count for each doubling


def test_a_summary_is_no_larger_than_its_capacity(spark):
    made = heavy.summaries(spark.range(50_000).repartition(3).select((F.col("id") % 9000).alias("k")), ["k"], 20)
    assert made.where("__error is null").count() <= 3 * 20


def test_hour_bitmaps_equal_sets_of_hours(spark):
    draw, spans = random.Random(2), 40_000
    start = 17_700_000  # hours since the year 1; the span lies over several blocks
    hours = {s: {start + draw.randint(0, spans) for _ in range(n)} for s, n in (("a", 3000), ("b", 20), ("c", 1))}
    rows = spark.createDataFrame([(s, h) for s, hs in hours.items() for h in hs] * 2, "source string, h long").withColumn("at", coverage.hour_of(F.col("h")))
    bits = coverage.hour_bitmaps(rows, ["source"], F.col("at"))
    assert {r.source: r.hours_covered for r in coverage.covered(bits, ["source"]).collect()} == {s: len(h) for s, h in hours.items()}
    pairs = {(r.a, r.b): (r.hours_any, r.hours_both) for r in coverage.pair_coverage(bits).collect()}
    assert pairs == {(x, y): (len(hours[x] | hours[y]), len(hours[x] & hours[y])) for x, y in itertools.combinations("abc", 2)}
    low, high = start + 100, start + 36_000
    found = collections.defaultdict(set)
    for r in coverage.gaps(bits, ["source"], low, high).collect():
        assert found[r.source].isdisjoint(range(r.from_hour - 1, r.to_hour + 2))
        found[r.source] |= set(range(r.from_hour, r.to_hour + 1))
    assert found == {s: set(range(low, high + 1)) - h for s, h in hours.items()}


# --- buckets, ranks, versions ---------------------------------------------------------------------


def test_bucketed_join_has_no_exchange_and_splits_hot_keys(spark):
    rows = [("x", 1, k) for k in range(900)] + [("y", k % 50, k) for k in range(600)] + [(None, 3, k) for k in range(5)] + [("z", None, 1)]
    left = spark.createDataFrame(rows, "city string, hour int, k int")
    right = spark.createDataFrame([("x", 1, 1.5), (None, 3, 2.5), ("y", 7, 3.5)], "city string, hour int, t double")
    layout = bucketed.lay_out(left, right, ["city", "hour"], buckets=6, hot_rows=100)
    joined = layout.joined(["t"])
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    known = {("x", 1): 1.5, (None, 3): 2.5, ("y", 7): 3.5}
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted((tuple(r) for r in joined.select("city", "hour", "k", "t").collect()), key=lambda r: order(r[1:]) + (str(r[0]),)) == sorted(((*r, known.get(r[:2])) for r in rows), key=lambda r: order(r[1:]) + (str(r[0]),))
    salts = spark.table(layout.left).where("city = 'x'").groupBy("__salt").count().collect()
    assert len(salts) == 9 and max(r["count"] for r in salts) <= 300
    layout.drop()


def test_row_numbers_equal_the_window_and_use_no_single_partition(spark):
    rows = spark.range(20_000).select("id", (F.xxhash64("id") % 50).alias("v"))
    with Scratch(spark) as own:
        placed = ranks.with_row_number(rows, [F.col("v").desc(), F.col("id")], own, "place")
        got = [r.id for r in placed.orderBy("place").collect()]
        assert placed.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (1, 20_000, 20_000)
        assert "Window" not in plan(placed)
        assert ranks.with_row_number(rows.where("false"), [F.col("id")], own).count() == 0
    values = {r.id: r.v for r in rows.collect()}
    assert got == sorted(values, key=lambda k: (-values[k], k))


def test_writers_of_snapshots_lose_nothing_and_show_nothing_half(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    assert snapshots.append(spark.range(10), path) == 1
    before = snapshots.read(spark, path)
    failures = []

    def writer(k):
        try:
            for step in range(3):
                snapshots.append(spark.range(100 * k + 10 * step, 100 * k + 10 * step + 10), path)
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=writer, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and snapshots.versions(spark, path) == list(range(1, 8))
    want = set(range(10)) | {100 * k + n for k in (1, 2) for n in range(30)}
    got = [r.id for r in snapshots.read(spark, path).collect()]
    assert len(got) == len(want) and set(got) == want
    assert before.count() == 10 and snapshots.read(spark, path, 1).count() == 10

    with monkeypatch.context() as m:  # dies when its files are written, before its claim
        m.setattr(snapshots, "_claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            snapshots.append(spark.range(5), path)
    assert snapshots.read(spark, path).count() == len(want)
    with pytest.raises(snapshots.CommitConflict):
        snapshots.replace(spark.range(1), path, base=3)
    assert snapshots.replace(spark.range(3), path, base=7) == 8
    assert snapshots.read(spark, path).count() == 3 and snapshots.read(spark, path, 7).count() == len(want)
    assert snapshots.vacuum(spark, path) > 0 and snapshots.versions(spark, path) == [8]
    assert snapshots.read(spark, path).count() == 3


# --- stations by URL ------------------------------------------------------------------------------


@pytest.fixture
def station_server():
    asked = collections.Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.strip("/"))
            asked[page] += 1
            if page == 2 and asked[page] == 1:  # busy at first
                self.send_error(503)
                return
            if page == 4:
                self.send_error(404)
                return
            terminal = lambda k: [] if k == 3 else [{"key": "TerminalName", "value": f"T{page}{k}"}]
            body = json.dumps([{"commonName": f"S{page}{k}", "lat": 51 + k, "lon": None if k == 2 else -1, "additionalProperties": terminal(k)} for k in range(4)]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{page}}", asked
    server.shutdown()


def test_station_pages_are_retried_and_those_left_out_are_not_fetched(spark, station_server):
    url, asked = station_server
    got = read_station_pages(spark, url, 3, wait=0.01)
    assert sorted(r.station_id for r in got.where("page in (1, 2)").collect()) == sorted(f"T{p}{k}" for p in (1, 2) for k in range(3))
    assert asked[2] >= 2 and asked[3] == 0
    one = read_station_pages(spark, url, 3, wait=0.01).where("station_id = 'T32'").collect()
    assert [(r.station_name, r.lat, r.lng, r.page) for r in one] == [("S32", 53.0, None, 3)]
    with pytest.raises(Exception, match="404"):
        read_station_pages(spark, url, 4, wait=0.01).where("page = 4").collect()


# --- cells and metres -----------------------------------------------------------------------------


def boxed_lengths(x1, y1, x2, y2, size):
    """Length inside every cell of the bounding box."""
    whole, out = math.hypot(x2 - x1, y2 - y1), {}
    for i in range(math.floor(min(x1, x2) / size), math.floor(max(x1, x2) / size) + 1):
        for j in range(math.floor(min(y1, y2) / size), math.floor(max(y1, y2) / size) + 1):
            low, high = 0.0, 1.0
            for a, b, near in ((x1, x2, i * size), (y1, y2, j * size)):
                if a != b:
                    s, e = sorted(((near - a) / (b - a), (near + size - a) / (b - a)))
                    low, high = max(low, s), min(high, e)
            if high - low > 1e-9:
                out[i, j] = (high - low) * whole
    return out


def test_edges_followed_from_line_to_line_equal_their_boxes(spark):
    draw = random.Random(9)
    edges = [(k, *(draw.uniform(-900, 900) for _ in range(4))) for k in range(300)] + [(300, 10.0, 20.0, 10.0, 700.0), (301, -650.0, 5.0, 30.0, 5.0), (302, 0.5, 0.5, 40_000.5, 39_999.0)]
    got = collections.defaultdict(dict)
    for r in spatial.segments_by_cell(spark.createDataFrame(edges, "k int, x1 double, y1 double, x2 double, y2 double"), (0.0, 0.0), 100.0).collect():
        got[r.k][r.grid_x, r.grid_y] = got[r.k].get((r.grid_x, r.grid_y), 0.0) + r.length_m
    for k, *ends in edges:
        if k == 302:
            assert len(got[k]) <= 802 and sum(got[k].values()) == pytest.approx(math.hypot(40_000, 39_998.5))
        else:
            assert got[k] == pytest.approx(boxed_lengths(*ends, 100.0), abs=1e-6)


def test_cells_at_a_border_have_the_area_inside_and_empty_cells_stay(spark):
    shape = [(0.0, 0.0), (250.0, 0.0), (0.0, 250.0)]
    city = spark.createDataFrame([("x", [{"x": x, "y": y} for x, y in shape])], "city string, shape array<struct<x:double,y:double>>")
    grid = spatial.city_grid(city, 100.0)
    areas = {(r.grid_x, r.grid_y): r.cell_area_km2 * 1e6 for r in grid.collect()}
    assert areas == pytest.approx({(0, 0): 10_000, (1, 0): 8750, (0, 1): 8750, (1, 1): 1250, (2, 0): 1250, (0, 2): 1250})
    none = spark.createDataFrame([], "city string, grid_x int, grid_y int, edge_m double, length_m double")
    road = spark.createDataFrame([("x", 1, 0, 40.0, 10.0)], none.schema)
    rows = {(r.grid_x, r.grid_y): (r.intersection_count, r.road_length_m, r.road_inside_m) for r in spatial.cell_table(grid, none.select("city", "grid_x", "grid_y"), road).collect()}
    assert rows == {c: (0, 40.0, 10.0) if c == (1, 0) else (0, 0.0, 0.0) for c in areas}


def test_transverse_mercator(spark):
    # fixed values: the meridian's quarter on WGS 84 is 10,001,965.729 m; at 0.9996 the origin lies at 500,000 m
    zone = projection.utm(31)
    pole = projection.project(spark.createDataFrame([(90.0 - 1e-9, 3.0), (0.0, 3.0)], "lat double, lng double"), zone).collect()
    assert pole[0].y == pytest.approx(0.9996 * 10_001_965.729, abs=1e-3) and (pole[1].x, pole[1].y) == (500_000.0, 0.0)
    # worked example of the British grid's guide (Airy 1830): 52 39 27.2531 N, 1 43 4.5177 E is 651,409.903 E 313,177.270 N
    airy = projection.Projection(meridian=-2.0, origin=49.0, scale=0.9996012717, east=400_000.0, north=-100_000.0, half_axis=6_377_563.396, flattening=1 - 6_356_256.909 / 6_377_563.396)
    at = projection.project(spark.createDataFrame([(52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600)], "lat double, lng double"), airy).first()
    assert (at.x, at.y) == (pytest.approx(651_409.903, abs=1e-3), pytest.approx(313_177.270, abs=1e-3))
    draw = random.Random(1)
    points = spark.createDataFrame([(draw.uniform(-80, 84), draw.uniform(-1, 7)) for _ in range(500)] + [(None, 3.0)], "a double, b double")
    back = projection.unproject(projection.project(points, zone, "a", "b"), zone).collect()
    assert max(max(abs(r.a - r.lat), abs(r.b - r.lng)) for r in back if r.a is not None) < 1e-9
    assert [r.x for r in back if r.a is None] == [None]
