"""Registered queries of layouts and algorithms for very large tables: many files, counters, sketches, bitmaps, buckets, ranks, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import projection
from ..operators import bucketed, coverage, heavy, sketches, spatial, trips
from ..operators import profile as P
from ..operators.ranks import with_row_number
from ..sources import counted, io, schemas, snapshots
from ..sources.scratch import Scratch
from ..sources.stations_source import read_station_pages
from . import proxies as Q
from .catalogue import _r, _rounded, _stations, query

# --- many files -----------------------------------------------------------------------------------

_VARIANTS = 4


def _varied_files(spark, d) -> list[str]:
    """Orders in files of four schemas."""
    o, total = Q.table(spark, d, "orders"), F.col("o_totalprice")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus").alias("status")
    variants = [
        [key.cast("int").alias("id"), total.cast("double").alias("total"), status],
        [key.cast("long").alias("id"), total.cast("double").alias("total"), status, F.col("o_orderpriority").alias("priority")],
        [key.cast("long").alias("id"), F.floor(total).cast("int").alias("total"), status],
        [status, key.cast("long").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("day")],
    ]
    with Scratch(spark) as own:
        root = own.place("varied-files")
        for k, columns in enumerate(variants):
            io.write_parquet(o.where(F.pmod(key, F.lit(_VARIANTS)) == k).select(*columns), f"{root}/part-{k}", files=6)
    return io.files_in(spark, root, "*.parquet", recursive=True)


@query("""select o_orderkey::bigint as id, case o_orderkey % 4 when 2 then floor(o_totalprice)::double when 3 then null else o_totalprice::double end as total, o_orderstatus as status,
  case when o_orderkey % 4 = 1 then o_orderpriority end as priority, case when o_orderkey % 4 = 3 then o_orderdate::timestamp end as day from orders""")
def many_files_union(spark, d):
    """Files of several schemas united by name, with one scan for each schema."""
    return schemas.read_files(spark, _varied_files(spark, d))


@query("""select k as variant, c as "column", t as dtype, count(*)::bigint as n_rows from orders join (values (0, 'id', 'int'), (0, 'total', 'double'), (0, 'status', 'string'), (1, 'id', 'bigint'), (1, 'total', 'double'),
  (1, 'status', 'string'), (1, 'priority', 'string'), (2, 'id', 'bigint'), (2, 'total', 'int'), (2, 'status', 'string'), (3, 'status', 'string'), (3, 'id', 'bigint'), (3, 'day', 'timestamp_ntz')) v(k, c, t) on o_orderkey % 4 = k group by all""")
def files_described(spark, d):
    """Columns, types and rows of files, from their footers."""
    found = schemas.describe_files(spark, _varied_files(spark, d))
    variant = F.regexp_extract("path", "part-([0-9])/", 1).cast("int")
    return found.groupBy(variant.alias("variant"), "column", "dtype").agg(F.sum("rows").alias("n_rows")).where("n_rows > 0")


_MINUTES = "(epoch_us(ended_at) - epoch_us(started_at)) / 60e6"
_COUNTERS = {
    "total_rows": "count(*)", "same_station": "count_if(start_station_id = end_station_id)", "ends_before_start": f"count_if({_MINUTES} < 0)", "over_a_day": f"count_if({_MINUTES} > 1440)",
    "under_a_minute": f"count_if({_MINUTES} >= 0 and {_MINUTES} < 1)", "not_positive": f"count_if({_MINUTES} <= 0)",
} | {f"null_{c}": f"count_if({c} is null)" for c in trips.RAW}


@query(" union all ".join(f"select '{n}' as name, {v}::bigint as value from c" for n, v in _COUNTERS.items()))
def written_counters(spark, d):
    """Quality counters and nulls by column of cleaned trips, gathered by the job that wrote them and read from beside the files."""
    rows = trips.clean_trips(Q.raw_trips(spark, d))
    with Scratch(spark) as own:
        path = own.place("counted-trips")
    counted.write_counted(rows, path, P.qc_counters() | P.null_counters(rows))
    return counted.counter_rows(spark, path)


# --- sketches, heavy hitters, bitmaps -------------------------------------------------------------


@query(" union all ".join(f"select city, '{n}' as point, count(trip_duration) as n, {_r('min(trip_duration)')} as least, {_r('max(trip_duration)')} as most, true as within from f group by city" for n in P.POINTS.values()))
def sketch_quantile_bounds(spark, d):
    """Quantiles by city from stored sketches by city and month: exact counts and extremes, and whether each rank is within the sketch's error."""
    with Scratch(spark) as own:
        f = own.keep(Q.featured(spark, d).select("city", "month", "trip_duration"), "durations")
        path = own.place("sketches")
    for half in (F.col("month") <= 6, F.col("month") > 6):  # what comes later is added by itself
        sketches.add_to_store(f.where(half), path, ["city", "month"], ["trip_duration"])
    stored = sketches.open_store(spark, path)
    whole = sketches.merge(stored, ["city"], ["trip_duration"]).select("city", sketches.known("trip_duration").alias("n"), *[X.rounded(sketches.quantile("trip_duration", p)).alias(c) for p, c in ((0, "least"), (1, "most"))])
    points = sketches.quantile_table(stored, ["city"], "trip_duration").select("city", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("point"), F.col(n).alias("v")) for p, n in P.POINTS.items()])).alias("e")).select("city", "e.*")
    ranks = f.join(points, "city").groupBy("city", "point").agg(F.count("*").alias("rows"), F.first("p").alias("p"), F.count_if(F.col("trip_duration") < F.col("v")).alias("below"), F.count_if(F.col("trip_duration") <= F.col("v")).alias("upto"))
    slack = F.col("rows") * sketches.RANK_ERROR + 1
    within = (F.col("below") <= F.col("p") * F.col("rows") + slack) & (F.col("upto") >= F.col("p") * F.col("rows") - slack)
    return ranks.select("city", "point", within.alias("within")).join(whole, "city").select("city", "point", "n", "least", "most", "within")


@query("select start_station_id, end_station_id, count(*) as n from c group by all order by n desc, start_station_id nulls first, end_station_id nulls first limit 20")
def heavy_routes(spark, d):
    """The most frequent pairs of stations, from summaries of the tasks and an exact count of their candidates."""
    return heavy.most_frequent(trips.clean_trips(Q.raw_trips(spark, d)).select("start_station_id", "end_station_id"), ["start_station_id", "end_station_id"], 20)


@query("select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 25")
def heavy_parts(spark, d):
    """The most frequent values of a column of many values, none of which stands out."""
    return heavy.most_frequent(Q.table(spark, d, "lineitem"), ["l_partkey"], 25)


def _event_hours(spark, d):
    return coverage.hour_bitmaps(Q.table(spark, d, "events"), ["event_type"], F.col("ts"), F.col("value").isNotNull() & (F.col("value") > 150)).withColumnRenamed("event_type", "source")


def _hour(spark, text: str) -> int:
    """The number of an hour."""
    return spark.range(1).select(coverage.hour_number(F.to_timestamp_ntz(F.lit(text)))).first()[0]


_HOURS = "h as (select distinct event_type as source, date_trunc('hour', ts) as hour from events where value > 150)"


@query(f"""with {_HOURS}, span as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:00:00', interval 1 hour)) as hour),
free as (select source, hour, row_number() over (partition by source order by hour) as k from (select distinct source from h) s, span where not exists (select 1 from h where h.source = s.source and h.hour = span.hour)),
runs as (select source, min(hour) as a, count(*) as n from free group by source, hour - k * interval 1 hour)
select s.source, (select count(*) from h where h.source = s.source and hour in (select hour from span)) as hours_covered, count(r.n) as n_gaps, coalesce(max(r.n), 0)::bigint as longest_gap, min(r.a) as first_gap
from (select distinct source from h) s left join runs r on r.source = s.source group by s.source""")
def hour_gaps(spark, d):
    """Hours of a month that each source covers, and the stretches that it doesn't, from bitmaps."""
    bits, span = _event_hours(spark, d), (_hour(spark, "2024-01-01 00:00:00"), _hour(spark, "2024-01-30 23:00:00"))
    have = coverage.covered(coverage.within(bits, ["source"], *span), ["source"])
    length = F.col("to_hour") - F.col("from_hour") + 1
    missing = coverage.gaps(bits, ["source"], *span).groupBy("source").agg(F.count("*").alias("n_gaps"), F.max(length).alias("longest_gap"), coverage.hour_of(F.min("from_hour")).alias("first_gap"))
    out = bits.select("source").distinct().join(have, "source", "left").join(missing, "source", "left")
    return out.na.fill({"hours_covered": 0, "n_gaps": 0, "longest_gap": 0}).select("source", "hours_covered", "n_gaps", "longest_gap", "first_gap")


@query(f"""with {_HOURS}, p as (select a.source as a, b.source as b from (select distinct source from h) a, (select distinct source from h) b where a.source < b.source)
select a, b, (select count(distinct hour) from h where source in (a, b)) as hours_any, (select count(*) from (select hour from h where source in (a, b) group by hour having count(*) = 2)) as hours_both from p""")
def source_pairs(spark, d):
    """For each two sources, the hours that one of them covers and those that both do."""
    return coverage.pair_coverage(_event_hours(spark, d))


@query(f"""with {_HOURS}, p as (select a.source as a, b.source as b from (select distinct source from h) a, (select distinct source from h) b where a.source < b.source)
select a, b, (select count(distinct hour) from h where source in (a, b)) as hours_any, (select count(*) from (select hour from h where source in (a, b) group by hour having count(*) = 2)) as hours_both from p order by hours_any desc, hours_both, a, b limit 1""")
def best_source_pair(spark, d):
    return coverage.best_pair(_event_hours(spark, d))


# --- buckets, ranks, versions ---------------------------------------------------------------------


@query(f"""select t.city, count(*) as n, count_if(w.city is null)::bigint as unmatched, sum(rain_flag)::bigint as rain_rows, {_r('avg(temperature_c)')} as avg_temperature from t left join w on t.city = w.city
  and date_trunc('hour', t.weather_at) = w.weather_hour group by t.city""", weather=True)
def bucketed_weather_join(spark, d):
    """Trips and weather laid out by city and hour, with hot hours salted, joined without an exchange."""
    layout = bucketed.lay_out(Q.trips_with_hour(spark, d), Q.weather(spark, d), ["city", "weather_hour"])
    return layout.joined(["rain_flag", "temperature_c"]).groupBy("city").agg(
        F.count("*").alias("n"), F.count_if(F.col("rain_flag").isNull()).alias("unmatched"), F.sum("rain_flag").alias("rain_rows"), X.rounded(F.avg("temperature_c")).alias("avg_temperature")
    )


@query("select l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as place from lineitem")
def price_places(spark, d):
    """The place of every line by price, without a window over all rows."""
    with Scratch(spark) as own:
        rows = Q.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
        placed = with_row_number(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], own, "place")
    return placed.select("l_orderkey", "l_linenumber", "place")


@query("""select 1 as version, o_orderstatus as status, count(*) as n from orders where o_orderstatus <> 'P' group by 2 union all select 2, o_orderstatus, count(*) from orders group by 2
union all select 3, o_orderstatus, count(*) from orders where o_orderstatus = 'P' group by 2""")
def snapshot_versions(spark, d):
    """A table of snapshots after an append and a replacement: each version as it was."""
    o = Q.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    with Scratch(spark) as own:
        path = own.place("snapshots")
    snapshots.append(o.where("status != 'P'"), path)
    snapshots.append(o.where("status = 'P'"), path)
    snapshots.replace(o.where("status = 'P'"), path, base=2)
    counts = [snapshots.read(spark, path, v).groupBy(F.lit(v).alias("version"), "status").agg(F.count("*").alias("n")) for v in (1, 2, 3)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("select s_suppkey::varchar as station_id, s_name as station_name, 41.80e0 + (s_suppkey % 10) * 0.013e0 as lat, -87.70e0 + floor(s_suppkey / 10.0e0) * 0.017e0 as lng, (s_suppkey % 3 + 1)::int as page from supplier where s_suppkey % 7 <> 0 and s_suppkey % 3 <> 2")
def stations_by_url(spark, d):
    """Stations read page by page from URLs, without those that have no terminal name; the third page is not fetched."""
    k = F.col("station_id").cast("long")
    terminal = F.when(k % 7 != 0, F.array(F.struct(F.lit("TerminalName").alias("key"), F.col("station_id").alias("value")))).otherwise(F.array(F.struct(F.lit("Docks").alias("key"), F.lit("9").alias("value"))))
    items = _stations(spark, d).select((k % 3 + 1).cast("int").alias("page"), F.struct(F.col("station_name").alias("commonName"), "lat", F.col("lng").alias("lon"), terminal.alias("additionalProperties")).alias("item"))
    with Scratch(spark) as own:
        root = own.place("station-pages")
    for page in (1, 2, 3):
        items.where(F.col("page") == page).agg(F.coalesce(F.to_json(F.collect_list("item")), F.lit("[]")).alias("value")).write.text(f"{root}/{page}")
        io.move(spark, io.files_in(spark, f"{root}/{page}", "*.txt")[0], f"{root}/{page}.json")
    url = io.files_in(spark, root, "1.json")[0].removesuffix("1.json")
    url = f"file://{url.removeprefix('file://').removeprefix('file:')}{{page}}.json"
    return read_station_pages(spark, url, 3).where("page in (1, 2)")


# --- cells and metres -----------------------------------------------------------------------------

_SIZE = 250.0
_EDGES = """e as (select s_suppkey as k, (s_suppkey * 37 % 1000) + 0.5e0 as x1, (s_suppkey * 91 % 1000) + 0.5e0 as y1, (s_suppkey * 53 % 1000) + 0.5e0 as x2, (s_suppkey * 17 % 1000) + 0.5e0 as y2 from supplier),
b as (select *, unnest(range(floor(least(x1, x2) / 250e0)::bigint, floor(greatest(x1, x2) / 250e0)::bigint + 1)) as grid_x from e),
b2 as (select *, unnest(range(floor(least(y1, y2) / 250e0)::bigint, floor(greatest(y1, y2) / 250e0)::bigint + 1)) as grid_y from b),
tt as (select *, coalesce((grid_x * 250e0 - x1) / nullif(x2 - x1, 0), 0e0) as tx0, coalesce((grid_x * 250e0 + 250e0 - x1) / nullif(x2 - x1, 0), 1e0) as tx1,
  coalesce((grid_y * 250e0 - y1) / nullif(y2 - y1, 0), 0e0) as ty0, coalesce((grid_y * 250e0 + 250e0 - y1) / nullif(y2 - y1, 0), 1e0) as ty1 from b2),
cl as (select *, greatest(0e0, least(tx0, tx1), least(ty0, ty1)) as enter, least(1e0, greatest(tx0, tx1), greatest(ty0, ty1)) as leave, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as edge_m from tt),
sg as (select k, grid_x::int as grid_x, grid_y::int as grid_y, edge_m, edge_m * (leave - enter) as length_m from cl where leave - enter > 1e-12)"""


def _supplier_edges(spark, d):
    s = F.col("s_suppkey")
    at = lambda factor, name: (F.pmod(s * factor, F.lit(1000)) + F.lit(0.5)).cast("double").alias(name)
    edges = Q.table(spark, d, "supplier").select(s.alias("k"), at(37, "x1"), at(91, "y1"), at(53, "x2"), at(17, "y2"))
    return edges.withColumn("edge_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


@query(f"with {_EDGES} select k, grid_x, grid_y, {_r('length_m')} as length_m from sg")
def edges_in_cells(spark, d):
    """Each edge's length in every cell that it crosses, followed from line to line."""
    return _rounded(spatial.segments_by_cell(_supplier_edges(spark, d), (0.0, 0.0), _SIZE).select("k", "grid_x", "grid_y", "length_m"), ["length_m"])


# an angle of two rectangles, whose parts in a cell add up
_ANGLE = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 400.0), (600.0, 400.0), (600.0, 1000.0), (0.0, 1000.0)]
_PART = "greatest(0e0, least(i * 250e0 + 250e0, {x}e0) - i * 250e0) * greatest(0e0, least(j * 250e0 + 250e0, {y1}e0) - greatest(j * 250e0, {y0}e0))"


@query(f"""with {_EDGES}, cells as (select i::int as grid_x, j::int as grid_y, ({_PART.format(x=1000, y0=0, y1=400)} + {_PART.format(x=600, y0=400, y1=1000)}) / 1e6 as area from range(4) a(i), range(4) b(j)),
n as (select floor((s_suppkey * 37 % 1000) / 250e0)::int as grid_x, floor((s_suppkey * 91 % 1000) / 250e0)::int as grid_y, count(*) as c from supplier where s_suppkey % 5 = 0 group by all),
r as (select grid_x, grid_y, sum(edge_m) as whole, sum(length_m) as inside from sg group by all)
select 'x_' || grid_x || '_' || grid_y as cell_id, 'x' as city, grid_x, grid_y, {_r('area')} as cell_area_km2, coalesce(c, 0)::bigint as intersection_count, {_r('coalesce(whole, 0)', 4)} as road_length_m, {_r('coalesce(inside, 0)', 4)} as road_inside_m,
  {_r('coalesce(c, 0) / area', 4)} as intersection_density, {_r('coalesce(whole, 0) / area', 2)} as road_density, {_r('coalesce(inside, 0) / area', 2)} as road_inside_density
from cells left join n using (grid_x, grid_y) left join r using (grid_x, grid_y) where area > 0""")
def grid_density(spark, d):
    """All cells of a city, those without crossings among them, with their area inside its border."""
    s = F.col("s_suppkey")
    city = spark.createDataFrame([("x", [{"x": x, "y": y} for x, y in _ANGLE])], "city string, shape array<struct<x:double,y:double>>")
    points = Q.table(spark, d, "supplier").where(s % 5 == 0).select(F.lit("x").alias("city"), F.pmod(s * 37, F.lit(1000)).cast("double").alias("x"), F.pmod(s * 91, F.lit(1000)).cast("double").alias("y"))
    edges = spatial.segments_by_cell(_supplier_edges(spark, d).withColumn("city", F.lit("x")), (0.0, 0.0), _SIZE)
    out = spatial.cell_table(spatial.city_grid(city, _SIZE), spatial.with_cells(points, "x", "y", (0.0, 0.0), _SIZE), edges)
    out = _rounded(_rounded(out, ["cell_area_km2"]), ["road_length_m", "road_inside_m", "intersection_density"], 4)
    return _rounded(out, ["road_density", "road_inside_density"], 2)


def _projected_sql(p: projection.Projection, columns: str, source: str) -> str:
    e, c = p.eccentricity, p.series(projection._FORWARD)
    x = " + ".join(f"{a!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(c, 1))
    y = " + ".join(f"{a!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(c, 1))
    return f"""with p1 as (select *, sinh(atanh(sin(radians(lat))) - {e!r}::double * atanh({e!r}::double * sin(radians(lat)))) as tt, radians(lng - ({p.meridian!r}::double)) as ll from ({source})),
p2 as (select *, atan2(tt, cos(ll)) as xi, asinh(sin(ll) / sqrt(tt * tt + cos(ll) * cos(ll))) as eta from p1)
select {columns}, {_r(f'{p.east!r}::double + {p.radius!r}::double * (eta + {y})', 3)} as x, {_r(f'{p.north - p.origin_north!r}::double + {p.radius!r}::double * (xi + {x})', 3)} as y from p2"""


@query(_projected_sql(projection.utm(16), f"station_id, {_r('lat')} as lat, {_r('lng')} as lng", "select s_suppkey::varchar as station_id, 41.80e0 + (s_suppkey % 10) * 0.013e0 as lat, -87.70e0 + floor(s_suppkey / 10.0e0) * 0.017e0 as lng from supplier"))
def projected_stations(spark, d):
    """Stations in metres, and the degrees that lead back from them."""
    zone = projection.utm(16)
    metres = projection.project(_stations(spark, d), zone).select("station_id", "x", "y")
    back = projection.unproject(metres, zone)
    return _rounded(_rounded(back, ["x", "y"], 3), ["lat", "lng"]).select("station_id", "lat", "lng", "x", "y")
