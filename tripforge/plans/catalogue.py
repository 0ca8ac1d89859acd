"""The registered queries over the driver tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import BINARY, CATEGORIES, CONTINUOUS, CYCLICAL, DISCRETE, FEATURED, FILTERED, GENERATIVE_CATEGORICAL, GENERATIVE_CONTINUOUS, STRATA, WEATHER_VALUES
from ..functions import exprs as X
from ..operators import enrich, evaluate, mlprep, sample, trips
from ..operators import profile as P
from ..sources import io
from ..sources.scratch import Scratch
from . import pipelines
from . import proxies as Q

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
STAR = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]
#: Depth of the registered forest: the published one has no limit, and Spark's deepest (30) takes hours on a large table.
UTILITY_DEPTH = 10
TABLES = [*STAR, "benchmark", "conversations", "documents", "embeddings", "labels", "pages"]


def query(sql: str | None = None, weather: bool = False):
    """Register a function (spark, sf_dir); ``sql`` may use t, c, f, k of the trips, and w of the weather."""

    def add(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            text = sql.strip()
            ctes = [x for x in (Q.SQL_TRIPS, Q.SQL_WEATHER if weather else "") if x]
            _SQL[function.__name__] = f"with {','.join(ctes)}\n" + (f", {text[5:]}" if text.startswith("with ") else text)
        return function

    return add


def queries() -> dict:
    """Queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return dict(_SQL)


def _r(x: str, digits: int = 6) -> str:
    return f"round(({x})::double, {digits}) + 0e0"


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: X.rounded(F.col(c), digits) for c in columns})


_PLACE = ["start_lat", "start_lng", "end_lat", "end_lng"]
_CLEAN_SQL = f"select rideable_type, started_at, ended_at, start_station_id, end_station_id, {', '.join(f'{_r(c)} as {c}' for c in _PLACE)}, member_casual, city from"


# --- cleaning, features, rule ---------------------------------------------------------------------


@query(f"{_CLEAN_SQL} c")
def clean_trips(spark, d):
    return _rounded(trips.clean_trips(Q.raw_trips(spark, d)), _PLACE)


@query(f"select distinct * from ({_CLEAN_SQL} (select * from c union all select * from c where l_linenumber = 3))")
def clean_trips_distinct(spark, d):
    raw = Q.raw_trips(spark, d, ("l_linenumber",))
    twice = raw.unionByName(raw.where("l_linenumber = 3")).drop("l_linenumber")
    return _rounded(trips.clean_trips(twice, distinct=True), _PLACE)


@query(_CLEAN_SQL.replace(", city from", ", city, l_linenumber from") + " c")
def clean_trips_all_columns(spark, d):
    """Cleaned trips with a column that cleaning doesn't know."""
    return _rounded(trips.clean_trips(Q.raw_trips(spark, d, ("l_linenumber",)), keep=True), _PLACE)


@query("select city, strftime(started_at, '%Y-%m-%d') as day, strftime(started_at, '%Y-%m') as month_text, dayname(started_at) as day_name, count(*) as n from c group by all")
def daily_counts(spark, d):
    c = trips.clean_trips(Q.raw_trips(spark, d))
    return c.groupBy("city", X.date_text(F.col("started_at")).alias("day"), X.month_text(F.col("started_at")).alias("month_text"), X.day_name(F.col("started_at")).alias("day_name")).agg(F.count("*").alias("n"))


@query(f"select city, {_r('sum((epoch_us(ended_at) - epoch_us(started_at)) / 60e6)')} as minutes from c group by city")
def fractional_durations(spark, d):
    rows = trips.trip_features(trips.clean_trips(Q.raw_trips(spark, d)), fractional=True)
    return rows.groupBy("city").agg(X.rounded(F.sum("trip_duration")).alias("minutes"))


_REAL = ["start_lat", "start_lng", "end_lat", "end_lng", "trip_duration", "hour_sin", "hour_cos", "delta_lat", "delta_lng", "haversine_distance_km", "bearing", "bearing_sin", "bearing_cos"]


def _columns_sql(names: list[str]) -> str:
    return ", ".join(f"{_r(c)} as {c}" if c in _REAL else c for c in names)


@query(f"select {_columns_sql(FEATURED)} from f")
def trip_features(spark, d):
    return _rounded(Q.featured(spark, d), _REAL)


@query(f"select {_columns_sql(FILTERED)} from k")
def filter_trips(spark, d):
    return _rounded(Q.filtered(spark, d), [c for c in FILTERED if c in _REAL])


_RULE = "trip_duration > 1 and trip_duration < 100 and (haversine_distance_km > 0.05 or same_station = 1) and haversine_distance_km < 12"


@query(f"""
select count(*) as total_rows, count_if({_RULE})::bigint as kept_rows, (count(*) - count_if({_RULE}))::bigint as removed_rows, count_if(not trip_duration > 1)::bigint as too_short,
  count_if(not trip_duration < 100)::bigint as too_long, count_if(not (haversine_distance_km > 0.05 or same_station = 1))::bigint as too_near,
  count_if(not haversine_distance_km < 12)::bigint as too_far, count_if(not ({_RULE}))::bigint as breaks_rule from f""")
def filter_report(spark, d):
    return trips.rule_report(Q.featured(spark, d))


@query(f"select city, count(*) as total_rows, count_if(not ({_RULE}))::bigint as removed_rows, {_r(f'100e0 * count_if(not ({_RULE})) / count(*)', 4)} as removed_pct from f group by city")
def filter_impact_by_city(spark, d):
    return trips.impact_by_city(Q.featured(spark, d))


# --- profile --------------------------------------------------------------------------------------

_SUMMARY = ", ".join(f"{_r(f'{g}({c})')} as {g}_{c}" for c in ("trip_duration", "haversine_distance_km") for g in ("avg", "median", "min", "max"))


@query(f"select city, count(*) as total_rows, {_SUMMARY} from f group by city")
def basic_summary(spark, d):
    return P.basic_summary(Q.featured(spark, d))


@query(f"select member_casual, count(*) as total_rows, {_SUMMARY} from f group by member_casual")
def user_type_summary(spark, d):
    return P.basic_summary(Q.featured(spark, d), ["member_casual"])


@query(f"select city, part_of_day, count(*) as total_rows, {_SUMMARY} from f group by all")
def part_of_day_summary(spark, d):
    return P.basic_summary(Q.featured(spark, d), ["city", "part_of_day"])


_MEANS = f"count(*) as n, {_r('avg(trip_duration)')} as avg_duration, {_r('avg(haversine_distance_km)')} as avg_distance, {_r('avg(same_station)')} as same_station_rate"


@query(f"select city, {_MEANS} from f group by city")
def cross_city(spark, d):
    return P.group_means(Q.featured(spark, d), ["city"])


@query(f"select city, rideable_type, member_casual, {_MEANS} from f group by all")
def composition_by_type(spark, d):
    return P.group_means(Q.featured(spark, d), ["city", "rideable_type", "member_casual"])


@query(f"select city, same_station, rideable_type, {_MEANS} from f where haversine_distance_km <= 0.05 group by all")
def short_distance_breakdown(spark, d):
    return P.short_distance_breakdown(Q.featured(spark, d))


@query(f"select city, member_casual, rideable_type, {_MEANS} from f where trip_duration >= 100 group by all")
def long_duration_breakdown(spark, d):
    return P.long_duration_breakdown(Q.featured(spark, d))


def _quantile_sql(column: str) -> str:
    return "select city, " + ", ".join(f"{_r(f'quantile_cont({column}, {p})')} as {n}" for p, n in P.POINTS.items()) + " from f group by city"


@query(_quantile_sql("trip_duration"))
def duration_quantiles_exact(spark, d):
    return P.quantile_table(Q.featured(spark, d), "trip_duration")


@query(_quantile_sql("haversine_distance_km"))
def distance_quantiles_exact(spark, d):
    return P.quantile_table(Q.featured(spark, d), "haversine_distance_km")


@query()
def duration_quantiles_approx(spark, d):
    return P.quantile_table(Q.featured(spark, d), "trip_duration", approximate=True)


@query()
def distance_quantiles_approx(spark, d):
    return P.quantile_table(Q.featured(spark, d), "haversine_distance_km", approximate=True)


@query(" union all ".join(f"select city, '{n}' as point, true as within from f group by city" for n in P.POINTS.values()))
def approximate_quantile_bounds(spark, d):
    """Whether each approximate quantile's rank is within one in 10,000 rows of the rank asked for."""
    with Scratch(spark) as own:
        f = own.keep(Q.featured(spark, d).select("city", "trip_duration"), "durations")
    points = P.quantile_table(f, "trip_duration", approximate=True).select("city", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("point"), F.col(n).alias("v")) for p, n in P.POINTS.items()])).alias("e")).select("city", "e.*")
    ranks = f.join(points, "city").groupBy("city", "point").agg(F.count("*").alias("n"), F.first("p").alias("p"), F.count_if(F.col("trip_duration") < F.col("v")).alias("below"), F.count_if(F.col("trip_duration") <= F.col("v")).alias("upto"))
    slack = F.col("n") / 10_000 + 1
    return ranks.select("city", "point", ((F.col("below") <= F.col("p") * F.col("n") + slack) & (F.col("upto") >= F.col("p") * F.col("n") - slack)).alias("within"))


@query(f"""select city, count(*) as total_rows, count_if(trip_duration <= 1)::bigint as too_short, count_if(trip_duration >= 100)::bigint as too_long,
  {_r('100e0 * count_if(trip_duration <= 1) / count(*)', 4)} as too_short_pct, {_r('100e0 * count_if(trip_duration >= 100) / count(*)', 4)} as too_long_pct from f group by city""")
def duration_threshold_impact(spark, d):
    return P.duration_impact(Q.featured(spark, d))


_NEAR_OTHER, _NEAR_SAME = "count_if(haversine_distance_km <= 0.05 and same_station <> 1)", "count_if(haversine_distance_km <= 0.05 and same_station = 1)"


@query(f"""select city, count(*) as total_rows, {_NEAR_OTHER}::bigint as near_zero_other, {_NEAR_SAME}::bigint as near_zero_same, count_if(haversine_distance_km >= 12)::bigint as too_far,
  {_r(f'100e0 * {_NEAR_OTHER} / count(*)', 4)} as near_zero_other_pct, {_r('100e0 * count_if(haversine_distance_km >= 12) / count(*)', 4)} as too_far_pct from f group by city""")
def distance_threshold_impact(spark, d):
    return P.distance_impact(Q.featured(spark, d))


_FLAGS = """(select *, case when trip_duration <= 1 then 'too_short' when trip_duration >= 100 then 'too_long' else 'normal' end as duration_flag,
  case when haversine_distance_km >= 12 then 'too_far' when haversine_distance_km <= 0.05 and same_station = 1 then 'same_station_near_zero' when haversine_distance_km <= 0.05 then 'different_station_near_zero'
    else 'normal' end as distance_flag from f)"""


@query(f"select city, duration_flag, distance_flag, count(*) as n from {_FLAGS} where duration_flag <> 'normal' or distance_flag <> 'normal' group by all")
def suspicious_summary(spark, d):
    return P.suspicious_trips(Q.featured(spark, d))


@query(f"select city, duration_flag, distance_flag, count(*) as n from {_FLAGS} group by all having duration_flag <> 'normal' or distance_flag <> 'normal'")
def suspicious_summary_having(spark, d):
    return P.suspicious_trips(Q.featured(spark, d), before=False)


def _distribution(name: str, by: list[str]):
    @query(f"select {', '.join(by)}, count(*) as n, {_r('100e0 * count(*) / sum(count(*)) over ()', 4)} as pct from f group by all".replace("group by all", f"group by {', '.join(by)}"))
    def distribution(spark, d):
        return P.group_counts(Q.featured(spark, d), by)

    _QUERIES[name], _SQL[name] = _QUERIES.pop("distribution"), _SQL.pop("distribution")


for _name, _by in (("hour_distribution", ["city", "hour"]), ("weekday_distribution", ["city", "day_of_week"]), ("month_distribution", ["city", "month"]), ("member_distribution", ["city", "member_casual"]), ("rideable_distribution", ["city", "rideable_type"])):
    _distribution(_name, _by)


@query(f"select city, part_of_day, count(*) as n, {_r('avg(same_station)')} as same_station_rate from f group by all")
def same_station_rate(spark, d):
    return Q.featured(spark, d).groupBy("city", "part_of_day").agg(F.count("*").alias("n"), X.rounded(F.avg("same_station")).alias("same_station_rate"))


def _corr_sql(x: str, y: str, source: str = "") -> str:
    return f"case when isnan(corr({x}, {y})) then null else {_r(f'corr({x}, {y})', 7)} end"


@query(f"select city, count(*) as n, {_corr_sql('trip_duration', 'haversine_distance_km')} as corr from f group by city")
def duration_distance_corr(spark, d):
    return P.corr_by(Q.featured(spark, d), ["city"])


@query(f"select city, rideable_type, member_casual, count(*) as n, {_corr_sql('trip_duration', 'haversine_distance_km')} as corr from k group by all")
def correlation_summary(spark, d):
    return P.corr_by(Q.filtered(spark, d), ["city", "rideable_type", "member_casual"])


_MATRIX = ["trip_duration", "haversine_distance_km", "same_station", "hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos", "delta_lat", "delta_lng", "bearing"]


@query(" union all ".join(f"select '{x}' as x, '{y}' as y, {_corr_sql(x, y)} as corr from f" for x in _MATRIX for y in _MATRIX))
def correlation_matrix(spark, d):
    return P.correlation_matrix(Q.featured(spark, d), _MATRIX)


@query("select city, hour, count(*) as n, (row_number() over (partition by city order by count(*) desc, hour))::int as rn from f group by city, hour qualify rn <= 3")
def peak_hours_top3(spark, d):
    return P.top_hours(Q.featured(spark, d))


@query()
def data_quality_report(spark, d):
    return P.quality_report({t: Q.table(spark, d, t) for t in TABLES})


# The columns of the driver tables.
_COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "region": "r_regionkey r_name", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "benchmark": "item_id text", "conversations": "conv_id turn role text", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "labels": "doc_id quality toxic", "pages": "page_id url html",
}
_TYPE = "case typeof(any_value({c})) when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' when 'DOUBLE[]' then 'array<double>' else lower(typeof(any_value({c}))) end"
_SQL["data_quality_report"] = " union all ".join(
    f"select '{t}' as file, '{c}' as \"column\", {_TYPE.format(c=c)} as dtype, count(*) as rows, count(*) - count({c}) as null_count, {_r(f'100e0 * (count(*) - count({c})) / count(*)', 2)} as null_percent, count({c}) as non_null_count from {t}"
    for t, columns in _COLUMNS.items() for c in columns.split()
)


@query(
    " union all ".join(
        f"select '{c}' as \"column\", count({c}) as count, {_r(f'avg({c})')} as mean, {_r(f'stddev_samp({c})')} as std, {_r(f'min({c})')} as min, {_r(f'max({c})')} as max, {_r(f'quantile_cont({c}, 0.25)')} as p25, {_r(f'quantile_cont({c}, 0.5)')} as p50, {_r(f'quantile_cont({c}, 0.75)')} as p75 from f"
        for c in ("trip_duration", "haversine_distance_km", "bearing")
    )
)
def describe_numeric(spark, d):
    return P.describe(Q.featured(spark, d), ["trip_duration", "haversine_distance_km", "bearing"])


@query(f"select start_station_id as value, count(*) as n, {_r('100e0 * count(*) / sum(count(*)) over ()', 4)} as pct from c group by 1")
def value_counts_pct(spark, d):
    return P.value_counts(trips.clean_trips(Q.raw_trips(spark, d)), "start_station_id")


_MINUTES = "(epoch_us(ended_at) - epoch_us(started_at)) / 60e6"


@query(f"""select count(*) as total_rows, count_if(start_station_id = end_station_id)::bigint as same_station, count_if({_MINUTES} < 0)::bigint as ends_before_start, count_if({_MINUTES} > 1440)::bigint as over_a_day,
  count_if({_MINUTES} >= 0 and {_MINUTES} < 1)::bigint as under_a_minute, count_if({_MINUTES} <= 0)::bigint as not_positive from c""")
def qc_checks(spark, d):
    return P.qc_checks(trips.clean_trips(Q.raw_trips(spark, d)))


@query("""with u as (select l_orderkey, l_linenumber, l_returnflag from lineitem), u2 as (select count(*) as n from u group by l_orderkey, l_linenumber, l_returnflag)
select (select sum(n) from u2)::bigint as total_rows, (select sum(n - 1) from u2)::bigint as repeated_rows, (select sum(n - 1) from (select count(*) as n from u group by l_orderkey))::bigint as repeated_values""")
def duplicates_report(spark, d):
    return P.duplicates(Q.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey")


@query(
    "select n.day_of_week::int as day_of_week, day_name, " + ", ".join(f"nullif(count_if(hour = {h}), 0)::bigint as h{h:02d}" for h in range(24))
    + " from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(P.DAYS)) + ") n(day_of_week, day_name) left join f on f.day_of_week = n.day_of_week group by all"
)
def day_hour_pivot(spark, d):
    return P.day_hour_pivot(Q.featured(spark, d))


@query(f"""select city, least(59, floor(trip_duration / 2e0))::int as bin, count(*) as n, {_r('count(*) / (sum(count(*)) over (partition by city) * 2e0)')} as density
  from f where trip_duration between 0 and 120 group by city, bin""")
def histogram_bins(spark, d):
    return P.histogram(Q.featured(spark, d), "trip_duration", 0.0, 120.0, 60)


@query(f"""with q as (select city, quantile_cont(trip_duration, 0.25) as q1, quantile_cont(trip_duration, 0.5) as q2, quantile_cont(trip_duration, 0.75) as q3 from f group by city)
select city, {_r('min(trip_duration)')} as low, {_r('any_value(q1)')} as q1, {_r('any_value(q2)')} as q2, {_r('any_value(q3)')} as q3, {_r('max(trip_duration)')} as high
from f join q using (city) where trip_duration between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by city""")
def boxplot_stats(spark, d):
    return P.boxplot(Q.featured(spark, d), "trip_duration", ["city"])


# --- samples --------------------------------------------------------------------------------------

_STRATA = ["city", *STRATA]
_KEYS = ", ".join(_STRATA)
_ALLOCATE = f"""with s as (select {_KEYS}, count(*) as strata_size from k group by all), n as (select sum(strata_size) as total from s),
a as (select s.*, strata_size * GOAL::double / total as raw, GOAL as goal from s, n), b as (select *, floor(raw)::bigint as base, raw - floor(raw) as frac from a),
r as (select *, row_number() over (order by frac desc, {_KEYS}) as rank, goal - sum(base) over () as extra from b),
alloc as (select {_KEYS}, strata_size, (base + case when rank <= extra then 1 else 0 end)::bigint as target_in_stratum from r)"""
_GOAL = _ALLOCATE.replace("GOAL", "least(5000, total)")
_TEST = _ALLOCATE.replace("GOAL", "ceil(total * 0.2e0)")


@query(f"""with s as (select {_KEYS}, count(*) as strata_size from k group by all)
select sum(strata_size)::bigint as total_rows, count(*) as n_strata, min(strata_size) as min_size, max(strata_size) as max_size, {_r('avg(strata_size)')} as avg_size, count_if(strata_size < 10)::bigint as below_10,
  count_if(strata_size < 50)::bigint as below_50, count_if(strata_size < 100)::bigint as below_100, least(1000000, sum(strata_size))::bigint as sample_rows from s""")
def strata_report(spark, d):
    return _rounded(sample.strata_report(Q.filtered(spark, d), 1_000_000, _STRATA), ["avg_size"])


@query(f"select {_KEYS}, count(*) as strata_size from k group by all order by strata_size, {_KEYS} limit 10")
def smallest_strata(spark, d):
    return sample.smallest_strata(Q.filtered(spark, d), _STRATA)


@query(f"{_GOAL} select * from alloc")
def allocation_largest_remainder(spark, d):
    return sample.allocate(sample.strata_sizes(Q.filtered(spark, d), _STRATA), _STRATA, 5000)


@query(f"{_GOAL} select {_KEYS}, target_in_stratum as n from alloc where target_in_stratum > 0")
def stratified_sample_counts(spark, d):
    return sample.stratified_sample(Q.filtered(spark, d), 5000, _STRATA).groupBy(*_STRATA).agg(F.count("*").alias("n"))


@query()
def stratified_sample_rows(spark, d):
    return sample.stratified_sample(Q.filtered(spark, d), 5000, _STRATA)


@query()
def uniform_sample_n(spark, d):
    return sample.uniform_sample(Q.filtered(spark, d), 2000)


@query("select 'uniform' as sample, least(2000, count(*)) as n, least(2000, count(*)) as distinct_ids, least(2000, count(*)) as members from k union all select 'stratified', least(5000, count(*)), least(5000, count(*)), least(5000, count(*)) from k")
def sample_membership(spark, d):
    """Rows, different rows, and rows of the source in two samples of numbered trips."""
    with Scratch(spark) as own:
        rows = own.keep(Q.filtered(spark, d).withColumn("row_id", F.monotonically_increasing_id()), "numbered-trips")
    both = sample.uniform_sample(rows, 2000).withColumn("sample", F.lit("uniform")).unionByName(sample.stratified_sample(rows, 5000, _STRATA).withColumn("sample", F.lit("stratified")))
    source = rows.select(*[F.col(c).alias(f"{c}_") for c in rows.columns])
    same = F.col("row_id") == F.col("row_id_")
    for c in rows.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return both.join(source, same, "left").groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("distinct_ids"), F.count("row_id_").alias("members"))


def _split_rows(rows):
    """Rows of strata with at least two rows."""
    sizes = sample.strata_sizes(rows, _STRATA).where("strata_size >= 2").drop("strata_size")
    return rows.join(sizes, _STRATA, "left_semi")


_SPLIT = _TEST.replace("count(*) as strata_size from k group by all", "count(*) as strata_size from k group by all having count(*) >= 2")


@query(f"{_SPLIT} select {_KEYS}, target_in_stratum as test_rows, strata_size - target_in_stratum as train_rows from alloc")
def split_counts(spark, d):
    split = sample.stratified_split(_split_rows(Q.filtered(spark, d)), _STRATA)
    return split.groupBy(*_STRATA).agg(F.count_if(F.col("split") == "test").alias("test_rows"), F.count_if(F.col("split") == "train").alias("train_rows"))


_KEPT = "(select sum(strata_size) as n, ceil(sum(strata_size) * 0.2e0) as test from (select count(*) as strata_size from k group by KEYS having count(*) >= 2))".replace("KEYS", _KEYS)


@query(f"select n::bigint as total_rows, n::bigint as ids, 0::bigint as in_both from {_KEPT}")
def split_overlap(spark, d):
    with Scratch(spark) as own:
        rows = own.keep(Q.filtered(spark, d).withColumn("row_id", F.monotonically_increasing_id()), "numbered-trips")
    split = sample.stratified_split(_split_rows(rows), _STRATA)
    sides = split.groupBy("row_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("sides"))
    return sides.agg(F.sum("n").alias("total_rows"), F.count("*").alias("ids"), F.count_if(F.col("sides") > 1).alias("in_both"))


@query(f"select 'test' as side, test::bigint as n from {_KEPT} union all select 'train', (n - test)::bigint from {_KEPT}")
def locked_split_counts(spark, d):
    """Train and test files, written once: the second call finds them and leaves them."""
    with Scratch(spark) as own:
        layout = pipelines.Layout(own.place("splits"))
        source = layout.path("all", "filtered")
        io.write_parquet(_split_rows(Q.filtered(spark, d)), source)
        for _ in range(2):
            train, test = pipelines.locked_split(spark, "all", source, layout, _STRATA)
    side = lambda path, name: spark.read.parquet(path).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side(test, "test").unionByName(side(train, "train"))


# --- weather --------------------------------------------------------------------------------------

_WREAL = ["temperature_c", "precipitation_mm", "wind_speed_kph", "snow_mm"]
_WCOLS = ", ".join(f"{_r(c)} as {c}" if c in _WREAL else c for c in ["city", "weather_hour", *WEATHER_VALUES])


@query(f"select {_WCOLS} from w", weather=True)
def weather_dedupe(spark, d):
    return _rounded(Q.weather(spark, d), _WREAL)


@query(f"""select 'chicago' as city, date_trunc('hour', ts) as weather_hour, {_r('value / 10e0')} as temperature_c, {_r('coalesce(case when event_id % 2 = 0 then value end, 0e0)')} as precipitation_mm,
  {_r('value / 20e0')} as wind_speed_kph, {_r('coalesce(case when event_id % 3 = 0 then value end, case when event_id % 5 = 0 then 1e0 end, 0e0)')} as snow_mm,
  case when coalesce(case when event_id % 2 = 0 then value end, 0) > 0 then 1 else 0 end as rain_flag,
  case when coalesce(case when event_id % 3 = 0 then value end, case when event_id % 5 = 0 then 1e0 end, 0) > 0 then 1 else 0 end as snow_flag from events""")
def weather_normalize(spark, d):
    v, i = F.col("value"), F.col("event_id")
    raw = Q.table(spark, d, "events").select(
        F.col("ts").alias("time"), (v / F.lit(10.0)).alias("temp"), F.when(i % 2 == 0, v).alias("prcp"), (v / F.lit(20.0)).alias("wspd"), F.when(i % 3 == 0, v).alias("snow"), F.when(i % 5 == 0, F.lit(1.0)).alias("snwd")
    )
    return _rounded(enrich.normalize_weather(raw, F.lit("chicago")), _WREAL)


def _joined(spark, d, clean: bool = True):
    rows = Q.trips_with_hour(spark, d)
    if clean:
        hour = rows.select(*trips.RAW, "weather_hour")
        keyed = trips.trip_features(hour.where(trips.usable()).withColumn("rideable_type", F.struct("rideable_type", "weather_hour")))
        rows = keyed.withColumn("weather_hour", F.col("rideable_type.weather_hour")).withColumn("rideable_type", F.col("rideable_type.rideable_type"))
    return enrich.join_many_to_one(rows, Q.weather(spark, d), ["city", "weather_hour"])


_JW = "jw as (select f.*, w.* exclude (city, weather_hour) from f left join w on f.city = w.city and date_trunc('hour', f.weather_at) = w.weather_hour)"


@query(f"""select t.city, count(*) as n, count_if(w.city is null)::bigint as unmatched, sum(rain_flag)::bigint as rain_rows, sum(snow_flag)::bigint as snow_rows, {_r('avg(temperature_c)')} as avg_temperature,
  count_if(wind_speed_kph is null)::bigint as no_wind from t left join w on t.city = w.city and date_trunc('hour', t.weather_at) = w.weather_hour group by t.city""", weather=True)
def weather_join(spark, d):
    return _joined(spark, d, clean=False).groupBy("city").agg(
        F.count("*").alias("n"), F.count_if(F.col("rain_flag").isNull()).alias("unmatched"), F.sum("rain_flag").alias("rain_rows"), F.sum("snow_flag").alias("snow_rows"),
        X.rounded(F.avg("temperature_c")).alias("avg_temperature"), F.count_if(F.col("wind_speed_kph").isNull()).alias("no_wind"),
    )


@query(f"select city, count(distinct weather_hour) as hours_covered, 720::bigint as hours_expected, {_r('count(distinct weather_hour) / 720e0')} as coverage from w where weather_hour >= timestamp '2024-01-01' and weather_hour < timestamp '2024-01-31' group by city", weather=True)
def weather_coverage(spark, d):
    bound = lambda s: F.to_timestamp_ntz(F.lit(s))
    return _rounded(enrich.hour_coverage(Q.weather(spark, d), bound("2024-01-01 00:00:00"), bound("2024-01-30 23:00:00")), ["coverage"])


@query(f"with {_JW} select city, rain_flag, snow_flag, {_MEANS} from jw group by city, rain_flag, snow_flag", weather=True)
def weather_behavior(spark, d):
    return P.group_means(_joined(spark, d), ["city", "rain_flag", "snow_flag"])


@query(f"""with {_JW} select city, case when temperature_c <= 0 then '< 0C' when temperature_c <= 10 then '0-10C' when temperature_c <= 20 then '10-20C' when temperature_c <= 30 then '20-30C'
  when temperature_c > 30 then '>= 30C' end as band, count(*) as n, {_r('avg(trip_duration)')} as avg_duration from jw group by all""", weather=True)
def temperature_bands(spark, d):
    rows = _joined(spark, d).withColumn("band", X.temperature_band(F.col("temperature_c")))
    return rows.groupBy("city", "band").agg(F.count("*").alias("n"), X.rounded(F.avg("trip_duration")).alias("avg_duration"))


@query(f"""with {_JW} select city, month, count(*) as n, {_r('avg(temperature_c)')} as avg_temperature, {_r('sum(precipitation_mm)', 4)} as rain_mm, count_if(temperature_c is null)::bigint as no_weather
  from jw group by all""", weather=True)
def monthly_weather(spark, d):
    return _joined(spark, d).groupBy("city", "month").agg(
        F.count("*").alias("n"), X.rounded(F.avg("temperature_c")).alias("avg_temperature"), X.rounded(F.sum("precipitation_mm"), 4).alias("rain_mm"), F.count_if(F.col("temperature_c").isNull()).alias("no_weather")
    )


@query("""select event_type as source, count(distinct date_trunc('hour', ts)) as coverage_hours, length(event_type)::double as distance_km from events
where value is not null and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31' group by event_type order by coverage_hours desc, distance_km, source limit 1""")
def weather_source_choice(spark, d):
    """The kind of event, taken as a source, that covers most hours; its distance is the length of its name."""
    ev = Q.table(spark, d, "events").select(F.col("event_type").alias("city"), X.floor_hour(F.col("ts")).alias("weather_hour"), F.col("value").alias("temperature_c"))
    bound = lambda s: F.to_timestamp_ntz(F.lit(s))
    got = enrich.hour_coverage(ev, bound("2024-01-01 00:00:00"), bound("2024-01-30 23:00:00"))
    return enrich.choose_source(got.select(F.col("city").alias("source"), F.col("hours_covered").alias("coverage_hours"), F.length("city").cast("double").alias("distance_km")))


@query("""with p as (select s_suppkey as k, (s_suppkey % 50)::double as lat, (s_suppkey % 7)::double as lng from supplier),
x as (select a.k as city_key, b.k as source_key, 2 * 6371.0e0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2))) as km
  from p a join p b on abs(a.lat - b.lat) <= 1 and a.k % 10 = 0)
select city_key::varchar as city, source_key::varchar as source, round(km, 6) + 0e0 as distance_km, (row_number() over (partition by city_key order by km, source_key::varchar))::int as rank from x where km <= 100 qualify rank <= 25""")
def weather_stations_nearby(spark, d):
    k = F.col("s_suppkey")
    p = Q.table(spark, d, "supplier").select(k.cast("string").alias("source"), (k % 50).cast("double").alias("lat"), (k % 7).cast("double").alias("lng"), k)
    got = enrich.nearby_stations(p.where(k % 10 == 0).withColumnRenamed("source", "city"), p)
    return _rounded(got.select("city", "source", "distance_km", "rank"), ["distance_km"])


# --- stations -------------------------------------------------------------------------------------


def _stations(spark, d):
    s = F.col("s_suppkey")
    return Q.table(spark, d, "supplier").select(s.cast("string").alias("station_id"), F.col("s_name").alias("station_name"), (F.lit(41.80) + F.pmod(s, F.lit(10)) * F.lit(0.013)).alias("lat"), (F.lit(-87.70) + F.floor(s / F.lit(10)) * F.lit(0.017)).alias("lng"))


_DOUBLE = "from c join supplier a on a.s_suppkey::varchar = c.start_station_id join supplier b on b.s_suppkey::varchar = c.end_station_id"


@query(f"select c.city, a.s_name as start_name, b.s_name as end_name, count(*) as n {_DOUBLE} group by all")
def station_double_join(spark, d):
    return enrich.with_stations(trips.clean_trips(Q.raw_trips(spark, d)), _stations(spark, d)).groupBy("city", "start_name", "end_name").agg(F.count("*").alias("n"))


@query("select city, count(distinct start_station_id) as start_stations, count(distinct end_station_id) as end_stations, count_if(start_station_id is null)::bigint as no_start from c group by city")
def station_summary(spark, d):
    return trips.clean_trips(Q.raw_trips(spark, d)).groupBy("city").agg(F.count_distinct("start_station_id").alias("start_stations"), F.count_distinct("end_station_id").alias("end_stations"), F.count_if(F.col("start_station_id").isNull()).alias("no_start"))


@query(f"select a.s_name as start_name, b.s_name as end_name, count(*) as n {_DOUBLE} group by all order by n desc, start_name, end_name limit 20")
def top_routes(spark, d):
    joined = enrich.with_stations(trips.clean_trips(Q.raw_trips(spark, d)), _stations(spark, d))
    return joined.groupBy("start_name", "end_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "start_name", "end_name").limit(20)


@query("select start_station_id, count(*) as n from c where start_station_id is not null group by 1 order by n desc, start_station_id limit 25")
def top_stations(spark, d):
    c = trips.clean_trips(Q.raw_trips(spark, d)).where("start_station_id is not null")
    return c.groupBy("start_station_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "start_station_id").limit(25)


@query(f"select city, {_r('avg(start_lat)')} as lat, {_r('avg(start_lng)')} as lng, min(started_at) as first_start, max(started_at) as last_start from c group by city")
def trip_extent(spark, d):
    return _rounded(enrich.extent(trips.clean_trips(Q.raw_trips(spark, d))), ["lat", "lng"])


# --- model tables ---------------------------------------------------------------------------------

_MED = f"md as (select {', '.join(f'coalesce(median({c}), 0e0) as m_{c}' for c in CONTINUOUS)} from jw)"
_FILL = ", ".join(
    (f"ln(1 + greatest(coalesce({c}, m_{c}), 0e0)) as l_{c}" if c != "temperature_c" else f"coalesce({c}, m_{c}) as l_{c}") for c in CONTINUOUS
)
_LOGGED = f"with {_JW}, {_MED}, lg as (select jw.*, {_FILL} from jw, md)"


def _stored(spark, d, columns: list[str]):
    """Columns of the trips with weather, computed and written once."""
    with Scratch(spark) as own:
        return own.keep(_joined(spark, d).select(*columns), "trips-with-weather")


@query(f"{_LOGGED} select city, " + ", ".join(f"{_r(f'avg(l_{c})')} as {c}" for c in CONTINUOUS) + " from lg group by city", weather=True)
def model_input_impute(spark, d):
    rows = _stored(spark, d, ["city", *CONTINUOUS])
    done = mlprep.log_skewed(mlprep.impute(rows, mlprep.fit_medians(rows, stored=True)))
    return done.groupBy("city").agg(*[X.rounded(F.avg(c)).alias(c) for c in CONTINUOUS])


_SC = "sc as (select " + ", ".join(f"avg(l_{c}) as a_{c}, coalesce(nullif(stddev_pop(l_{c}), 0), 1) as s_{c}" for c in CONTINUOUS) + " from lg)"


@query(f"{_LOGGED}, {_SC} select city, " + ", ".join(f"{_r(f'avg((l_{c} - a_{c}) / s_{c})')} as {c}" for c in CONTINUOUS) + " from lg, sc group by city", weather=True)
def model_input_scaled(spark, d):
    rows = _stored(spark, d, ["city", *CONTINUOUS])
    medians, scaler = mlprep.fit_scaling(rows, stored=True)
    done = mlprep.scale(mlprep.log_skewed(mlprep.impute(rows, medians)), scaler)
    return done.groupBy("city").agg(*[X.rounded(F.avg(c)).alias(c) for c in CONTINUOUS])


_HOT = [(f"{c}_{v}", f"count_if({c} = '{v}')") for c, values in CATEGORIES.items() for v in values]


@query(f"with {_JW} select count(*) as n, " + ", ".join(f"{e}::bigint as {n}" for n, e in _HOT) + ", " + ", ".join(f"sum(coalesce({c}, 0))::bigint as {c}" for c in [*DISCRETE, *BINARY]) + " from jw", weather=True)
def model_input_onehot(spark, d):
    rows = _stored(spark, d, [*CATEGORIES, *DISCRETE, *BINARY, *CYCLICAL, *CONTINUOUS])
    table, _ = mlprep.model_input(rows, stored=True)
    return table.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in [*(n for n, _ in _HOT), *DISCRETE, *BINARY]])


@query(f"with {_JW} select " + ", ".join([*GENERATIVE_CATEGORICAL, *(f"round({c}::float::double, 3) + 0e0 as {c}" for c in GENERATIVE_CONTINUOUS)]) + " from jw", weather=True)
def generative_table(spark, d):
    return _rounded(mlprep.generative_table(_joined(spark, d)), GENERATIVE_CONTINUOUS, 3)


# --- evaluation -----------------------------------------------------------------------------------

_EV_REAL, _EV_CAT = GENERATIVE_CONTINUOUS, GENERATIVE_CATEGORICAL


def _sides(spark, d):
    """The generative tables of two cities, written once."""
    with Scratch(spark) as own:
        rows = _joined(spark, d).where(F.col("city").isin("chicago", "nyc")).select("city", *_EV_REAL, *_EV_CAT)
        digits = own.keep(_rounded(rows, _EV_REAL, 9), "two-cities")
    return digits.where("city = 'chicago'").drop("city"), digits.where("city = 'nyc'").drop("city")


def _ks_sql(c: str) -> str:
    return f"""select '{c}' as "column", 'continuous' as type, 'ks_statistic' as metric, {_r('max(abs(ca / na - cb / nb))')} as value from (
  select sum(a) over (order by v) as ca, sum(b) over (order by v) as cb, sum(a) over ()::double as na, sum(b) over ()::double as nb
  from (select {_r(c, 9)} as v, count_if(city = 'chicago') as a, count_if(city = 'nyc') as b from jw where city in ('chicago', 'nyc') and {c} is not null group by 1))"""


def _tvd_sql(c: str) -> str:
    return f"""select '{c}' as "column", 'categorical' as type, 'tvd' as metric, {_r('sum(abs(a / na - b / nb)) / 2')} as value from (
  select a, b, sum(a) over ()::double as na, sum(b) over ()::double as nb
  from (select coalesce({c}::varchar, 'nan') as v, count_if(city = 'chicago') as a, count_if(city = 'nyc') as b from jw where city in ('chicago', 'nyc') group by 1))"""


@query(f"with {_JW} " + " union all ".join(_ks_sql(c) for c in _EV_REAL), weather=True)
def ks_report(spark, d):
    return evaluate.fidelity_report(*_sides(spark, d), _EV_REAL, [])


@query(f"with {_JW} " + " union all ".join(_tvd_sql(c) for c in _EV_CAT), weather=True)
def tvd_report(spark, d):
    return evaluate.fidelity_report(*_sides(spark, d), [], _EV_CAT)


@query(f"with {_JW}, rep as ({' union all '.join([*map(_ks_sql, _EV_REAL), *map(_tvd_sql, _EV_CAT)])}) select metric, {_r('avg(value)', 4)} as mean_value from rep group by metric", weather=True)
def fidelity_means(spark, d):
    return evaluate.fidelity_means(evaluate.fidelity_report(*_sides(spark, d), _EV_REAL, _EV_CAT))


@query()
def utility_rf(spark, d):
    """Forests fitted on one city and on the other, both tested on a fifth of the first."""
    real, other = _sides(spark, d)
    (own_rows, other_rows), features = evaluate.coded_features([real, other], _EV_CAT)
    split = sample.stratified_split(own_rows, ["month", "is_weekend"])
    test = split.where("split = 'test'")
    own = evaluate.binned_forest_utility(split.where("split = 'train'"), test, features, depth=UTILITY_DEPTH)
    tstr = evaluate.binned_forest_utility(other_rows, test, features, depth=UTILITY_DEPTH, stored=True)
    both = own.withColumnsRenamed({"r2": "trtr_r2", "mae": "trtr_mae"}).crossJoin(F.broadcast(tstr.withColumnsRenamed({"r2": "tstr_r2", "mae": "tstr_mae"})))  # one row each
    gap = F.col("trtr_r2") - F.col("tstr_r2")
    return both.withColumn("transfer_gap", X.rounded(gap, 4)).withColumn("label", evaluate.gap_label(gap))


@query("select s_suppkey, case when gap < 0.05e0 then 'Excellent' when gap < 0.1e0 then 'Good' when gap < 0.2e0 then 'Moderate' else 'Poor' end as label from (select s_suppkey, (s_suppkey % 30 - 5) / 100e0 as gap from supplier)")
def transfer_gap_label(spark, d):
    gap = (F.col("s_suppkey") % 30 - 5) / F.lit(100.0)
    return Q.table(spark, d, "supplier").select("s_suppkey", evaluate.gap_label(gap).alias("label"))


_DUMMIES = [f"{c}_{v}" for c, values in (("member_casual", ("casual", "member")), ("rideable_type", ("classic_bike", "docked_bike", "electric_bike"))) for v in values]


@query("select city, " + ", ".join(f"count_if({c[:13] if c.startswith('r') else 'member_casual'} = '{c[14:]}')::bigint as {c}" for c in _DUMMIES) + " from c group by city")
def free_dummies(spark, d):
    """0/1 columns of whatever values two text columns take, the same for every city."""
    with Scratch(spark) as own:
        rows = own.keep(trips.clean_trips(Q.raw_trips(spark, d)).select("city", "member_casual", "rideable_type"), "three-columns")
    domains = mlprep.free_domains([rows], ["member_casual", "rideable_type"])
    coded = mlprep.one_hot(rows, domains)
    return coded.groupBy("city").agg(*[F.sum(c).alias(c) for c in coded.columns if c != "city"])


# --- sources --------------------------------------------------------------------------------------


@query(" union all ".join(f"select '{t}' as file, count(*) as source_rows, count(*) as converted_rows, true as matches from {t}" for t in STAR))
def csv_roundtrip_verify(spark, d):
    source, converted = {}, {}
    with Scratch(spark) as own:
        for t in STAR:
            source[t] = Q.table(spark, d, t)
            path = own.place(f"csv-{t}")
            io.write_csv(source[t], path)
            converted[t] = io.read_csv_text(spark, [path])
    return io.verify_counts(source, converted)


@query("select s_suppkey::int as id, s_name as name, s_acctbal as amount, null::varchar as n_regionkey from supplier union all select n_nationkey::int, null, null, n_regionkey::varchar from nation")
def csv_typed(spark, d):
    """CSV files whose types are inferred, but for one column forced to be text; united by name."""
    with Scratch(spark) as own:
        paths = [own.place("csv-supplier"), own.place("csv-nation")]
        io.write_csv(Q.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount")), paths[0])
        io.write_csv(Q.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey"), paths[1])
    return io.read_csv_typed(spark, paths, {"n_regionkey": "string"})


@query("""select s_suppkey::bigint as id, s_acctbal::double as amount, s_nationkey::varchar as mixed from supplier union all select n_nationkey::bigint, n_regionkey::double, n_name from nation
union all select r_regionkey::bigint, null, null from region""")
def union_widened(spark, d):
    """Files of one table whose number types differ: they widen; number and text meet as text; missing columns are null."""
    parts = [
        Q.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").cast("double").alias("amount"), F.col("s_nationkey").alias("mixed")),
        Q.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_regionkey").cast("int").alias("amount"), F.col("n_name").alias("mixed")),
        Q.table(spark, d, "region").select(F.col("r_regionkey").cast("short").alias("id")),
    ]
    with Scratch(spark) as own:
        root = own.place("mixed-types")
        for k, part in enumerate(parts):
            io.write_parquet(part, f"{root}/part-{k}")
    return io.read_union_by_name(spark, [f"{root}/part-{k}" for k in range(len(parts))])


@query("select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_regionkey = 1")
def appended_files(spark, d):
    """A table to which a second write adds its files, copied to another root, found there at any depth, and read."""
    nation = Q.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    with Scratch(spark) as own:
        root, copy = own.place("appended"), own.place("copied")
        io.write_parquet(nation.drop("n_regionkey"), f"{root}/a/b", "append")
        io.write_parquet(nation.where("n_regionkey = 1").drop("n_regionkey"), f"{root}/a/b", "append", files=1)
        io.copy_tree(spark, root, copy)
    return io.read_same_schema(spark, io.files_in(spark, copy, "*.parquet", recursive=True))


@query("select r_regionkey::varchar as id, r_name as name, null::varchar as n_regionkey from region union all select n_name, null, n_regionkey::varchar from nation")
def union_by_name(spark, d):
    region = Q.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nation = Q.table(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return io.union_by_name([region, nation])


_FILES = "'2024' || lpad((n_nationkey % 3 + 1)::varchar, 2, '0') || case when n_nationkey % 4 = 0 then '-CITIBIKE' else '-citibike' end || '-tripdata_' || n_nationkey || case when n_nationkey % 5 = 0 then '.csv' else '.parquet' end"


@query(f"select substr(name, 1, 6) as month, string_agg(name, ',' order by n_nationkey) as files from (select n_nationkey, {_FILES} as name from nation) where name like '%.parquet' group by 1")
def month_file_grouping(spark, d):
    k = F.col("n_nationkey")
    pieces = [F.lit("2024"), F.lpad((k % 3 + 1).cast("string"), 2, "0"), F.when(k % 4 == 0, "-CITIBIKE").otherwise("-citibike"), F.lit("-tripdata_"), k.cast("string"), F.when(k % 5 == 0, ".csv").otherwise(".parquet")]
    names = Q.table(spark, d, "nation").select(F.concat(*pieces).alias("name"))
    return io.group_monthly(names).withColumn("files", F.array_join("files", ","))
