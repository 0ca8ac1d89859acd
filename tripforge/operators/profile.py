"""Profiles of trips and tables: summaries, distributions, correlations, null audits and the data behind plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from .quantiles import exact_quantiles, quantiles_wide
from .trips import RULE, TripRule, with_outlier_flags

POINTS = {0.01: "p01", 0.05: "p05", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.95: "p95", 0.99: "p99"}


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Per cent from two counts; null where the whole is zero."""
    return rounded(F.try_divide(F.lit(100.0) * part, whole), digits)


def basic_summary(f: DataFrame, by: list[str] = ["city"]) -> DataFrame:  # noqa: B006
    """Rows, mean, exact median, least and greatest duration and distance for each group."""
    d, k = "trip_duration", "haversine_distance_km"
    more = {"total_rows": F.count("*")} | {f"{n}_{c}": g(c) for c in (d, k) for n, g in (("avg", F.avg), ("min", F.min), ("max", F.max))}
    out = quantiles_wide(f, by, [d, k], {0.5: "median"}, more=more)
    return out.select(*by, "total_rows", *[rounded(F.col(f"{n}_{c}")).alias(f"{n}_{c}") for c in (d, k) for n in ("avg", "median", "min", "max")])


def group_counts(f: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group and their share of all in per cent."""
    counts = f.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).withColumn("pct", pct(F.col("n"), F.col("__all"))).drop("__all")  # one row


def group_means(f: DataFrame, by: list[str]) -> DataFrame:
    """Rows, mean duration and distance, and the share of round trips for each group."""
    return f.groupBy(*by).agg(
        F.count("*").alias("n"), rounded(F.avg("trip_duration")).alias("avg_duration"), rounded(F.avg("haversine_distance_km")).alias("avg_distance"),
        rounded(F.avg("same_station")).alias("same_station_rate"),
    )


def quantile_table(f: DataFrame, column: str, by: list[str] = ["city"], approximate: bool = False) -> DataFrame:  # noqa: B006
    """Seven quantiles of a column for each group; the approximate ones are observed values."""
    if approximate:
        q = f.groupBy(*by).agg(F.percentile_approx(column, list(POINTS), 10_000).alias("q"))
        return q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(POINTS.values())])
    wide = quantiles_wide(f, by, [column], POINTS)
    return wide.select(*by, *[rounded(F.col(n)).alias(n) for n in POINTS.values()])


def duration_impact(f: DataFrame, rule: TripRule = RULE) -> DataFrame:
    """Per city: rows too short and too long, and their shares."""
    d = F.col("trip_duration")
    short, long, n = F.count_if(d <= rule.min_minutes), F.count_if(d >= rule.max_minutes), F.count("*")
    return f.groupBy("city").agg(n.alias("total_rows"), short.alias("too_short"), long.alias("too_long"), pct(short, n).alias("too_short_pct"), pct(long, n).alias("too_long_pct"))


def distance_impact(f: DataFrame, rule: TripRule = RULE) -> DataFrame:
    """Per city: rows with hardly any distance by whether the station is the same, rows too far, and shares."""
    km, same = F.col("haversine_distance_km"), F.col("same_station") == 1
    near_other, near_same, far, n = F.count_if((km <= rule.min_km) & ~same), F.count_if((km <= rule.min_km) & same), F.count_if(km >= rule.max_km), F.count("*")
    return f.groupBy("city").agg(
        n.alias("total_rows"), near_other.alias("near_zero_other"), near_same.alias("near_zero_same"), far.alias("too_far"), pct(near_other, n).alias("near_zero_other_pct"), pct(far, n).alias("too_far_pct"),
    )


def suspicious_trips(f: DataFrame, rule: TripRule = RULE, before: bool = True) -> DataFrame:
    """Counts by outlier flags of trips with one at least; filtered before grouping or after it (same rows)."""
    flagged = with_outlier_flags(f.where(rule.odd()) if before else f, rule)
    counts = flagged.groupBy("city", "duration_flag", "distance_flag").agg(F.count("*").alias("n"))
    return counts if before else counts.where((F.col("duration_flag") != "normal") | (F.col("distance_flag") != "normal"))


def short_distance_breakdown(f: DataFrame, rule: TripRule = RULE) -> DataFrame:
    return group_means(f.where(F.col("haversine_distance_km") <= rule.min_km), ["city", "same_station", "rideable_type"])


def long_duration_breakdown(f: DataFrame, rule: TripRule = RULE) -> DataFrame:
    return group_means(f.where(F.col("trip_duration") >= rule.max_minutes), ["city", "member_casual", "rideable_type"])


def pair_corr(x: str, y: str) -> Column:
    """Pearson correlation over rows where both are known; null if one of them is constant."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x).cast("double")), F.when(F.col(x).isNotNull(), F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_by(f: DataFrame, by: list[str]) -> DataFrame:
    return f.groupBy(*by).agg(F.count("*").alias("n"), rounded(pair_corr("trip_duration", "haversine_distance_km"), 7).alias("corr"))


def correlation_matrix(f: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (x, y, corr) of all pairs, each over the rows where both are known; null if one of them is constant there.

    Sums and sums of products of the columns, less their means, are made for each pattern of known columns, so that no
    product needs a guard. The formula is finished on one row a pattern and pair.
    """
    k = range(len(columns))
    numbers = f.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)).alias(f"m{i}") for i in k])
    known = F.expr(" + ".join(f"if(c{i} is null, 0L, {1 << i}L)" for i in k)).alias("known")
    centred = numbers.crossJoin(F.broadcast(means)).select(known, *[F.expr(f"coalesce(c{i} - m{i}, 0d)").alias(f"v{i}") for i in k])  # one row
    at = {(i, j): n for n, (i, j) in enumerate((i, j) for i in k for j in k if i <= j)}
    lists = {"s": [f"sum(v{i})" for i in k], "lo": [f"min(v{i})" for i in k], "hi": [f"max(v{i})" for i in k], "p": [f"sum(v{i} * v{j})" for i, j in at]}
    sums = centred.groupBy("known").agg(F.count("*").alias("n"), *[F.expr(f"array({', '.join(v)})").alias(n) for n, v in lists.items()])
    pairs = ", ".join(f"named_struct('x', '{columns[i]}', 'y', '{columns[j]}', 'i', {i}, 'j', {j}, 'ii', {at[i, i]}, 'jj', {at[j, j]}, 'ij', {n})" for (i, j), n in at.items())
    long = sums.select("*", F.expr(f"explode(array({pairs}))").alias("e")).select("*", "e.*")
    both = F.expr("(known & shiftleft(1L, i)) != 0 and (known & shiftleft(1L, j)) != 0")
    total = {"n": "n", "x1": "s[i]", "y1": "s[j]", "xx": "p[ii]", "yy": "p[jj]", "xy": "p[ij]"}
    ends = {"xlo": "min(lo[i])", "xhi": "max(hi[i])", "ylo": "min(lo[j])", "yhi": "max(hi[j])"}
    known_rows = long.withColumn("both", both)
    done = known_rows.groupBy("x", "y").agg(*[F.expr(f"sum(if(both, {v}, 0))").alias(n) for n, v in total.items()], *[F.expr(v[:4] + f"if(both, {v[4:-1]}, null))").alias(n) for n, v in ends.items()])
    corr = F.expr("case when xlo < xhi and ylo < yhi then try_divide(n * xy - x1 * y1, sqrt(n * xx - x1 * x1) * sqrt(n * yy - y1 * y1)) end")
    cells = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    cells = F.when(F.col("x") == F.col("y"), F.slice(cells, 1, 1)).otherwise(cells)
    return done.select(F.explode(cells).alias("e"), rounded(corr, 7).alias("corr")).select("e.x", "e.y", "corr")


def top_hours(f: DataFrame, n: int = 3) -> DataFrame:
    """The hours with most trips in each city."""
    counts = f.groupBy("city", "hour").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("city").orderBy(F.col("n").desc(), "hour"))
    return counts.withColumn("rn", rank).where(F.col("rn") <= n)


def null_profile(df: DataFrame, name: str, nan_too: bool = False) -> DataFrame:
    """One row a column: rows, nulls (with ``nan_too`` also NaN), their per cent (2 digits); one pass over the table."""
    kinds = dict(df.dtypes)
    missing = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if nan_too and kinds[c] in ("double", "float") else F.lit(False))
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(missing(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(df.columns)])
    out = row.select("rows", F.explode(cells).alias("e")).select(F.lit(name).alias("file"), "e.column", "e.dtype", "rows", "e.null_count")
    return out.withColumn("null_percent", pct(F.col("null_count"), F.col("rows"), 2)).withColumn("non_null_count", F.col("rows") - F.col("null_count"))


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Null profiles of several tables."""
    return reduce(DataFrame.unionByName, [null_profile(df, name) for name, df in tables.items()])


def describe(f: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, quartiles and extremes of each column; exact."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), rounded(F.avg(c)).alias("mean"), rounded(F.stddev_samp(c)).alias("std"), rounded(F.min(c)).alias("min"), rounded(F.max(c)).alias("max")) for c in columns]
    base = f.agg(*[s.alias(f"s{i}") for i, s in enumerate(cells)]).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("e")).select("e.*")
    q = exact_quantiles(f, [], columns, [0.25, 0.5, 0.75]).groupBy("column").agg(*[rounded(F.max(F.when(F.col("p") == p, F.col("value")))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(q, "column")


def value_counts(f: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values, null among them."""
    return group_counts(f.select(F.col(column).cast("string").alias("value")), ["value"])


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Rows, rows beyond the first of equal rows, and rows beyond the first of an equal value."""
    full = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_rows"), F.sum(F.col("n") - 1).alias("repeated_rows"))
    single = df.groupBy(column).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("repeated_values"))
    return full.crossJoin(F.broadcast(single))  # one row each


def qc_counters() -> dict[str, Column]:
    """The counters over cleaned trips, as aggregates by name."""
    minutes = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(60e6)
    return {
        "total_rows": F.count("*"), "same_station": F.count_if(F.col("start_station_id") == F.col("end_station_id")), "ends_before_start": F.count_if(minutes < 0),
        "over_a_day": F.count_if(minutes > 1440), "under_a_minute": F.count_if((minutes >= 0) & (minutes < 1)), "not_positive": F.count_if(minutes <= 0),
    }


def null_counters(df: DataFrame) -> dict[str, Column]:
    """Nulls of each column, as aggregates by name."""
    return {f"null_{c}": F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}


def qc_checks(c: DataFrame) -> DataFrame:
    """One row of counters over cleaned trips."""
    return c.agg(*[v.alias(n) for n, v in qc_counters().items()])


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def day_hour_pivot(f: DataFrame) -> DataFrame:
    """A row for each day name, in order, with a column of counts for each hour; null where a day has none."""
    days = f.sparkSession.createDataFrame(list(enumerate(DAYS)), "day_of_week int, day_name string")
    pivot = f.groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.count("city"))
    named = pivot.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})
    return F.broadcast(days).join(named, "day_of_week", "left").orderBy("day_of_week")  # seven rows


def histogram(f: DataFrame, column: str, lo: float, hi: float, bins: int, by: str = "city") -> DataFrame:
    """Counts and densities of bins of equal width for each group; the last bin is closed."""
    width = (hi - lo) / bins
    inside = f.where(F.col(column).between(lo, hi))
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / F.lit(width)).cast("int"))
    counts = inside.groupBy(by, place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", rounded(F.col("n") / (F.sum("n").over(W.partitionBy(by)) * F.lit(width))))


def boxplot(f: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 times their distance beyond them."""
    q = quantiles_wide(f, by, [column], {0.25: "q1", 0.5: "q2", 0.75: "q3"})
    spread = F.col("q3") - F.col("q1")
    inside = f.select(*by, column).join(q, by).where(F.col(column).between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread))
    ends = inside.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return q.join(ends, by).select(*by, *[rounded(F.col(c)).alias(c) for c in ("low", "q1", "q2", "q3", "high")])
