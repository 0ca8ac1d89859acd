"""Exact samples: proportional strata by largest remainder, uniform n rows, and stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..contracts import STRATA, ContractError
from ..sources.scratch import Scratch
from .ranks import with_row_number

BUCKETS = 4096


def allocate(strata: DataFrame, keys: list[str], target: int | None = None, share: float | None = None) -> DataFrame:
    """Add target_in_stratum to a table with strata_size: largest remainders, ties by the keys; the sum is min(target, rows).

    ``share`` takes the ceiling of a share of all rows. Remainders are ranked by ranges, so there may be any number of strata.
    """
    with Scratch(strata.sparkSession) as own:
        strata = own.write(strata, "strata")
        total = strata.agg(F.coalesce(F.sum("strata_size"), F.lit(0)).cast("long").alias("__total"))
        goal = F.least(F.lit(target).cast("long"), F.col("__total")) if share is None else F.ceil(F.col("__total") * F.lit(share)).cast("long")
        sized = strata.crossJoin(F.broadcast(total.withColumn("__goal", goal)))  # one row
        sized = sized.withColumn("__raw", F.col("strata_size") * F.col("__goal").cast("double") / F.col("__total"))
        sized = sized.withColumn("__base", F.floor("__raw").cast("long")).withColumn("__frac", F.col("__raw") - F.col("__base")).drop("__total", "__raw")
        ranked = with_row_number(sized, [F.col("__frac").desc(), *[F.col(k).asc_nulls_last() for k in keys]], own, "__rank")
        extra = ranked.agg((F.max("__goal") - F.sum("__base")).alias("__extra"))
        out = ranked.crossJoin(F.broadcast(extra))  # one row
        one_more = F.when(F.col("__rank") <= F.col("__extra"), 1).otherwise(0)
    return out.withColumn("target_in_stratum", F.col("__base") + one_more).drop("__goal", "__base", "__frac", "__extra", "__rank")


def strata_sizes(df: DataFrame, keys: list[str] = STRATA) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("strata_size"))


def row_draw(df: DataFrame, seed: int) -> Column:
    """A pseudo-random number of a row that doesn't depend on how rows are spread."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])


def drawn_rows(df: DataFrame, seed: int) -> DataFrame:
    """The rows with their draw and its range; a filter on ranges needs no look at other columns."""
    drawn = df.withColumn("__draw", row_draw(df, seed))
    return drawn.withColumn("__range", (F.pmod("__draw", F.lit(1 << 32)) / F.lit((1 << 32) // BUCKETS)).cast("int"))


def take_exactly(drawn: DataFrame, keys: list[str], need: DataFrame, scratch: Scratch) -> DataFrame:
    """All ``drawn_rows`` whose stratum is in ``need`` (keys, target_in_stratum), with ``taken``: exactly so many in each stratum.

    Rows are ordered by their draw. Counts of 4,096 ranges of draws tell in which range a stratum's last row lies; lower
    ranges are taken whole, and only that range's rows are ranked. So a stratum with a third of all rows is no one sort.
    Null keys match nothing. ``drawn`` is read three times and should be a written table.
    """
    columns = [c for c in drawn.columns if c not in ("__draw", "__range")]
    counts = drawn.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__upto", F.sum("__n").over(W.partitionBy(*keys).orderBy("__range")))
    edge = counts.join(need.select(*keys, "target_in_stratum"), keys) if keys else counts.crossJoin(F.broadcast(need.select("target_in_stratum")))  # one row
    below = F.col("__upto") < F.col("target_in_stratum")
    edge = edge.where("target_in_stratum > 0").groupBy(*keys).agg(
        F.coalesce(F.min(F.when(~below, F.col("__range"))), F.lit(BUCKETS)).alias("__edge"),
        (F.first("target_in_stratum") - F.coalesce(F.max(F.when(below, F.col("__upto"))), F.lit(0))).alias("__need"),
    ).where("__need is not null")
    zero = need.where("target_in_stratum <= 0").select(*keys, F.lit(-1).alias("__edge"), F.lit(0).cast("long").alias("__need"))
    edge = scratch.keep(edge.unionByName(zero), "sample-edges")
    marked = drawn.join(edge, keys) if keys else drawn.crossJoin(F.broadcast(edge))  # one row
    clear = marked.where("__range != __edge").select(*columns, (F.col("__range") < F.col("__edge")).alias("taken"))
    rank = F.row_number().over(W.partitionBy(*keys, "__range").orderBy(F.pmod("__draw", F.lit(1 << 32)), "__draw"))
    close = marked.where("__range = __edge").withColumn("__rank", rank).select(*columns, (F.col("__rank") <= F.col("__need")).alias("taken"))
    return clear.unionByName(close)


def stratified_sample(df: DataFrame, target: int, keys: list[str] = STRATA, seed: int = 42) -> DataFrame:
    """An exact proportional sample of min(target, rows) rows, less what null strata were allotted. The rows are computed and written once."""
    with Scratch(df.sparkSession) as own:
        drawn = own.keep(drawn_rows(df, seed), "drawn-rows")
        need = allocate(strata_sizes(drawn, keys), keys, target)
        return take_exactly(drawn, keys, need, own).where("taken").drop("taken")


def uniform_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement."""
    with Scratch(df.sparkSession) as own:
        drawn = own.keep(drawn_rows(df, seed), "drawn-rows")
        need = drawn.agg(F.least(F.count("*"), F.lit(n)).alias("target_in_stratum"))
        return take_exactly(drawn, [], need, own).where("taken").drop("taken")


def stratified_split(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows with ``split`` = test or train; ceil(share x rows) are test, by largest remainder. A stratum of one row is an error.

    The rows are computed and written once.
    """
    with Scratch(df.sparkSession) as own:
        drawn = own.keep(drawn_rows(df, seed), "drawn-rows")
        sizes = own.write(strata_sizes(drawn, keys), "strata-sizes")
        if not sizes.where("strata_size < 2").isEmpty():
            raise ContractError("a stratum has fewer than two rows")
        taken = take_exactly(drawn, keys, allocate(sizes, keys, share=test_share), own)
    return taken.withColumn("split", F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


def strata_report(df: DataFrame, target: int, keys: list[str] = STRATA) -> DataFrame:
    """One row about the sizes of the strata and the target."""
    size = F.col("strata_size")
    out = strata_sizes(df, keys).agg(
        F.sum(size).alias("total_rows"), F.count("*").alias("n_strata"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.avg(size).alias("avg_size"),
        F.count_if(size < 10).alias("below_10"), F.count_if(size < 50).alias("below_50"), F.count_if(size < 100).alias("below_100"),
    )
    return out.withColumn("sample_rows", F.least(F.lit(target).cast("long"), "total_rows"))


def smallest_strata(df: DataFrame, keys: list[str] = STRATA, n: int = 10) -> DataFrame:
    return strata_sizes(df, keys).orderBy("strata_size", *[F.col(k).asc_nulls_last() for k in keys]).limit(n)
