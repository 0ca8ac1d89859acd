"""How close synthetic rows are to real ones, and how useful."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..sources.scratch import Scratch
from .forest import fit_forest
from .mlprep import free_domains, one_hot

SLICES = 512
#: Rows that a task of a forest's fit holds with their bootstrap counts, some 600 MB for 100 trees.
FOREST_ROWS = 1_000_000


def _long(real: DataFrame, synthetic: DataFrame, columns: list[str], value) -> DataFrame:
    """Rows (column, v, real, synthetic): how often each value of each column occurs on either side."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in columns])
    side = lambda df, s: df.select(F.explode(cells).alias("e"), F.lit(s).alias("s")).select("e.column", "e.v", "s")
    both = side(real, 0).unionByName(side(synthetic, 1))
    return both.groupBy("column", "v").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))


def ks_statistics(real: DataFrame, synthetic: DataFrame, columns: list[str], slices: int = SLICES) -> DataFrame:
    """One row a column: the two-sample Kolmogorov-Smirnov statistic over known values.

    Values are counted first. Slices of each column's range, from a sketch, are then summed, so that running counts are
    made within a slice and begin with what the slices before it hold; no task orders all values.
    """
    counts = _long(real, synthetic, columns, lambda c: F.col(c).cast("double")).where("v is not null and not isnan(v)")
    cuts = counts.groupBy("column").agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 10_000).alias("cuts"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    placed = counts.join(F.broadcast(cuts), "column")  # one row a column
    placed = placed.withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = placed.groupBy("column", "slice").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    earlier = W.partitionBy("column").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # at most SLICES rows
    base = sums.select("column", "slice", F.coalesce(F.sum("sa").over(earlier), F.lit(0)).alias("oa"), F.coalesce(F.sum("sb").over(earlier), F.lit(0)).alias("ob"))
    upto = W.partitionBy("column", "slice").orderBy("v")
    run = placed.withColumns({"ca": F.sum("a").over(upto), "cb": F.sum("b").over(upto)}).join(base, ["column", "slice"])
    gap = F.abs(F.try_divide(F.col("ca") + F.col("oa"), F.col("na").cast("double")) - F.try_divide(F.col("cb") + F.col("ob"), F.col("nb").cast("double")))
    return run.groupBy("column").agg(F.max(gap).alias("value")).select("column", F.lit("continuous").alias("type"), F.lit("ks_statistic").alias("metric"), "value")


def total_variations(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: the total variation distance of its values, compared as text, with null as a value."""
    counts = _long(real, synthetic, columns, lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan")))
    totals = counts.groupBy("column").agg(F.sum("a").cast("double").alias("na"), F.sum("b").cast("double").alias("nb"))
    gap = F.sum(F.abs(F.try_divide("a", "na") - F.try_divide("b", "nb"))) / 2
    both = counts.join(F.broadcast(totals), "column")  # one row a column
    return both.groupBy("column").agg(gap.alias("value")).select("column", F.lit("categorical").alias("type"), F.lit("tvd").alias("metric"), "value")


def fidelity_report(real: DataFrame, synthetic: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """One row a column: KS statistic or total variation distance."""
    parts = ([ks_statistics(real, synthetic, continuous)] if continuous else []) + ([total_variations(real, synthetic, categorical)] if categorical else [])
    return reduce(DataFrame.unionByName, parts).withColumn("value", rounded(F.col("value")))


def fidelity_means(report: DataFrame) -> DataFrame:
    """Mean value of each metric."""
    return report.groupBy("metric").agg(rounded(F.avg("value"), 4).alias("mean_value"))


def regression_scores(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """R2 and mean absolute error."""
    y, p = F.col(label), F.col(prediction)
    s = rows.agg(F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.avg(F.abs(y - p)).alias("mae"))
    return s.select(rounded(F.lit(1.0) - F.try_divide("sse", "sst"), 4).alias("r2"), rounded(F.col("mae"), 4).alias("mae"))


def forest_utility(train: DataFrame, test: DataFrame, features: list[str], label: str = "trip_duration", trees: int = 100, depth: int = 30, seed: int = 42) -> DataFrame:
    """R2 and error on ``test`` of a random forest fitted on ``train``; rows with an unknown feature are left out.

    The published forest has 100 trees of any depth; 30 is the greatest depth that Spark's trees take. Training rows are
    computed and written once and dealt evenly to all cores, in turns of ``FOREST_ROWS`` rows a task: small tables would lie in
    a task or two, and each task sends the histograms of all nodes, so more tasks than that only add to them.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    number = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]])
    forest = RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    with Scratch(train.sparkSession) as own:
        rows = own.write(assembler.transform(number(train)).select("features", label), "training-rows")
        cores = train.sparkSession.sparkContext.defaultParallelism
        model = forest.fit(rows.repartition(cores * max(1, ceil(rows.count() / (cores * FOREST_ROWS)))))
    return regression_scores(model.transform(assembler.transform(number(test))), label, "prediction")


def binned_forest_utility(train: DataFrame, test: DataFrame, features: list[str], label: str = "trip_duration", trees: int = 100, depth: int = 10, seed: int = 42, stored: bool = False) -> DataFrame:
    """The same by a forest of bounded depth that is grown in passes over binned rows (``forest``), for large tables."""
    model = fit_forest(train, features, label, trees, depth, seed, stored=stored)
    return regression_scores(model.predict(test, "__prediction"), label, "__prediction")


def coded_features(frames: list[DataFrame], categorical: list[str], label: str = "trip_duration") -> tuple[list[DataFrame], list[str]]:
    """The frames with 0/1 columns in place of their text columns, the same ones in each, and the names of the features.

    Missing numbers count as 0; a value that a frame lacks is a column of zeros there.
    """
    texts = [c for c in categorical if dict(frames[0].dtypes)[c] == "string"]
    domains = free_domains(frames, texts) if texts else {}
    numbers = [c for c in frames[0].columns if c not in (*texts, label)]
    filled = [one_hot(f, domains).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers}) if domains else f for f in frames]
    named = {f"{c}_{v}": f"f{i}" for i, (c, v) in enumerate((c, v) for c, values in domains.items() for v in values)}
    return [f.withColumnsRenamed(named) for f in filled], [*numbers, *named.values()]


def gap_label(gap: Column) -> Column:
    """Words for the difference between real and synthetic training."""
    return F.when(gap < 0.05, "Excellent").when(gap < 0.10, "Good").when(gap < 0.20, "Moderate").otherwise("Poor")


def bootstrap_generator(real: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A plain stand-in for a learned generator: n exact random rows of the real table. It is no diffusion model."""
    from .sample import uniform_sample

    return uniform_sample(real, n, seed)


def evaluate_synthetic(real: DataFrame, test: DataFrame, synthetic: DataFrame, continuous: list[str], categorical: list[str], label: str = "trip_duration", **forest) -> dict:
    """Fidelity and utility of synthetic rows as a report; the frames should be written tables, since each is read several times."""
    rows = [r.asDict() for r in fidelity_report(real, synthetic, continuous, categorical).collect()]
    mean = lambda m: round(sum(v) / len(v), 4) if (v := [r["value"] for r in rows if r["metric"] == m and r["value"] is not None]) else None
    (train, other, held), features = coded_features([real, synthetic, test], categorical, label)
    own, transferred = (forest_utility(t, held, features, label, **forest).first().asDict() for t in (train, other))
    return {"fidelity": rows, "mean_ks": mean("ks_statistic"), "mean_tvd": mean("tvd"), "trtr": own, "tstr": transferred, "transfer_gap": round(own["r2"] - transferred["r2"], 4)}
