"""Exact interpolated quantiles that don't gather a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

ACCURACY, SLICES = 10_000, 64


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], at: list[float], accuracy: int = ACCURACY, more: dict[str, Column] | None = None, stored: bool = False) -> DataFrame:
    """Rows (by..., column, p, value), nulls left out; value is null for a group without values.

    The columns needed are written once, unless ``df`` is a ``stored`` table. A sketch brackets each rank to within 2 / accuracy of the rows; values within a
    bracket are counted by ``SLICES`` of its width, and only the slices that hold the two values around the rank are
    ordered, so no task orders a bracket. Groups of up to ``accuracy`` rows are bracketed whole. Brackets are joined back
    as one row a group, from a written table, so Spark knows whether they are few enough to broadcast. ``more`` names
    aggregates of the columns that come with each row, from the pass of the sketch.
    """
    by, more = list(by), more or {}
    keys = [f"__g{i}" for i in range(len(by))]
    same = lambda extra=(): reduce(Column.__and__, [*(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), *extra], F.lit(True))
    named = lambda side: [F.col(f"{side}.{k}").alias(k) for k in keys]
    edges = [x for p in at for x in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    made = [e.alias(f"__m_{n}") for n, e in more.items()]
    for c in columns:
        made += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.percentile_approx(c, edges, accuracy).alias(f"q_{c}")]
    spans = []
    for c in columns:
        for i, p in enumerate(at):
            small = F.col(f"n_{c}") <= accuracy
            lo = F.when(small | F.lit(p <= 2 / accuracy), F.col(f"lo_{c}")).otherwise(F.col(f"q_{c}")[2 * i])
            hi = F.when(small | F.lit(p >= 1 - 2 / accuracy), F.col(f"hi_{c}")).otherwise(F.col(f"q_{c}")[2 * i + 1])
            spans.append(F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), F.col(f"n_{c}").alias("n"), lo.alias("lo"), hi.alias("hi")))
    with Scratch(df.sparkSession) as own:
        slim = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
        slim = slim.withColumnsRenamed(dict(zip(by, keys, strict=True)))
        slim = slim if stored else own.write(slim, "quantile-rows")
        frame = slim.groupBy(*keys).agg(*made).select(*keys, F.array(*spans).alias("spans"), *[f"__m_{n}" for n in more])
        frame = own.write(frame, "quantile-brackets")
        joined = slim.alias("a").join(frame.select(*keys, "spans").alias("b"), same())
        # below a bracket only the count matters: those rows share one value, in slice -1
        cells = []
        for i, c in enumerate(c for c in columns for _ in at):
            x, span = F.col(f"a.{c}"), F.col("spans")[i]
            part = F.coalesce(F.try_divide(x - span["lo"], span["hi"] - span["lo"]), F.lit(0.0))
            slice_ = F.least(F.lit(SLICES - 1), F.floor(part * SLICES)).cast("int")
            inside = x >= span["lo"]
            cells.append(F.when(x <= span["hi"], F.struct(F.lit(i).alias("i"), F.when(inside, slice_).otherwise(-1).alias("slice"), F.when(inside, x).alias("x"))))
        cells = F.filter(F.array(*cells), lambda e: e.isNotNull())
        counts = joined.select(*named("a"), F.explode(cells).alias("e")).groupBy(*keys, "e.i", "e.slice", "e.x").agg(F.count("*").alias("n"))
        counts = own.write(counts, "quantile-counts")
        before = W.partitionBy(*keys, "i").orderBy("slice")  # SLICES + 1 rows at most
        slices = counts.groupBy(*keys, "i", "slice").agg(F.sum("n").alias("held"))
        slices = slices.withColumn("before", F.sum("held").over(before) - F.col("held"))
        slices = slices.alias("a").join(frame.alias("b"), same()).select(*named("a"), "i", "slice", "held", "before", F.col("spans")[F.col("i")].alias("s"))
        rank = F.col("s.p") * (F.col("s.n") - 1)
        low = F.floor(rank)
        high = F.least(low + 1, F.col("s.n") - 1)
        slices = slices.select(*keys, "i", "slice", "before", "held", low.alias("low"), high.alias("high"), (rank - low).alias("part"))
        holds = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("before") + F.col("held"))
        slices = own.write(slices.where(holds("low") | holds("high")), "quantile-slices")
        match = same([F.col("a.i") == F.col("b.i"), F.col("a.slice") == F.col("b.slice")])
        near = counts.where("x is not null").alias("a").join(slices.alias("b"), match).select(*named("a"), F.col("a.i").alias("i"), F.col("a.slice").alias("slice"), "x", "n", "before", "low", "high", "part")
        upto = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "i", "slice").orderBy("x"))
        found = near.withColumn("upto", upto).groupBy(*keys, "i").agg(F.min(F.when(F.col("upto") > F.col("low"), F.col("x"))).alias("x0"), F.min(F.when(F.col("upto") > F.col("high"), F.col("x"))).alias("x1"), F.first("part").alias("part"))
        every = frame.select(*keys, F.posexplode("spans").alias("i", "s"), *[f"__m_{n}" for n in more])
        out = every.alias("a").join(found.alias("b"), same([F.col("a.i") == F.col("b.i")]), "left")
        value = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("part")
        columns_out = [F.col(f"a.{k}").alias(b) for k, b in zip(keys, by, strict=True)]
        return own.keep(out.select(*columns_out, F.col("s.column").alias("column"), F.col("s.p").alias("p"), value.alias("value"), *[F.col(f"a.__m_{n}").alias(n) for n in more]), "quantiles")


def quantiles_wide(df: DataFrame, by: list[str], columns: list[str], names: dict[float, str], accuracy: int = ACCURACY, more: dict[str, Column] | None = None, stored: bool = False) -> DataFrame:
    """One row a group, with a column ``<name>_<column>`` for each quantile (``<name>`` if there is one column), and ``more`` aggregates."""
    long = exact_quantiles(df, by, columns, list(names), accuracy, more, stored)
    pick = [F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("value"))).alias(f"{n}_{c}" if len(columns) > 1 else n) for c in columns for p, n in names.items()]
    return long.groupBy(*by).agg(*pick, *[F.first(n).alias(n) for n in more or {}])
