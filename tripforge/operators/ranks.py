"""Numbers of all rows in an order, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: The part of ``monotonically_increasing_id`` that numbers rows within their partition.
_WITHIN = 33


def with_row_number(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "row_number") -> DataFrame:
    """Add the place of each row in an order of all rows, from 1; equal rows get places next to each other.

    Rows are dealt to tasks by ranges of the order, sorted and numbered there, and written; what the ranges before a task hold is
    added to its numbers. The offsets are one row a task, so the window over them is small. The result reads a table of ``scratch``.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    rows = scratch.keep(sorted_rows, "rows-by-range")
    task = F.shiftright("__place", _WITHIN).alias("__task")
    counts = rows.groupBy(task).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.keep(counts.select("__task", before.alias("__before")), "range-offsets")
    numbered = rows.withColumn("__task", task).join(offsets, "__task")
    return numbered.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << _WITHIN) - 1)) + 1).drop("__place", "__task", "__before")
