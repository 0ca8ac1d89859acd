"""Tables laid out for one join: bucketed and sorted by its key on both sides, so that later joins need no exchange."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .enrich import require_unique

_LAYOUT = ["__key", "__salt"]


def _key(keys: list[str]) -> Column:
    """One text of all keys, null apart from any value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("-")) for k in keys]
    return F.concat_ws("\x1f", *parts)


@dataclass
class Layout:
    """Two bucketed tables of the catalogue that join many to one."""

    spark: SparkSession
    left: str
    right: str
    keys: list[str]

    def joined(self, columns: list[str] | None = None) -> DataFrame:
        """The left rows with the right columns (or some of them), null where there is no match; a sort-merge join without an exchange or a sort."""
        right = self.spark.table(self.right)
        right = right.select(*_LAYOUT, *columns) if columns is not None else right
        return self.spark.table(self.left).join(right.hint("merge"), _LAYOUT, "left").drop(*_LAYOUT)

    def drop(self) -> None:
        for name in (self.left, self.right):
            self.spark.sql(f"drop table if exists {name}")


def lay_out(left: DataFrame, right: DataFrame, keys: list[str], buckets: int | None = None, hot_rows: int | None = None) -> Layout:
    """Write both sides of a many-to-one join in ``buckets`` (default: the session's shuffle partitions) by ``keys``; null keys match null keys.

    A key with more than ``hot_rows`` left rows (default: half of a bucket's even share) is split by salt into parts of that many, and
    its one right row is written once for each part. Both tables are shuffled here, once, for all joins to come.
    """
    spark = left.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    require_unique(right, keys)
    with Scratch(spark) as own:
        counts = left.groupBy(_key(keys).alias("__key")).agg(F.count("*").alias("__n"))
        if hot_rows is None:
            counts = own.write(counts, "key-counts")
            hot_rows = max(1, (counts.agg(F.sum("__n")).first()[0] or 0) // (2 * buckets))
        hot = own.write(counts.where(F.col("__n") > hot_rows).select("__key", F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__parts")), "hot-keys")
        parts = F.coalesce("__parts", F.lit(1))
        salted = left.withColumn("__key", _key(keys)).join(hot, "__key", "left")
        salted = salted.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
        copied = right.withColumn("__key", _key(keys)).drop(*keys).join(hot, "__key", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        names = []
        for side, rows in (("left", salted), ("right", copied)):
            name = f"laid_out_{side}_{uuid.uuid4().hex}"
            written = rows.repartition(buckets, *_LAYOUT).sortWithinPartitions(*_LAYOUT).write.bucketBy(buckets, *_LAYOUT).sortBy(*_LAYOUT)
            written.option("path", own.place(name)).saveAsTable(name)
            names.append(name)
    return Layout(spark, *names, keys)
