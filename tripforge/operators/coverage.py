"""Hours that sources cover, as bitmaps: one bit an hour, in blocks of 32,768 hours, which are united, intersected and counted as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours of one bitmap: the bits that Spark's bitmap functions keep in a row.
BLOCK = 32_768


#: Hours from the year 1 to 1970, so that numbers of all dates are positive.
_BEFORE_1970 = 719_162 * 24


def hour_number(at: Column) -> Column:
    """Whole hours since the year 1."""
    return (F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(3_600_000_000)) + _BEFORE_1970).cast("long")


def hour_of(number: Column) -> Column:
    """The time at which an hour begins."""
    return F.timestamp_seconds((number - _BEFORE_1970) * 3600).cast("timestamp_ntz")


def hour_bitmaps(rows: DataFrame, by: list[str], at: Column, known: Column | None = None) -> DataFrame:
    """Bitmaps (by, block, bits) of the hours in which a source has a row (for which ``known`` holds). Bits are set by a partial aggregate."""
    hours = rows.where(at.isNotNull() if known is None else at.isNotNull() & known).select(*by, hour_number(at).alias("__hour"))
    return hours.groupBy(*by, F.bitmap_bucket_number("__hour").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__hour")).alias("bits"))


def span_bitmaps(first: int, last: int, spark: SparkSession) -> DataFrame:
    """Bitmaps (block, wanted) of the hours from one hour number to another."""
    hours = spark.range(first, last + 1)
    return hours.groupBy(F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("wanted"))


def unite(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """Hours that any of a group's sources covers."""
    return bitmaps.groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(bitmaps: DataFrame, by: list[str], sources: Column) -> DataFrame:
    """Hours that all of a group's sources cover; ``sources`` is their number. A block that one of them lacks has none."""
    both = bitmaps.groupBy(*by, "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("__have"), F.first(sources).alias("__of"))
    return both.where("__have = __of").drop("__have", "__of")


def covered(bitmaps: DataFrame, by: list[str], name: str = "hours_covered") -> DataFrame:
    """Hours of each group's bitmaps."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def within(bitmaps: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """The bitmaps' hours from one hour number to another."""
    span = span_bitmaps(first, last, bitmaps.sparkSession)
    cut = bitmaps.join(F.broadcast(span), "block")  # a row for every 32,768 hours
    both = F.explode(F.array("bits", "wanted")).alias("bits")
    return cut.select(*by, "block", both).groupBy(*by, "block").agg(F.bitmap_and_agg("bits").alias("bits"))


def gaps(bitmaps: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """Stretches of hours (by, from_hour, to_hour: numbers) from one hour number to another in which a group has no bit."""
    span = span_bitmaps(first, last, bitmaps.sparkSession).select("block")
    blocks = bitmaps.select(*by).distinct().crossJoin(F.broadcast(span)).join(bitmaps, [*by, "block"], "left")  # a row for every 32,768 hours
    hours = F.sequence(F.greatest(F.lit(first), (F.col("block") - 1) * BLOCK + 1), F.least(F.lit(last), F.col("block") * BLOCK))
    place = f"cast(pmod(h - 1, {BLOCK}) as int)"
    free = F.expr(f"filter(hours, h -> bits is null or (cast(conv(hex(substring(bits, {place} div 8 + 1, 1)), 16, 10) as int) & shiftleft(1, {place} % 8)) = 0)")
    merged = blocks.withColumn("hours", hours).select(*by, free.alias("free")).groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("free"))).alias("free"))
    starts, ends = F.expr("filter(free, (h, i) -> i = 0 or get(free, i - 1) != h - 1)"), F.expr("filter(free, (h, i) -> i = size(free) - 1 or get(free, i + 1) != h + 1)")
    stretches = merged.select(*by, F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("z"))
    return stretches.select(*by, F.col("z.s").alias("from_hour"), F.col("z.e").alias("to_hour"))


def pair_coverage(bitmaps: DataFrame, source: str = "source") -> DataFrame:
    """For each two sources: the hours that one of them covers, and those that both do. Sources are the candidates of a place, 25 at most there."""
    a, b = bitmaps.select(F.col(source).alias("a")).distinct(), bitmaps.select(F.col(source).alias("b")).distinct()
    pairs = a.join(b, F.col("a") < F.col("b"))
    either = pairs.select("a", "b", F.explode(F.array("a", "b")).alias(source)).join(bitmaps, source)
    blocks = either.groupBy("a", "b", "block").agg(F.bitmap_or_agg("bits").alias("any"), F.bitmap_and_agg("bits").alias("all"), F.count("*").alias("have"))
    return blocks.groupBy("a", "b").agg(F.sum(F.bitmap_count("any")).alias("hours_any"), F.sum(F.when(F.col("have") == 2, F.bitmap_count("all")).otherwise(0)).alias("hours_both"))


def best_pair(bitmaps: DataFrame, source: str = "source") -> DataFrame:
    """The two sources that cover most hours together, then with fewest in common, then by name."""
    return pair_coverage(bitmaps, source).orderBy(F.col("hours_any").desc(), "hours_both", "a", "b").limit(1)
