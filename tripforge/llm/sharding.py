"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input block sends to each shard is drawn first: the rows of the matrix are multivariate
hypergeometric, with shard sizes at most one apart. Every block then permutes its rows, deals them out by its row of the
matrix, and each shard permutes what it gets. The result is a uniformly random assignment and order.

The matrix is drawn the same way at every size: each block's counts are multinomial, and then the rows that a shard has
above its size, a uniform choice among all its rows, move to the shards below theirs in random order. No row is treated
unlike another, so all assignments with these sizes are equally likely, which is the hypergeometric law. About
sqrt(rows x shards) rows move.

A block is a run of at most ``BLOCK_ROWS`` rows of one partition, so the driver sees the counts of (partitions + rows /
``BLOCK_ROWS``) blocks, and draws as many rows of the matrix. The second permutation orders a shard by random keys in
stretches of about ``STRETCH`` rows, numbered from the stretches' counts, so a shard is no single task. Permutations and
places are worked out on row numbers alone; the rows themselves are written once, to fix their numbers, and moved
once, to meet their places.

Defined results: each input row gets one place, rows that repeat included; nulls and empty or very long texts are rows like
any other; an empty table gives an empty result. Input columns named shard or slot are replaced; other names don't
clash. With the same input files and seed the result is the same.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read_table

BLOCK_ROWS, STRETCH, SHARDS, SEED = 1_000_000, 1_000_000, 40, 20
_IN_PARTITION = 1 << 33  # the row numbers that Spark gives out in each partition


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows sent from each block (row) to each shard (column); column sums are at most one apart."""
    rng, choose, total = np.random.default_rng(seed), random.Random(seed), sum(counts)
    want = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.array([rng.multinomial(n, want / max(1, total)) for n in counts], np.int64).reshape(len(counts), shards)
    moved: list[np.ndarray] = []
    for s in range(shards):
        have = np.cumsum(out[:, s])
        above = int(have[-1] - want[s]) if len(have) else 0
        if above > 0:  # which of its rows, counted block by block
            blocks = np.searchsorted(have, np.array(choose.sample(range(int(have[-1])), above)), "right")
            out[:, s] -= np.bincount(blocks, minlength=len(counts))
            moved.append(blocks)
    if moved:
        places = np.repeat(np.arange(shards), np.maximum(want - out.sum(0), 0))
        np.add.at(out, (np.concatenate(moved), rng.permutation(places)), 1)
    return out


def uniform_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, scratch: Scratch | None = None, block_rows: int = BLOCK_ROWS, stretch: int = STRETCH) -> DataFrame:
    """All rows and columns with ``shard`` and ``slot`` (gapless from 0 within a shard) added."""
    spark = docs.sparkSession
    row = F.col("row")
    with Scratch(spark, scratch) as own:
        # fixes the rows' numbers
        rows = own.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered-rows")
        block = F.struct(F.shiftright(row, 33).alias("partition"), F.floor(row % _IN_PARTITION / block_rows).alias("part"))
        numbers = rows.select("row", block.alias("block"))
        counts = sorted((tuple(r["block"]), r["count"]) for r in numbers.groupBy("block").count().collect())
        total = sum(n for _, n in counts)
        matrix = communication_matrix([n for _, n in counts], shards, seed)
        sent = [(b, np.cumsum(r).tolist()) for (b, _), r in zip(counts, matrix, strict=True)]
        sent = spark.createDataFrame(sent, "block struct<partition:long,part:long>, sent array<long>")
        local = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "row"), "row")
        dealt = numbers.withColumn("rank", F.row_number().over(local)).join(sent, "block")
        stretches = max(1, math.ceil(total / shards / stretch))
        key = F.xxhash64(F.lit(seed + 1), "row")
        dealt = dealt.select("row", F.size(F.filter("sent", lambda c: c < F.col("rank"))).alias("shard"), key.alias("key"))
        dealt = dealt.withColumn("stretch", F.floor(F.pmod("key", F.lit(1 << 40)) * stretches / (1 << 40)).cast("int"))
        dealt = own.write(dealt, "dealt-rows")
        filled = dealt.groupBy("shard", "stretch").agg(F.count("*").alias("n"))  # shards x stretches rows
        before = filled.select("shard", "stretch", (F.sum("n").over(W.partitionBy("shard").orderBy("stretch")) - F.col("n")).alias("before"))
        place = F.row_number().over(W.partitionBy("shard", "stretch").orderBy("key", "row"))
        placed = dealt.withColumn("place", place).join(before, ["shard", "stretch"])
        places = own.keep(placed.select("row", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot")), "places")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(places, "row").select(*kept, "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder for each shard, in slot order within its files."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, under the law of equal row counts."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return uniform_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
