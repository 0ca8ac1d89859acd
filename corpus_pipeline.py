"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, secret scans, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripforge.llm.bpe import encode, vocabulary_path
from tripforge.llm.common import Scratch, read_table, text_key
from tripforge.llm.decontaminate import find_leaks
from tripforge.llm.near_copies import near_copy_roots
from tripforge.llm.quality import judge_lines
from tripforge.llm.secrets import mask_secrets, scan_secrets, text_digest
from tripforge.llm.simhash import simhash_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No DuckDB SQL expresses SimHash components, CGK tables or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def _documents(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; the rest lose the lines that fail."""
    judged = judge_lines(docs.select(*COLUMNS))
    return _documents(judged.where("quality.kept"), "quality.clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id (null last) of each group of near copies; of repeated rows, one.

    Links are those of op7, and all pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Rows
    are known by a 64-bit hash of where they stand in their Parquet files (rows from elsewhere are numbered in a written
    table), so that whole texts enter no aggregate and rows that repeat are told apart.
    """
    with Scratch(spark) as own:
        try:
            rows = docs.select(*COLUMNS, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row"))
        except AnalysisException:
            rows = own.keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered-rows")
        groups = own.write(simhash_groups(rows, carry=("row",), scratch=own), "groups")
        merged = near_copy_roots(rows.select(F.col("row").alias("key"), "text"), groups.select(F.col("row").alias("key"), "root"), own)
        groups = groups.join(merged, "root", "left").withColumn("root", F.coalesce("merged", "root"))
        first = groups.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
        first = own.keep(first.select("row"), "first-of-groups")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    keyed = docs.select(*COLUMNS, text_key(F.col("doc_id"), F.col("text")).alias("key"))
    leaks = find_leaks(keyed.select(F.col("key").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    with Scratch(spark) as own:
        leaks = own.keep(leaks.select(F.col("doc_id").alias("key")).distinct(), "leaking")
    return keyed.join(leaks, "key", "left_anti").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets found in each text."""
    spans = scan_secrets(docs.select("doc_id", "text")).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    keyed = docs.select(*COLUMNS, text_digest(F.col("doc_id"), F.col("text")).alias("key"))
    masked = keyed.join(spans, "key", "left").withColumn("masked", F.when(F.col("spans").isNull(), F.col("text")).otherwise(mask_secrets(F.col("text"), F.col("spans"))))
    return _documents(masked, "masked")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = read_table(spark, sf_dir, "documents")
    with Scratch(spark) as own:
        for k, (name, stage) in enumerate(STAGES, 1):
            write = own.keep if k == len(STAGES) else own.write
            docs = write(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
