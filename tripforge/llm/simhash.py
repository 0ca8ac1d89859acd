"""SimHash near-duplicates by multi-index hashing.

Fingerprints within ``RADIUS`` = 3 bits agree, but for one bit at most, on one of their two 32-bit segments. So every
distinct fingerprint is filed once under each segment and looks up the small Hamming ball of radius 1 around each of its
segments; matches are verified on all 64 bits. A pair one bit apart in a segment is found from the side whose bit is 0,
so half a ball is enough. Buckets with more than ``BUCKET`` fingerprints are filed a second time by the halves of the
other segment, of which one must again agree but for one bit; no pair is dropped.

Equal fingerprints are one node, so copies never multiply. Groups are the connected components of the links.

Defined results: null or empty texts have fingerprint zero, linked like any other; a null id never names a component
unless all its ids are null; repeated rows each keep their row; an empty table gives an empty result. Other columns of the
input don't enter: only ``doc_id``, the text and the columns named by ``carry`` are read. A long text is worked on whole,
its shingles hashed one by one and counted 65,536 at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_texts, read_table
from .components import connected_components

RADIUS, SHINGLE, SEED, BUCKET = 3, 3, 42, 200


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    ones, n, block = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    for start in range(0, len(hashes), 65536):
        block = hashes[start : start + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and ``fp``, the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def run(table: pa.Table):
        values = [fingerprint(t) for t in table.column("__text").to_pylist()]
        fps = pa.array(np.array(values, np.uint64).view(np.int64))
        yield from table.drop_columns(["__text"]).append_column("fp", fps).to_batches()

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("fp", "long")
    return map_texts(rows, run, schema)


def _segments(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]


def _ball(key: Column, bits: int, whole: bool) -> Column:
    """The key and those with one more bit set; with ``whole`` also those with one bit less."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.concat(F.array(key), F.transform(flips if whole else F.filter(flips, lambda f: key.bitwiseAND(f) == 0), lambda f: key.bitwiseXOR(f)))


def hamming_links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in at most ``radius`` (3 or fewer) bits."""
    filed = fps.select("fp", F.posexplode(F.array(*_segments(F.col("fp")))).alias("seg", "key"))
    counts = filed.groupBy("seg", "key").count().where(F.col("count") > bucket).select("seg", "key")
    crowded = scratch.hold(counts)
    probes = filed.select(F.col("fp").alias("a"), "seg", F.explode(_ball(F.col("key"), 32, False)).alias("key"))
    entries = filed.select(F.col("fp").alias("b"), "seg", "key")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (F.col("a") != F.col("b"))
    links = probes.join(entries.join(crowded, ["seg", "key"], "left_anti"), ["seg", "key"]).where(near)
    if not crowded.isEmpty():
        other = lambda c: F.when(F.col("seg") == 0, _segments(F.col(c))[1]).otherwise(_segments(F.col(c))[0])
        halves = lambda c: F.array(F.shiftrightunsigned(other(c), 16), other(c).bitwiseAND(F.lit(0xFFFF)))
        fine = probes.join(crowded, ["seg", "key"]).select("*", F.posexplode(halves("a")).alias("half", "part"))
        fine = fine.select("a", "seg", "key", "half", F.explode(_ball(F.col("part"), 16, True)).alias("part"))
        filed_fine = entries.join(crowded, ["seg", "key"]).select("*", F.posexplode(halves("b")).alias("half", "part"))
        links = links.select("a", "b").unionByName(fine.join(filed_fine, ["seg", "key", "half", "part"]).where(near).select("a", "b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """One row per document row: doc_id, the columns ``carry``, fp, root (one fingerprint names each group) and component_id,
    the smallest id reachable over links."""
    with Scratch(docs.sparkSession, scratch) as own:
        rows = own.keep(with_fingerprint(docs, text, ["doc_id", *carry]), "fingerprints")
        first = own.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
        roots = connected_components(hamming_links(first.select("fp"), own), own)
        named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        groups = own.keep(named.join(least, "root").select("fp", "root", "component_id"), "fingerprint-groups")
    return rows.join(groups, "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash_groups(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
