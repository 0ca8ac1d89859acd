"""Near copies by exact Jaccard similarity of five-word shingles, over groups that SimHash has already made.

Two texts are near copies if their sets of shingles of ``SHINGLE`` = 5 words (ASCII lower case; a shorter text is one
shingle) have a Jaccard similarity of at least ``SIMILAR`` = 0.8. SimHash can't reach that far: at 0.8 two 64-bit
fingerprints differ in about 10 bits, and balls for a radius of 16 would compare nearly all pairs. So candidates share
one of ``BANDS`` = 24 bands of ``ROWS`` = 5 min-hashes, which a pair at exactly 0.8 misses with a chance of 0.7 in
10,000 and a closer pair less often. Before any text is read, the two signatures are compared: 4 bits of each of the 120
min-hashes, of which a pair at 0.8 shares 97.5 on average, with a deviation of 4.3. Fewer than ``AGREE`` = 79 rule a pair
out, which loses one at exactly 0.8 with a chance of 0.2 in 10,000; of pairs at 0.55 it rules out 95 in 100. What is left is
verified on the two texts.

Texts with equal shingles in one group are one node. Buckets are settled by stars: in each of ``STARS`` rounds every
member is compared with one member, and what is linked is contracted. In the first round that is the member whose bands
are the most common ones, by which the text that others were made from is found; in later rounds it is drawn anew. Only
buckets that still hold several groups compare all pairs of different groups, so no bucket is capped; such pairs are tested
as they are joined, and only those that agree are joined. They must also pass the parities of their shingles in
``64 * PARITIES`` bins: each shingle that one text alone has turns one of them, so two sets differ in at least as many shingles as
bins, and this test loses no pair. Of texts of some 1,000 shingles and fewer it leaves hardly any below ``SIMILAR``.

Defined results: null texts and texts without a word are no near copies of anything; repeated rows are one node; an empty
table gives an empty result; other columns don't enter. A long text is worked on whole, with some 40 bytes for each word.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks_of, hash_words, map_texts, mix64, spans_hash
from .components import connected_components

SHINGLE, SIMILAR, BANDS, ROWS, STARS, AGREE, PARITIES = 5, 0.8, 24, 5, 3, 79, 32
#: Longs of a signature, of 16 min-hashes each.
_LONGS = -(-BANDS * ROWS // 16)
_SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ODD = np.uint64(0x9FB21C651E98DF25)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of several texts, and the offsets at which each text's begin (one more at the end)."""
    words, offsets = hash_words([t.lower() for t in texts])
    n = np.diff(offsets)
    counts = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], counts)
    ends = np.minimum(starts + SHINGLE, np.repeat(offsets[1:], counts))
    return spans_hash(words, starts, ends), bounds


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def band_keys(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (row) one key a band (column), and its signature; texts begin at ``firsts`` and have a shingle each."""
    out, signature, k = np.empty((len(firsts), BANDS), np.uint64), np.zeros((len(firsts), _LONGS), np.uint64), 0
    for band in range(BANDS):
        key = np.full(len(firsts), band + 1, np.uint64)
        for salt in _SALTS[band * ROWS : (band + 1) * ROWS]:
            x = hashes * salt
            x ^= x >> np.uint64(32)
            x *= _ODD
            least = np.minimum.reduceat(x, firsts)
            key = mix64(key ^ least)
            signature[:, k // 16] |= (mix64(least) & np.uint64(15)) << np.uint64(4 * (k % 16))
            k += 1
        out[:, band] = key
    return out, signature


def agreeing(a: Column, b: Column) -> Column:
    """Min-hashes whose four bits are equal in two signatures."""
    unlike = []
    for k in range(_LONGS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unlike.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return F.lit(BANDS * ROWS) - reduce(Column.__add__, unlike)


def parities(shingle_set: np.ndarray) -> np.ndarray:
    """Whether the shingles in each bin are odd in number, as the bits of ``PARITIES`` longs."""
    bins = (shingle_set & np.uint64(64 * PARITIES - 1)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=64 * PARITIES) & 1).astype(np.uint8), bitorder="little").view("<i8")


def may_be_similar(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """False only if sets of ``na`` and ``nb`` shingles with these parities have a similarity below ``SIMILAR``."""
    turned = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return turned <= (na + nb) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6


def sketches(docs: DataFrame) -> DataFrame:
    """Rows (key, same, n, bands, signature, parity) of the rows (key, text) with a word: a hash of the shingle set, its size, the band keys, the signature and the parities."""

    def run(table: pa.Table):
        keys = table.column("key").to_pylist()
        texts = [(i, _bytes(t)) for i, t in enumerate(table.column("text").to_pylist())]
        for part in chunks_of(texts, 500_000):
            hashes, bounds = shingles([t for _, t in part])
            some = np.flatnonzero(np.diff(bounds))
            if not len(some):
                continue
            sets = [np.unique(hashes[bounds[t] : bounds[t + 1]]) for t in some]
            same = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            bands, signature = band_keys(hashes, bounds[some])
            columns = [pa.array([keys[part[t][0]] for t in some], pa.int64()), pa.array(same.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array(list(signature.view(np.int64)), pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "same", "n", "bands", "signature", "parity"])

    return map_texts(docs.select("key", "text"), run, "key long, same long, n int, bands array<long>, signature array<long>, parity array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, ra, rb) whose texts are near copies, as (ra, rb)."""

    def run(table: pa.Table):
        kept, last, left = [], None, None
        for k, (a, x, y) in enumerate(zip(*(table.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True)):
            if a != last:
                last, left = a, np.unique(shingles([_bytes(x)])[0])
            right = np.unique(shingles([_bytes(y)])[0])
            both = len(np.intersect1d(left, right, assume_unique=True))
            if both >= SIMILAR * (len(left) + len(right) - both) - 1e-9:
                kept.append(k)
        yield from table.select(["ra", "rb"]).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    return map_texts(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "ra", "rb", "text_a", "text_b"), run, "ra long, rb long", 100)


def near_copy_roots(docs: DataFrame, roots: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (root, merged): groups ``root`` of the rows (key, root) that near copies among (key, text) join; the rest are left out.

    ``key`` is unique in ``docs``, and in ``roots``.
    """
    with Scratch(docs.sparkSession, scratch) as own:
        found = own.write(sketches(docs).join(roots, "key"), "sketches")
        nodes = found.groupBy("root", "same").agg(F.min_by(F.struct("key", "n", "bands"), "key").alias("s"))
        filed = nodes.select(F.explode("s.bands").alias("band"), F.col("s.key").alias("node"), F.col("s.n").alias("n"), "root")
        filed = own.write(_open(filed), "sized-buckets")
        common = filed.groupBy("node").agg(F.sum("size").alias("common"))
        signatures = found.select(F.col("key").alias("node"), "signature")
        filed = own.write(filed.drop("size").join(signatures.join(common, "node"), "node"), "open-buckets")
        texts = own.hold(docs.select("key", "text").join(filed.select(F.col("node").alias("key")).distinct(), "key", "left_semi"))
        merged, tried = None, None
        for star in range(STARS + 1):
            if filed.isEmpty():
                break
            if star == STARS:
                filed = filed.join(found.select(F.col("key").alias("node"), "parity"), "node")
            more = ["parity"] if star == STARS else []
            left = filed.select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"), F.col("root").alias("ra"), "common", *[F.col(c).alias("pa") for c in more])
            if star < STARS:
                order = F.struct(*([-F.col("common")] if star == 0 else []), F.xxhash64("a", F.lit(star)), "a")
                left = left.groupBy("band").agg(F.min_by(F.struct("a", "na", "sa", "ra"), order).alias("s")).select("band", "s.*")
            right = filed.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"), F.col("root").alias("rb"), *[F.col(c).alias("pb") for c in more])
            unlike = F.col("ra") != F.col("rb") if star < STARS else F.col("ra") < F.col("rb")
            close = F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb") - 1e-9
            alike = agreeing(F.col("sa"), F.col("sb")) >= AGREE
            if star == STARS:
                alike = alike & may_be_similar(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"))
            pairs = left.join(right, "band").where(unlike & close & alike).select("a", "b", "ra", "rb").distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = own.write(pairs, "candidates")
            tested = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            tried = tested if tried is None else tried.unionByName(tested)
            links = own.write(_verified(pairs, texts).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "near-copies")
            if links.isEmpty():
                continue
            step = connected_components(links, own).select(F.col("node").alias("root"), F.col("root").alias("next"))
            if star < STARS:
                filed = own.write(_open(filed.join(step, "root", "left").select("band", "node", "n", "signature", "common", F.coalesce("next", "root").alias("root"))).drop("size"), "open-buckets")
            if merged is None:
                merged = step.select("root", F.col("next").alias("merged"))
            else:
                # what earlier rounds merged moves on; a root met only now joins as itself
                moved = merged.join(step.select(F.col("root").alias("merged"), "next"), "merged", "left").select("root", F.coalesce("next", "merged").alias("merged"))
                fresh = step.select("root", F.col("next").alias("merged")).join(merged, "root", "left_anti")
                merged = moved.unionByName(fresh)
        if merged is None:
            merged = docs.sparkSession.createDataFrame([], "root long, merged long")
        return own.keep(merged, "merged-groups")


def _open(filed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one group, with each bucket's ``size``."""
    several = filed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high").select("band", "size")
    return filed.join(several, "band")
