"""Exact substring dedup by fixed-block anchors.

A window of ``window`` = 50 words that two documents share holds, whole, one of the non-overlapping reference blocks of
``window // 2`` words into which each of them is cut. So (1) reference blocks are indexed by hash, one row per distinct
block, and every rolling block-sized window of every document probes the index; a hit is a block seen in another
document. (2) Hits are extended, by hashes, to all words that windows around them reach, and windows are
compared with the smallest document in which they start; runs of matching windows are the maximal exact repeats. (3) The words
they cover go.

The index has one row per distinct block and the extension one aggregate per distinct window, so a passage that very many
documents share costs one row for each of its occurrences and never a pair of occurrences.

Defined results: null texts have no words; only a strictly smaller id removes anything, so rows that share an id, and
rows whose id is null, remove nothing from each other (a null id counts as larger than any). Repeated rows get equal
results. Words are known by XXH3 (64 bits for the anchors, two halves of 128 bits for contexts and windows), windows by
hashes that mix all bits at each step. A text is worked on whole, with some 60 bytes of memory for each of its words;
its windows are handed on ``AT_ONCE`` at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks_of, hash_words, hash_words_twice, map_texts, mix64, read_table, spans_hash, text_key, window_hashes

WINDOW = 50
#: Probes carry 48 bits of hash and the low 16 bits of the position in one long; false hits only cost work in (2).
HASH_BITS = 48
#: Windows of a batch that are handed on at a time.
AT_ONCE = 1 << 19


def _batches(table: pa.Table, hashes_of):
    """(first row, what ``hashes_of`` makes of the texts) for parts of a batch of about 2 MB of text."""
    texts = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in enumerate(table.column("text").to_pylist())]
    for part in chunks_of(texts):
        yield part[0][0], *hashes_of([t for _, t in part])


def _inside(offsets: np.ndarray, size: int, step: int, least: int) -> np.ndarray:
    """Every ``step``-th start of the windows of ``size`` words that lie within one text of ``least`` words or more."""
    spans = [np.arange(a, b - size + 1, step) for a, b in zip(offsets[:-1], offsets[1:], strict=False) if b - a >= least]
    return np.concatenate(spans) if spans else np.zeros(0, np.int64)


def anchors(docs: DataFrame, window: int, blocks_only: bool) -> DataFrame:
    """Rows (v, doc): 48 bits of the hash of a block-sized window, with the low 16 bits of its position above them."""
    size = window // 2

    def run(table: pa.Table):
        keys = table.column("doc").to_numpy()
        for first, words, offsets in _batches(table, hash_words):
            places = _inside(offsets, size, size if blocks_only else 1, window)
            hashes = window_hashes(words, size) if len(places) else None
            for k in range(0, len(places), AT_ONCE):
                at = places[k : k + AT_ONCE]
                row = np.searchsorted(offsets, at, "right") - 1
                v = ((at - offsets[row]).astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes[at] >> np.uint64(64 - HASH_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(keys[first + row])], ["v", "doc"])

    return map_texts(docs, run, "v long, doc long")


def repeat_hits(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Rows (doc, at): per document key, the positions (modulo 65536) of block-sized windows that match a block of another document.

    The matched reference blocks themselves are among them.
    """
    mask = F.lit((1 << HASH_BITS) - 1)
    place = lambda: F.shiftrightunsigned("v", HASH_BITS).cast("int").alias("at")
    with Scratch(docs.sparkSession, scratch) as own:
        blocks = own.write(anchors(docs, window, True).select("doc", place(), F.col("v").bitwiseAND(mask).alias("h")), "blocks")
        # written, so that the probes of a very common block can be split over tasks
        index = own.write(blocks.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")), "block-index")
        probes = anchors(docs, window, False)
        hit = (probes["v"].bitwiseAND(mask) == index["h"]) & ((index["lo"] != probes["doc"]) | (index["hi"] != probes["doc"]))
        hits = own.write(probes.join(index.hint("shuffle_hash"), hit).select("doc", place(), "h"), "probe-hits")
        met = own.write(hits.select("h").distinct(), "blocks-met")  # written, so that a very common block's rows can be split over tasks
        matched = own.write(blocks.join(met, "h", "left_semi").select("doc", "at"), "blocks-hit")
        both = hits.select("doc", "at").unionByName(matched)
        return own.keep(both.groupBy("doc").agg(F.collect_set("at").alias("at")), "repeat-hits")  # bounded by the words of one text


def _all_places(at: pa.Scalar, n: int, size: int) -> np.ndarray:
    """Positions of a text of n words that a list of positions modulo 65536 stands for."""
    low = np.asarray(at.as_py(), np.int64)
    places = np.unique(np.concatenate([low + base for base in range(0, n, 65536)]))
    return places[places <= n - size]


def _at_hits(docs: DataFrame, hits: DataFrame, places_of, hashes_of) -> DataFrame:
    """Rows (w1, w2, doc, doc_id, start): two hashes for each place that ``places_of`` makes of a text's hits."""

    def run(table: pa.Table):
        keys, ids, hit = table.column("doc").to_numpy(), table.column("doc_id"), table.column("at")
        for first, one, two, offsets in _batches(table, hash_words_twice):
            places = [places_of(hit[first + k], int(offsets[k + 1] - offsets[k])) for k in range(len(offsets) - 1)]
            rows, starts = np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places)
            for k in range(0, len(starts), AT_ONCE):
                row, start = rows[k : k + AT_ONCE], starts[k : k + AT_ONCE]
                columns = [x.view(np.int64) for x in hashes_of(one, two, offsets, row, start)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, [*columns, keys[first + row]]), ids.take(pa.array(first + row)).combine_chunks(), pa.array(start.astype(np.int32))],
                    ["w1", "w2", "doc", "doc_id", "start"],
                )

    near = docs.join(hits.hint("shuffle_hash"), "doc").select("doc", "doc_id", "text", "at")
    return map_texts(near, run, "w1 long, w2 long, doc long, doc_id long, start int")


def repeated_starts(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """Rows (doc, starts, hits): windows whose words also start in a document with a smaller id: their starts, and the
    blocks of which every window around them is one.

    ``docs`` has doc (key of the row), doc_id and text. A hit is first extended on both sides to all that a window
    around it can reach. Where all that hold a block agree on that whole context, the smallest of them decides for all of
    its windows at once; only around blocks whose contexts differ are windows compared one by one.
    """
    size = window // 2
    reach = window - size

    def contexts(one, two, offsets, row, start):
        begin = np.maximum(start - reach, 0)
        end = np.minimum(start + window, offsets[row + 1] - offsets[row])
        left = (start - begin).astype(np.uint64)
        return window_hashes(one, size)[start + offsets[row]], spans_hash(two, begin + offsets[row], end + offsets[row]) ^ mix64(left)

    def windows_at(at, n: int) -> np.ndarray:
        places = _all_places(at, n, size)
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(places - reach, 0), 1)
        np.add.at(mark, places + 1, -1)
        return np.flatnonzero(np.cumsum(mark[: n - window + 1]) > 0)

    def windows(one, two, offsets, row, start):
        at = start + offsets[row]
        return window_hashes(one, window)[at], window_hashes(two, window)[at]

    with Scratch(docs.sparkSession, scratch) as own:
        hits = repeat_hits(docs, window, own)
        found = own.write(_at_hits(docs, hits, lambda at, n: _all_places(at, n, size), contexts), "repeat-contexts")
        kinds = found.groupBy("w1").agg(F.min("w2").alias("c1"), F.max("w2").alias("c2"), F.min("doc_id").alias("least"))
        kinds = own.write(kinds, "block-kinds")
        judged = found.join(kinds, "w1")
        whole = judged.where("c1 = c2 and (doc_id > least or (doc_id is null and least is not null))")
        whole = whole.groupBy("doc").agg(F.collect_set("start").alias("hits"))
        mixed = own.write(judged.where("c1 != c2").groupBy("doc").agg(F.collect_set(F.col("start") % 65536).alias("at")), "mixed-hits")
        each = own.write(_at_hits(docs, mixed, windows_at, windows), "repeat-windows")
        least = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        least = own.write(least.where("least < most or nulls > 0").select("w1", "w2", "least"), "first-windows")
        later = each.join(least, ["w1", "w2"]).where("doc_id > least or (doc_id is null and least is not null)")
        alone = later.groupBy("doc").agg(F.collect_set("start").alias("starts"))
        return own.keep(whole.join(alone, "doc", "full"), "repeat-starts")


def remove_repeats(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed and kept, the words left joined by one space."""
    keyed = docs.select("doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("doc"))
    starts = repeated_starts(keyed, window, scratch)

    def run(table: pa.Table):
        counts, gone, kept = [], [], []
        for text, at, around in zip(*(table.column(c).to_pylist() for c in ("text", "starts", "hits")), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            counts.append(n)
            if at or around:
                mark = np.zeros(n + 1, np.int32)
                for places, before, after in ((at, 0, window), (around, window - window // 2, window)):
                    places = np.asarray(places or [], np.int64)
                    np.add.at(mark, np.maximum(places - before, 0), 1)
                    np.add.at(mark, np.minimum(places + after, n), -1)
                stay = np.cumsum(mark[:n]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            gone.append(n - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_texts(keyed.join(starts.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "starts", "hits"), run, "doc_id long, n_words long, n_removed long, kept string")


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same, by a dictionary of all windows; for tests."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, float] = {}
    order = lambda i: float("inf") if i is None else i
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, float("inf")), order(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 words and more, removed from every document but the first."""
    rows = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are known by MD5 here; words hold no space, so joining by one keeps them apart.
SQL = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select rid, doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) as h from (select rid, doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) as i from d)),
least as (select h, min(doc_id) as first from w group by h),
bad as (select rid, i from w join least using (h) where doc_id > first or (doc_id is null and first is not null)),
gone as (select distinct rid, unnest(generate_series(i, i + {WINDOW - 1})) as i from bad),
words as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
kept as (select rid, string_agg(word, ' ' order by i) as kept from words anti join gone using (rid, i) group by rid),
n as (select rid, count(*) as n_removed from gone group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join n using (rid) left join kept using (rid)
"""
