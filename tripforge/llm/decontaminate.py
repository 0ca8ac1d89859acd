"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document leaks an item if one of its windows of as many words as the item has a word edit distance of at most
``MAX_EDITS`` = 0.2 times that number. Words are compared case-folded. Items without a word leak nowhere.

* Windows: a window within k edits holds, unmoved by more than k words, one of k + 1 equal pieces of the item, so only
  windows around such pieces can match; this loses none and leaves a small part of all windows.
* Embedding: the CGK random walk reads a window by random bits of (step, word) and maps edit distance to Hamming
  distance. Walks with several seeds are made for items and windows alike.
* LSH: of each walk, tables sample positions; equal samples make a window and an item candidates. ``WALKS`` x ``TABLES``
  samplings of ``SAMPLE`` positions reach the recall measured in the tests.
* Candidates are verified by their exact edit distance.
* The agreement of a match falls with its length, so items of over ``LONG`` words don't go through walks and tables: every
  window that such a piece allows is verified by a bit-parallel edit distance (Myers), and none is lost.

Items are the stated query set: they are read in blocks of at most ``BLOCK`` items and ``BLOCK_BYTES`` bytes (or one longer
item), each broadcast (a bounded size) and run against all documents, one scan of them a block. Documents are not shuffled;
each row is judged on its own, so hot keys and copies do no harm.

Defined results: null texts leak nothing; null ids are carried through; repeated rows give repeated results; items with
null text are ignored; empty tables give an empty result; other columns don't enter. Ties between windows go to the fewest
edits, then to the first. A long text is searched whole; its windows are embedded ``AT_ONCE`` at a time. Pieces and
windows are found by hashes of words, edits are counted on the words themselves.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks_of, hash_words, map_texts, mix64, read_table, window_hashes, word_lists

MAX_EDITS, WALKS, TABLES, SAMPLE, LONG = 0.2, 12, 10, 4, 60
BLOCK, BLOCK_BYTES, AT_ONCE = 20_000, 8_000_000, 2000
_END = np.uint64(0)


def edits_allowed(n: int, share: float = MAX_EDITS) -> int:
    return int(n * share + 1e-9)


def edit_distances(item: dict, n: int, words, anywhere: bool = False):
    """Edit distance of an item of n words to words[:j] for j = 1, 2, ...; with ``anywhere``, to the best stretch that ends there.

    ``item`` maps each of its words to the bits of the places where it stands.
    """
    every, top, first = (1 << n) - 1, 1 << (n - 1), 0 if anywhere else 1
    plus, minus, score = every, 0, n
    for word in words:
        same = item.get(word, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, low = minus | (every & ~(across | plus)), plus & across
        score += 1 if up & top else -1 if low & top else 0
        up, low = (up << 1 | first) & every, low << 1 & every
        plus, minus = low | (every & ~(down | up)), up & down
        yield score


def places_of(words: list) -> dict:
    """For each word, the bits of the places where it stands."""
    out: dict = {}
    for place, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << place
    return out


def edit_distance(a: list, b: list) -> int:
    """Word edit distance of two lists."""
    last = len(a)
    for last in edit_distances(places_of(a), len(a), b) if a else ():
        pass
    return last if a else len(b)


def cgk_walks(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CGK embeddings of the windows words[start:end], one for each walk: (walk, window, step), with 3 steps a word of the longest."""
    steps = 3 * int((ends - starts).max())
    salts = mix64(np.arange(1, WALKS * steps + 1, dtype=np.uint64)).reshape(steps, WALKS)
    padded = np.append(words, _END)
    place, stop = np.repeat(starts[None], WALKS, 0), np.repeat(ends[None], WALKS, 0)
    out = np.empty((WALKS, len(starts), steps), np.uint64)
    for step in range(steps):
        symbol = np.where(place < stop, padded[place], _END)
        out[:, :, step] = symbol
        place += (mix64(symbol ^ salts[step][:, None]) & np.uint64(1)).astype(np.int64)
        np.minimum(place, stop, out=place)
    return out


def _samples(size: int, walk: int) -> np.ndarray:
    """Positions that the tables of a walk look at; early ones, since later ones are mostly past the window's end."""
    return np.random.default_rng([size, walk]).integers(0, max(1, 2 * size), (TABLES, SAMPLE))


def lsh_keys(walks: np.ndarray, size: int) -> np.ndarray:
    """One key for each window (row) and each table of each walk (column)."""
    out = np.empty((walks.shape[1], WALKS * TABLES), np.uint64)
    for walk in range(WALKS):
        for t, at in enumerate(_samples(size, walk)):
            key = np.full(walks.shape[1], t + 1, np.uint64)
            for x in at:
                key = mix64(key ^ walks[walk, :, x])
            out[:, walk * TABLES + t] = key
    return out


def _steps_of(walks: np.ndarray, size: int) -> np.ndarray:
    return walks[:, :, : 3 * size]


def folded(text: str | None) -> bytes:
    """The case-folded text in UTF-8; a passage in capitals is still that passage, accents included."""
    return (text or "").casefold().encode("utf-8", "surrogatepass")


class ItemIndex:
    """A block of benchmark items: pieces, and LSH tables by item size."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = MAX_EDITS):
        hashes, offsets = hash_words([t for _, t in items])
        self.ids, self.words = [i for i, _ in items], [t.split() for _, t in items]
        self.share = share
        pieces: dict[int, list] = {}
        long: dict[int, list] = {}
        self.tables: dict[int, tuple] = {}
        by_size: dict[int, list[int]] = {}
        for k in range(len(items)):
            w = hashes[offsets[k] : offsets[k + 1]]
            if not len(w):
                continue
            allowed = edits_allowed(len(w), share)
            q = len(w) // (allowed + 1)
            h = window_hashes(w, q)
            if len(w) > LONG:
                long.setdefault(q, []).extend((int(h[p * q]), p * q, k) for p in range(allowed + 1))
                continue
            pieces.setdefault(q, []).extend((int(h[p * q]), p * q, len(w)) for p in range(allowed + 1))
            by_size.setdefault(len(w), []).append(k)
        self.long, self.pieces = self._by_hash(long), self._by_hash(pieces)
        self.masks: dict[int, dict] = {}
        for size, members in by_size.items():
            starts = np.array([offsets[k] for k in members])
            parts = [starts[k : k + AT_ONCE] for k in range(0, len(starts), AT_ONCE)]
            keys = np.concatenate([lsh_keys(cgk_walks(hashes, x, x + size), size) for x in parts])
            order = np.argsort(keys, 0, kind="stable")
            self.tables[size] = (np.take_along_axis(keys, order, 0), np.array(members)[order])

    @staticmethod
    def _by_hash(pieces: dict[int, list]) -> dict[int, tuple]:
        out = {}
        for q, rows in pieces.items():
            rows = sorted(set(rows))
            keys = np.array([r[0] for r in rows], np.uint64)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[keys & np.uint64((1 << 20) - 1)] = True
            out[q] = (bitmap, keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return out

    @staticmethod
    def _hits(pieces: dict[int, tuple], words: np.ndarray):
        """(starts, owners): where the owner of a piece that stands in the words would begin."""
        for q, (bitmap, keys, at, owners) in pieces.items():
            h = window_hashes(words, q)
            hit = np.flatnonzero(bitmap[h & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            n = hi - lo
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(hit, n) - at[rows], owners[rows], at[rows]

    def _mask(self, k: int) -> dict:
        if k not in self.masks:
            self.masks[k] = places_of(self.words[k])
        return self.masks[k]

    def _edits(self, k: int, words: list) -> int:
        """Edits between an item and as many words of a text."""
        if words == self.words[k]:
            return 0
        *_, d = edit_distances(self._mask(k), len(self.words[k]), words)
        return d

    def verified(self, hashes: np.ndarray, offsets: np.ndarray, words_of):
        """(text, item position, edits, start, size) of the best windows of long items; starts count from the text's first word."""
        found: dict[tuple[int, int], set] = {}
        for begins, owners, at in self._hits(self.long, hashes):
            texts = np.searchsorted(offsets, begins + at, "right") - 1
            for text, k, begin in zip(texts.tolist(), owners.tolist(), begins.tolist(), strict=True):
                found.setdefault((text, k), set()).add(begin - int(offsets[text]))
        for (text, k), begins in sorted(found.items()):
            words = words_of(text)
            n = len(self.words[k])
            most = edits_allowed(n, self.share)
            stretches: list[list[int]] = []
            for begin in sorted(begins):
                lo, hi = max(0, begin - most), min(len(words) - n, begin + most)
                if lo > hi:
                    continue
                if stretches and lo <= stretches[-1][1] + 1:
                    stretches[-1][1] = max(hi, stretches[-1][1])
                else:
                    stretches.append([lo, hi])
            best = (most + 1, 0)
            for lo, hi in stretches:
                near = words[lo : hi + n]
                for end, least in enumerate(edit_distances(self._mask(k), n, near, anywhere=True), 1):
                    if end >= n and least < best[0] and (d := self._edits(k, near[end - n : end])) < best[0]:
                        best = (d, lo + end - n)
            if best[0] <= most:
                yield text, k, best[0], best[1], n

    def windows(self, words: np.ndarray, offsets: np.ndarray):
        """(size, starts) of the windows that hold a piece where an item would have it."""
        found: dict[int, list] = {}
        for q, (bitmap, keys, at, sizes) in self.pieces.items():
            h = window_hashes(words, q)
            hit = np.flatnonzero(bitmap[h & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            for n in np.unique(hi - lo)[np.unique(hi - lo) > 0]:
                some = np.flatnonzero(hi - lo == n)
                rows = (lo[some][:, None] + np.arange(n)).ravel()
                places = np.repeat(hit[some], n)
                for size in np.unique(sizes[rows]):
                    mine = sizes[rows] == size
                    k = edits_allowed(int(size), self.share)
                    found.setdefault(int(size), []).append(((places[mine] - at[rows[mine]])[:, None] + np.arange(-k, k + 1)).ravel())
        for size, starts in found.items():
            s = np.unique(np.concatenate(starts))
            s = s[(s >= 0) & (s + size <= len(words))]
            text = np.searchsorted(offsets, s, "right")
            s = s[s + size <= offsets[text]] if len(s) else s
            if len(s):
                yield size, s

    def embedded(self, words: np.ndarray, offsets: np.ndarray):
        """(size, starts, walks) of all windows; those of several sizes walk together."""
        found = sorted(self.windows(words, offsets), key=lambda x: x[0])
        if not found:
            return
        starts = np.concatenate([s for _, s in found])
        sizes = np.concatenate([np.full(len(s), n) for n, s in found])
        for k in range(0, len(starts), AT_ONCE):
            some, lengths = starts[k : k + AT_ONCE], sizes[k : k + AT_ONCE]
            walks = cgk_walks(words, some, some + lengths)
            for size in np.unique(lengths):
                mine = lengths == size
                yield int(size), some[mine], _steps_of(walks[:, mine], int(size))

    def matches(self, texts: list[bytes]):
        """(text, item position, start, size, edits) of the verified candidates, the best for each text and item."""
        hashes, offsets = hash_words(texts)
        split: dict[int, list] = {}

        def words_of(text: int) -> list:
            if text not in split:
                split[text] = [w for part in word_lists(texts[text]) for w in part]
            return split[text]

        best: dict[tuple[int, int], tuple] = {}
        for size, starts, walks in self.embedded(hashes, offsets):
            pairs = []
            keys = lsh_keys(walks, size)
            have, members = self.tables[size]
            for t in range(WALKS * TABLES):
                lo, hi = np.searchsorted(have[:, t], keys[:, t], "left"), np.searchsorted(have[:, t], keys[:, t], "right")
                for w in np.flatnonzero(hi > lo):
                    pairs += [(int(w), int(m)) for m in members[lo[w] : hi[w], t]]
            allowed = edits_allowed(size, self.share)
            for w, m in sorted(set(pairs)):
                text = int(np.searchsorted(offsets, starts[w], "right")) - 1
                start = int(starts[w]) - int(offsets[text])
                known = best.get((text, m), (allowed + 1, 0, 0))
                if known[0] and (d := self._edits(m, words_of(text)[start : start + size])) < known[0]:
                    best[text, m] = (d, start, size)
        for text, m, d, start, size in self.verified(hashes, offsets, words_of):
            best[text, m] = (d, start, size)
        for (text, m), (d, start, size) in sorted(best.items()):
            yield text, m, start, size, d


_INDEXES: dict[str, ItemIndex] = {}


def _index(name: str, shared) -> ItemIndex:
    """The index of a block of items; a worker keeps the last one. ``name`` is the driver's own for the block."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = ItemIndex(shared.value)
    return _INDEXES[name]


def item_blocks(benchmark: DataFrame, block: int = BLOCK, most_bytes: int = BLOCK_BYTES):
    """The items in blocks of at most ``block`` items and ``most_bytes`` bytes; a longer item is a block of its own."""
    part, size = [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = folded(row.text)
        if part and (len(part) == block or size + len(text) > most_bytes):
            yield part
            part, size = [], 0
        part.append((row.item_id, text))
        size += len(text)
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, edits): each item a document leaks, at its best window."""
    schema = "doc_id long, item_id long, start_word int, n_words int, edits int"
    rows = docs.select("doc_id", F.col(text).alias("text"))
    spark = docs.sparkSession

    def against(items: list) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(table: pa.Table):
            index = _index(name, shared)
            ids = table.column("doc_id").to_pylist()
            texts = [(i, folded(t)) for i, t in enumerate(table.column("text").to_pylist())]
            out = []
            for part in chunks_of(texts):
                out += [(ids[part[text][0]], index.ids[m], start, size, d) for text, m, start, size, d in index.matches([t for _, t in part])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "start_word", "n_words", "edits"])

        return map_texts(rows, run, schema)

    parts = [against(items) for items in item_blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked benchmark item of every document."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
