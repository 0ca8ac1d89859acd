"""Shared pieces of the training-data operators: tables in the shared folder, row keys and hashes of words and word windows."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir  # noqa: F401

#: ASCII white space that separates words: space and the control characters 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null text gives null."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


# --- hashes of words and of word windows ----------------------------------------------------------

#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_FACTOR = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_lists(text: bytes):
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def _hashed(texts: list[bytes], digest, longs: int) -> tuple[np.ndarray, np.ndarray]:
    found, offsets, n = [], [0], 0
    for text in texts:
        for words in word_lists(text):
            found.append(b"".join(map(digest, words)))
            n += len(words)
        offsets.append(n)
    return np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, longs), np.array(offsets)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of several texts, and the offsets at which each text's words begin (one more at the end)."""
    hashes, offsets = _hashed(texts, xxhash.xxh64_digest, 1)
    return hashes[:, 0], offsets


def hash_words_twice(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with two 64-bit hashes of each word, the halves of one hash of 128 bits."""
    hashes, offsets = _hashed(texts, xxhash.xxh3_128_digest, 2)
    return np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1]), offsets


def _doubled(level: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of 2 x size words from those of size words."""
    return mix64(level[:-size] * _FACTOR + level[size:])


def spans_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches words[start:end], none empty, of word hashes.

    A stretch of 2**k words is hashed from its halves, any other from the two such stretches that cover it; each step
    mixes all bits, so no structure of the words makes stretches meet.
    """
    n = ends - starts
    out = np.zeros(len(starts), np.uint64)
    level, size = mix64(words), 1
    while True:
        some = np.flatnonzero((n >= size) & (n < 2 * size))
        out[some] = mix64(level[starts[some]] * _FACTOR + level[ends[some] - size] + n[some].astype(np.uint64))
        if not (n >= 2 * size).any():
            return out
        level, size = _doubled(level, size), 2 * size


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive word hashes (windows may cross texts; callers mask those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, half = mix64(words), 1
    while 2 * half <= size:
        level, half = _doubled(level, half), 2 * half
    return mix64(level[:n] * _FACTOR + level[size - half : size - half + n] + np.uint64(size))


def chunks_of(texts, budget: int = 2_000_000):
    """Cut an iterable of (index, bytes) into lists of about ``budget`` bytes; a single longer text stays whole."""
    part, size = [], 0
    for item in texts:
        if part and size + len(item[1]) > budget:
            yield part
            part, size = [], 0
        part.append(item)
        size += len(item[1])
    if part:
        yield part


def map_texts(df: DataFrame, function, schema: str, rows_per_batch: int = 500) -> DataFrame:
    """``mapInArrow`` over tables of at most ``rows_per_batch`` rows; Spark bounds the bytes of a batch."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                yield from function(pa.Table.from_batches([batch.slice(start, rows_per_batch)]))

    return df.mapInArrow(run, schema)


def text_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of (id, text): rows that share it are repeats of one document and get one result."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), F.coalesce(text, F.lit("")))
