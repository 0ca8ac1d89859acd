"""Language identification with a string kernel.

Texts are compared by the blended spectrum of their 1- to 3-grams, as presence: k(x, y) = |grams in both| / sqrt(|x| |y|).
Grams are taken over the lower-case letters of any script, as code points; runs of other characters are one space.
``LANDMARKS`` texts a language give a Nyström map, on which one-versus-rest kernel ridge regression is fitted. A batch of
texts is scored by a matrix product of its gram presences with the map's weights.

The classifier is fitted on a bounded sample: of each language, the ``PER_LANGUAGE`` distinct labelled (id, text) pairs that
come first by a hash of both. The driver gets the distinct grams of their whole texts, ``PER_LANGUAGE`` rows a language, and
the broadcast model has one row of weights for each gram of the landmarks. Every text is then predicted, whole.

Defined results: a text that is null or has no letter gets ``und`` and score 0, and so does every text where there is
nothing to learn from. Rows are judged one by one, so repeated rows get equal results; lang, source and doc_id don't enter
a prediction. A null id counts as the empty text for the split, and is no hindrance to being drawn. Rows with one id and
different texts are different rows; repeats of a row are drawn once. Columns named lang_pred or score are replaced. An
empty table gives an empty result. A long text is worked on whole; it costs some 100 bytes of memory a character.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, map_texts, read_table

PER_LANGUAGE, LANDMARKS, RIDGE, SEED = 200, 40, 1e-2, 7
_SYMBOLS: list[np.ndarray] = []
_BITS = np.uint64(21)


def _symbols() -> np.ndarray:
    """For each code point: itself plus one if it is a letter, else one."""
    if not _SYMBOLS:
        letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8)
        _SYMBOLS.append(np.where(letters, np.arange(1, 0x110001), 1).astype(np.uint64))
    return _SYMBOLS[0]


def gram_ids(text: str | None) -> np.ndarray:
    """The distinct 1- to 3-grams of a whole text, in order, one number each; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[codes]
    if not (s > 1).any():
        return np.zeros(0, np.uint64)
    one = np.ones(1, np.uint64)
    s = np.concatenate([one, s, one])
    s = s[np.concatenate([[True], (s[1:] > 1) | (s[:-1] > 1)])]
    two = s[:-1] << _BITS | s[1:]
    return np.unique(np.concatenate([s, two, two[:-1] << _BITS | s[2:]]))


def presence(grams: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """0/1 rows of which grams of the vocabulary each text has."""
    out = np.zeros((len(grams), len(vocabulary)), np.float32)
    for i, own in enumerate(grams):
        at = np.searchsorted(vocabulary, own)
        at[at == len(vocabulary)] = 0
        out[i, at[vocabulary[at] == own]] = 1
    return out


def _kernel_rows(grams: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    return presence(grams, vocabulary) / np.sqrt(np.maximum([len(g) for g in grams], 1), dtype=np.float32)[:, None]


def fit(sample: list[tuple[str, np.ndarray]], ridge: float = RIDGE, landmarks: int = LANDMARKS):
    """(languages, grams, weights) from the language and the grams of each text of a sample."""
    languages = sorted({lang for lang, _ in sample})
    grams = [g for _, g in sample]
    chosen, seen = [], Counter()
    for k, (lang, _) in enumerate(sample):
        if seen[lang] < landmarks and len(grams[k]):
            seen[lang] += 1
            chosen.append(k)
    vocabulary = np.unique(np.concatenate([grams[k] for k in chosen]))
    marks = _kernel_rows([grams[k] for k in chosen], vocabulary)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    rows = [k for k in range(len(sample)) if len(grams[k])]
    features = np.concatenate([_kernel_rows([grams[k] for k in rows[i : i + 100]], vocabulary) @ marks.T for i in range(0, len(rows), 100)]) @ root
    targets = np.array([[1.0 if sample[k][0] == lang else -1.0 for lang in languages] for k in rows])
    solved = np.linalg.solve(features.T @ features + ridge * len(rows) / 100 * np.eye(len(chosen)), features.T @ targets)
    return languages, vocabulary, (marks.T @ (root @ solved)).astype(np.float32)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> list[tuple[str, np.ndarray]]:
    """Language and grams of at most ``per_language`` texts of each language of the rows given, in hash order.

    A threshold on the hash, from each language's approximate number of distinct pairs, leaves some four times as many
    rows; those are ranked.
    """
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "text", F.lit(seed))
    use = docs.where("lang is not null and text is not null").where(F.regexp_like("text", F.lit(r"\p{L}"))).select("lang", "text", draw.alias("draw"))
    rates = use.groupBy("lang").agg((F.lit(4.0 * per_language) / F.approx_count_distinct("draw", 0.02)).alias("rate"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 40)), "draw"))
    def run(table: pa.Table):
        grams = [gram_ids(t).view(np.int64) for t in table.column("text").to_pylist()]
        yield from table.drop_columns(["text"]).append_column("grams", pa.array(grams, pa.list_(pa.int64()))).to_batches()

    with Scratch(docs.sparkSession) as own:
        rates = own.write(rates, "language-rates")  # one row a language: written, so that Spark knows it can be broadcast
        near = use.join(rates, "lang").where(F.pmod("draw", F.lit(1 << 40)) < F.col("rate") * float(1 << 40))
        near = near.select("lang", "draw", "text").dropDuplicates(["lang", "draw"])
        picked = near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "rank", "text")
        rows = map_texts(picked, run, "lang string, rank int, grams array<long>", 100).collect()
    return [(r.lang, np.array(r.grams, np.uint64)) for r in sorted(rows, key=lambda r: (r["rank"], r.lang))]


def held_out():
    """True for the quarter of ids that nothing is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


_MODELS: dict[str, tuple] = {}


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row, in place of the text."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    docs = docs.drop(*({"lang_pred", "score"} - {text}))
    names = docs.columns

    def run(batch: pa.Table):
        texts = batch.column(names.index(text)).to_pylist()
        found, scores = ["und"] * len(texts), [0.0] * len(texts)
        if shared.value is not None:
            if name not in _MODELS:  # a worker reads a model once
                _MODELS.clear()
                _MODELS[name] = shared.value
            languages, vocabulary, weights = _MODELS[name]
            grams = [gram_ids(t) for t in texts]
            norms = np.array([len(g) for g in grams])
            margins = (presence(grams, vocabulary) @ weights) / np.sqrt(np.maximum(norms, 1))[:, None]
            best = margins.argmax(1)
            for i in np.flatnonzero(norms):
                found[i] = languages[best[i]]
                scores[i] = float(np.clip((1 + margins[i, best[i]]) / 2, 0, 1))
        yield from batch.remove_column(names.index(text)).append_column("lang_pred", pa.array(found)).append_column("score", pa.array(scores)).to_batches()

    return map_texts(docs, run, docs.drop(text).schema.add("lang_pred", "string").add("score", "double"), 100)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    sample = training_sample(docs.where(~held_out()))
    model = fit(sample) if sample else None
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


