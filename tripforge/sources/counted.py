"""Counters gathered by the job that writes a table, kept as JSON beside its files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .io import _fs, read_json, write_parquet

_NAME = "_counters-"


def write_counted(df: DataFrame, path: str, counters: dict[str, Column], mode: str = "error", files: int | None = None) -> bool:
    """``io.write_parquet`` with counters: aggregates over the rows as they are written, in the one job that writes them.

    The counters stand in the stage whose tasks write the files. Each of its tasks counts once, when it succeeds: one
    that is retried, run twice, or lost with its executor leaves nothing behind. Counters must be additive, as counts
    and sums are: an append adds its own document, and ``read_counters`` adds them up.
    """
    seen = Observation(f"written-{uuid.uuid4().hex}")
    rows = df.repartition(files) if files else df
    observed = rows.observe(seen, *[c.alias(n) for n, c in counters.items()])
    return write_parquet(observed, path, mode, beside=lambda: {f"{_NAME}{uuid.uuid4().hex}.json": {n: seen.get[n] for n in counters}})


def read_counters(spark: SparkSession, path: str) -> dict[str, int]:
    """Counters of all writes of a table, added up."""
    fs, root = _fs(spark, path)
    documents = [s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith(_NAME)]
    if not documents:
        raise FileNotFoundError(f"no counters beside {path}")
    total: dict[str, int] = {}
    for document in documents:
        for name, value in read_json(spark, document).items():
            total[name] = total.get(name, 0) + (value or 0)
    return total


def counter_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same as rows (name, value)."""
    return spark.createDataFrame(sorted(read_counters(spark, path).items()), "name string, value long")
