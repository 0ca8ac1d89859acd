"""Embedding whitening from an exact scatter in residue numbers.

Vectors are put on a grid of integers, and each distinct one counts once in the fit. A first pass gives their number n, and the sum
S and the extremes of each dimension. A second pass centres in integers, y = n x - S, and multiplies: each task adds up products
of y, modulo several primes under 2 ** 20, by float matrix products of ``ROWS`` vectors at a time, which are exact, since
residues lie within 2 ** 19 of zero and 2 ** 15 products of them add up to less than 2 ** 53. Only the residues' sums are
shuffled, one number for each prime and pair of dimensions. There are as many primes as the extremes ask for, so Chinese
remaindering gives the scatter exactly, however far the mean lies from zero; rounding begins when it is divided by n cubed for
the covariance, whose eigenvectors are those of a double eigh on the driver (a matrix of dimensions by dimensions).

The distinct vectors are a table; no task, and not the driver, holds more than a block of rows and a matrix for each prime.

Defined results: rows whose vector is null or holds null, NaN or an infinity are dropped. Vectors of each length are whitened
among themselves; those of length zero have no components. A component without variance has ``whitened`` and ``explained``
zero and doesn't count for the identity. Grid values beyond a long are the nearest long. A ``deviation`` beyond a long is null.
Repeated rows each keep their row, null ids too; an empty table gives an empty result; other columns of the input stay but for
those named as an output column. Of components with equal variance any may come first; signs make the largest entry positive.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import Scratch, read_table

SCALE, COMPONENTS = 256, 4
#: Vectors in one float matrix product, and the bound below which its primes lie.
ROWS, PRIME_BELOW = 1 << 15, 1 << 20
#: Variance, as a share of the trace, under which a component has none.
NOTHING = 1e-13


@dataclass
class Fit:
    """What is known of the distinct vectors of one length."""

    n: int
    sums: list[int]
    most: int = 0  #: no entry of x is beyond it
    reach: int = 0  #: nor one of n x - S beyond this
    axes: np.ndarray | None = None  #: one component a column
    variances: np.ndarray | None = None
    explained: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in 64-bit integers where squares of all entries add up to one, in Python's otherwise."""
        if self.n * self.most < 1 << 62 and self.reach**2 * len(self.sums) < 1 << 63:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)


def on_grid(embeddings: DataFrame, vector: str = "embedding", into: str = "x") -> DataFrame:
    """Rows with a whole vector, its entries times ``SCALE`` and rounded down as array<long>."""
    entries = F.col(vector)
    rows = embeddings.where(F.forall(entries, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf"))) & (F.size(entries) > 0))
    return rows.withColumn(into, F.transform(entries, lambda e: F.floor(e.cast("double") * SCALE)))


def _matrices(table: pa.Table, column: str = "x"):
    """The vectors of a table by length: (length, rows, matrix)."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, values[(offsets[rows] - offsets[0])[:, None] + np.arange(size)]


def _sums(distinct: DataFrame) -> dict[int, Fit]:
    """Number, sums and reach of the vectors, by length."""

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for size, _, x in _matrices(pa.Table.from_batches([batch])):
                new = [len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                old = parts.get(size)
                parts[size] = [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])] if old else new
        for size, (n, *columns) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)), *map(pa.array, columns)], ["size", "i", "n", "high", "low", "least", "most"])

    parts = distinct.select("x").mapInArrow(run, "size long, i long, n long, high long, low long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found: dict[int, Fit] = {}
    totals = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), (wide("high") * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(38,0)").alias("high"), wide("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
    for r in totals.orderBy("size", "i").collect():  # one row a dimension
        fit = found.setdefault(r.size, Fit(r.n, []))
        total = int(r.high) + int(r.low)
        fit.sums.append(total)
        fit.most = max(fit.most, abs(r.least), abs(r.most))
        fit.reach = max(fit.reach, abs(r.n * r.most - total), abs(r.n * r.least - total))
    return found


def primes_for(bound: int) -> list[int]:
    """Primes, one at least, whose product is over twice a bound, the largest first."""
    out: list[int] = []
    at = PRIME_BELOW
    while not out or prod(out) <= 2 * bound:
        at -= 1
        if all(at % k for k in range(2, int(at**0.5) + 1)):
            out.append(at)
    return out


def residue_products(y: np.ndarray, p: int) -> np.ndarray:
    """Sums over the rows of products of two columns, modulo a prime."""
    total = np.zeros((y.shape[1],) * 2, np.int64)
    for at in range(0, len(y), ROWS):
        r = y[at : at + ROWS] % p
        r = (r - p * (r > p // 2)).astype(np.float64)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def remainder_to_number(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Integers of least size with the residues, by Chinese remaindering."""
    whole, total = prod(primes), 0
    for r, p in zip(residues, primes, strict=True):
        total = total + r.astype(object) * (whole // p * pow(whole // p, -1, p))
    total = total % whole
    return np.where(total > whole // 2, total - whole, total)


def _scatter(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Exact sums of products of the centred vectors, by length."""
    primes = {size: primes_for(fit.n * fit.reach**2) for size, fit in fits.items()}
    light = {size: (fit.n, fit.sums) for size, fit in fits.items()}

    def run(batches):
        parts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, _, x in _matrices(pa.Table.from_batches([batch])):
                n, sums = light[size]
                for p in primes[size]:
                    y = (x % p) * (n % p) - np.array([s % p for s in sums], np.int64)
                    made = residue_products(y, p)
                    parts[size, p] = (parts[size, p] + made) % p if (size, p) in parts else made
        for (size, p), total in parts.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size)), pa.array(np.full(len(i), p)), pa.array(i), pa.array(j), pa.array(total[i, j])], ["size", "p", "i", "j", "total"])

    tasks = 2 * distinct.sparkSession.sparkContext.defaultParallelism
    parts = distinct.select("x").coalesce(tasks).mapInArrow(run, "size long, p long, i long, j long, total long")
    sums = parts.groupBy("size", "p", "i", "j").agg(F.sum("total").alias("total")).toArrow()
    columns = {c: sums.column(c).to_numpy() for c in sums.column_names}
    out = {}
    for size in fits:
        residues = []
        for p in primes[size]:
            mine = (columns["size"] == size) & (columns["p"] == p)
            r = np.zeros((size, size), np.int64)
            r[columns["i"][mine], columns["j"][mine]] = columns["total"][mine] % p
            residues.append(np.triu(r) + np.triu(r, 1).T)
        out[size] = remainder_to_number(residues, primes[size])
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Whitening of the distinct grid vectors ``x``, by length. The table is read twice."""
    fits = _sums(distinct)
    if not fits:
        return fits
    for size, scatter in _scatter(distinct, fits).items():
        f = fits[size]
        cube = f.n**3
        values, axes = np.linalg.eigh(np.array([[v / cube for v in row] for row in scatter.tolist()], np.float64))
        order = np.argsort(-values, kind="stable")[: min(components, size)]
        axes = axes[:, order]
        f.axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        trace = sum(scatter[k, k] for k in range(size)) / cube
        some = values[order] > NOTHING * trace
        f.variances = np.where(some, values[order], 0.0)
        f.explained = f.variances / trace if trace else np.zeros(len(order))
    return fits


def whiten(rows: DataFrame, fits: dict[int, Fit], x: str = "x") -> DataFrame:
    """Replace the grid vector by n, ``deviation``, ``whitened`` and ``explained``, the last two arrays of a double for each component."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    out_columns = ["n", "deviation", "whitened", "explained"]
    rest = rows.select(*[c for c in rows.columns if c not in out_columns])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for size, places, vectors in _matrices(table, x):
                f = shared.value[size]
                y = f.centred(vectors)
                squares = [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]
                scale = np.where(f.variances > 0, 1 / np.sqrt(np.where(f.variances > 0, f.variances, 1)), 0)
                made = (y / f.n).astype(np.float64) @ (f.axes * scale)
                k = made.shape[1]
                offsets = pa.array(np.arange(len(made) + 1) * k, pa.int32())
                mine = table.take(pa.array(places)).drop_columns([x])
                for name, column in zip(out_columns, (
                    pa.array(np.full(len(made), f.n)), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(made.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.tile(f.explained, len(made)))),
                ), strict=True):
                    mine = mine.append_column(name, column)
                yield from mine.combine_chunks().to_batches()

    schema = rest.drop(x).schema.add("n", "long").add("deviation", "long").add("whitened", ArrayType(DoubleType())).add("explained", ArrayType(DoubleType()))
    return rest.mapInArrow(run, schema)


def identity_errors(distinct: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS) -> dict[int, float]:
    """By length, the largest entry of the whitened fit list's covariance less the identity, measured over the table."""
    rows = whiten(distinct.select("x", F.size("x").cast("long").alias("size")), fits)
    w = [F.get("whitened", F.lit(k)) for k in range(components)]
    entries = [F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i in range(components) for j in range(i, components)]
    errors = {}
    for r in rows.groupBy("size").agg(*entries).collect():  # one row a length
        known = [k for k, v in enumerate(fits[r.size].variances) if v > 0]
        errors[r.size] = max((r[f"c{i}_{j}"] for i in known for j in known if i <= j), default=0.0)
    return errors


def whitened_components(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The input's other columns and ``component``, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    rows = on_grid(embeddings, vector)
    with Scratch(embeddings.sparkSession) as own:
        distinct = own.write(rows.select("x").distinct(), "distinct-vectors")
        fits = fit(distinct, components)
        errors = identity_errors(distinct, fits, components)
    error = F.lit(None).cast("double")
    for size, value in errors.items():
        error = F.when(F.size("x") == size, value).otherwise(error)
    made = whiten(rows.drop(vector, "identity_error").withColumn("identity_error", error), fits)
    kept = [c for c in made.columns if c not in ("n", "deviation", "whitened", "explained", "identity_error", "component")]
    both = made.select(*kept, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "entry"))
    return both.select(*kept, (F.col("component") + 1).alias("component"), "n", "deviation", F.col("entry.whitened").alias("whitened"), F.col("entry.explained").alias("explained"), "identity_error")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every whole vector."""
    return whitened_components(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
