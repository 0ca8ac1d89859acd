"""Random forests of bounded depth on large tables, grown level by level from sums of bins.

Spark's own forest keeps 100 bootstrap counts beside each row as an object, and adds each row to its node's statistics one feature at
a time, at a random place of the statistics of all nodes. Here features are binned once, one byte each, and packed in blocks of rows.
For each level one pass adds up weights and labels of all nodes' bins in each task, feature by feature, so that what is added to stays
small; the tasks' sums are shuffled by tree, added, and the best split of each node is taken. Only the smaller of two siblings is
counted, the other is what is left of the parent. The driver sees splits, never rows or sums of bins.

The forest is Spark's: up to ``BINS`` bins a feature, all features at each node, a Poisson(1) bootstrap a tree, the greatest fall of
variance, nodes of one row allowed, no least gain. Rows with a null or NaN feature are left out of the fit; a null label is an error.
Bounds of bins come from all rows: halfway between values where there are at most ``BINS`` of them, else quantiles.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from math import exp, factorial
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..sources.scratch import Scratch

#: Bins of a feature, and the accuracy of the quantiles between them: ranks are off by at most one in so many.
BINS, RANKS = 32, 1000
#: Rows of a block, rows that are counted at a time, and the most values of features that are counted together.
BLOCK, CHUNK, PACKED = 5000, 1 << 17, 64
#: Bytes of sums that a task holds; trees beyond that are grown in further passes.
MEMORY = 256 << 20
#: Depth of the trees at most: each level holds sums for all of its places.
DEEPEST = 14
#: Gain, as a share of what it is the difference of, that is rounding.
NOTHING = 1e-12
_CDF = np.cumsum([exp(-1) / factorial(k) for k in range(20)])
#: Poisson(1) counts of the 65,536 equal slices of [0, 1); ``MIXED`` where the count changes within the slice.
_LEAST, _MOST = np.searchsorted(_CDF, np.arange(65536) / 65536, side="right"), np.searchsorted(_CDF, np.arange(1, 65537) / 65536, side="left")
MIXED = 255
_COUNTS = np.where(_LEAST == _MOST, _LEAST, MIXED).astype(np.uint8)


def bootstrap(seed: int, block: int, trees: int, rows: int) -> np.ndarray:
    """How often each tree takes each row of a block: Poisson(1) numbers, the same whenever they are asked for."""
    rng = np.random.Generator(np.random.PCG64([seed, block]))
    draws = rng.integers(0, 65536, trees * rows, np.uint16)
    counts = _COUNTS.take(draws)
    mixed = np.flatnonzero(counts == MIXED)
    counts[mixed] = np.searchsorted(_CDF, (draws[mixed] + rng.random(len(mixed))) / 65536, side="right")
    return counts.reshape(trees, rows)


def known(features: list[str]):
    """Whether all features of a row are numbers."""
    return reduce(and_, [F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`") for c in features])


def bounds_of_bins(rows: DataFrame, features: list[str], label: str, bins: int = BINS) -> tuple[list[np.ndarray], float]:
    """For each feature the bounds between its bins, where a value at a bound lies below it, and the label's mean."""
    name = {c: f"c{k}" for k, c in enumerate(features)}
    y = F.col(f"`{label}`")
    about = rows.agg(F.avg(y).alias("mean"), F.count_if(y.isNull() | F.isnan(y)).alias("unknown"), *[F.approx_count_distinct(f"`{c}`").alias(n) for c, n in name.items()]).first()
    if about.unknown or about.mean is None:
        raise ContractError(f"{about.unknown} rows have no {label}" if about.unknown else "no rows to fit a forest on")
    few = {c for c, n in name.items() if about[n] <= 2 * bins}
    steps = [i / bins for i in range(1, bins)]
    found = rows.agg(*[(F.collect_set(f"`{c}`") if c in few else F.percentile_approx(f"`{c}`", steps, RANKS)).alias(n) for c, n in name.items()]).first()
    bounds = []
    for c, n in name.items():
        values = np.unique(np.array(found[n] or [], float))
        if c in few and len(values) > bins:
            values = np.unique(np.array(rows.agg(F.percentile_approx(f"`{c}`", steps, RANKS)).first()[0], float))
        elif c in few:
            values = values[:-1] + np.diff(values) / 2
        bounds.append(values)
    return bounds, about.mean


def packs(sizes: list[int], most: int = PACKED) -> list[list[int]]:
    """Features in groups whose numbers of bins multiply to at most ``most``, so that each group is counted at once."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fits = [g for g in groups if np.prod([sizes[k] for k in g]) * sizes[f] <= most]
        fits[0].append(f) if fits else groups.append([f])
    return groups


@dataclass
class Forest:
    """Trees whose nodes lie by level: node j of a level has the nodes 2 j and 2 j + 1 of the next below it.

    A row goes to the first where its feature's bin is at most ``cuts``. A node that is not split sends all rows there.
    """

    features: list[str]
    label: str
    bounds: list[np.ndarray]
    centre: float
    split_features: list[np.ndarray] = field(default_factory=list)  #: (trees, nodes) a level
    cuts: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray | None = None  #: (trees, leaves)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """(features, rows) numbers of bins."""
        return np.stack([np.searchsorted(b, c, side="left") for b, c in zip(self.bounds, columns)]).astype(np.uint8)

    def place(self, tree: int, flat: np.ndarray, size: int, rows: np.ndarray) -> np.ndarray:
        """The nodes of the last level to which rows come; ``flat`` has the bins of ``size`` rows, feature by feature."""
        node = np.zeros(len(rows), np.intp)
        for f, cut in zip(self.split_features, self.cuts):
            right = flat.take((f[tree].astype(np.intp) * size).take(node) + rows) > cut[tree].take(node)
            node *= 2
            node += right
        return node

    def predict(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Label and prediction of all rows whose features are known."""

        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(start, CHUNK)
                    bins, rows = self.bins([c.to_numpy(False) for c in part.columns[:-1]]).ravel(), np.arange(part.num_rows)
                    total = sum(self.values[t].take(self.place(t, bins, len(rows), rows)) for t in range(len(self.values)))
                    yield pa.RecordBatch.from_arrays([part.columns[-1], pa.array(total / len(self.values) + self.centre)], [self.label, prediction])

        return numbers(df, self.features, self.label).where(known(self.features)).mapInArrow(run, f"`{self.label}` double, `{prediction}` double")


def numbers(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in [*features, label]])


def _blocks(rows: DataFrame, forest: Forest) -> DataFrame:
    """Blocks of rows: their bins, feature by feature, and their labels less the mean."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                *columns, y = [c.to_numpy(False) for c in batch.slice(start, BLOCK).columns]
                yield pa.RecordBatch.from_pydict({"block": [block], "bins": [forest.bins(columns).tobytes()], "labels": [(y - forest.centre).tobytes()]})
                block += 1

    return rows.mapInArrow(run, "block long, bins binary, labels binary")


def _counted(batches, forest: Forest, groups: list[list[int]], trees: range, of: int, counted: np.ndarray | None, seed: int):
    """For each tree the weights and sums of labels in (nodes, bins of all features), over one task's blocks.

    At the root all rows count; below, those of the nodes that ``counted`` (trees, parents) names, by parent.
    """
    sizes = [len(b) + 1 for b in forest.bounds]
    spans = [int(np.prod([sizes[f] for f in g])) for g in groups]
    parents = 1 if counted is None else counted.shape[1]
    sums = {t: [np.zeros((2, parents * s)) for s in spans] for t in trees}

    def add(blocks):
        ys = [np.frombuffer(y) for _, _, y in blocks]
        bins = np.hstack([np.frombuffer(b, np.uint8).reshape(len(sizes), -1) for _, b, _ in blocks])
        taken = np.hstack([bootstrap(seed, block, of, len(y)) for (block, _, _), y in zip(blocks, ys)])
        y, flat, n = np.concatenate(ys), bins.ravel(), bins.shape[1]
        codes = [np.ravel_multi_index([bins[f] for f in g], [sizes[f] for f in g]).astype(np.uint8 if s <= 256 else np.uint32) for g, s in zip(groups, spans)]
        for t in trees:
            rows = np.flatnonzero(taken[t] != 0)
            parent = np.zeros(len(rows), np.intp)
            if counted is not None:
                node = forest.place(t, flat, n, rows)
                some = np.flatnonzero((node & 1) == counted[t].take(node >> 1))
                parent, rows = node.take(some) >> 1, rows.take(some)
            w = taken[t].take(rows).astype(float)
            wy = w * y.take(rows)
            for code, span, into in zip(codes, spans, sums[t]):
                at = parent * span
                at += code.take(rows)
                into[0] += np.bincount(at, w, into.shape[1])
                into[1] += np.bincount(at, wy, into.shape[1])

    blocks, held = [], 0
    for batch in batches:
        for block, b, y in zip(*[c.to_pylist() for c in batch.columns]):
            blocks.append((block, b, y))
            held += len(y) // 8
            if held >= CHUNK:
                add(blocks)
                blocks, held = [], 0
    if blocks:
        add(blocks)
    for t in trees:
        out: list = [None] * len(sizes)
        for g, into in zip(groups, sums.pop(t)):
            packed = into.reshape(2, parents, *[sizes[f] for f in g])
            for k, f in enumerate(g):
                out[f] = packed.sum(axis=tuple(j + 2 for j in range(len(g)) if j != k))
        yield pa.RecordBatch.from_pydict({"tree": [t], "whole": [False], "sums": [np.concatenate(out, axis=2).tobytes()]})


def _split(sums: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Of (2, nodes, bins of all features) each node's best feature and cut, and weight and mean label on both of its sides."""
    n, s = (x[:, : sizes[0]].sum(axis=1, keepdims=True) for x in sums)
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    best, nodes = np.full(len(n), -np.inf), np.arange(len(n))
    feature, cut = np.zeros(len(n), np.int16), np.full(len(n), 255, np.uint8)
    weights, means = np.hstack([n, np.zeros_like(n)]), np.hstack([mean, mean])
    start = 0
    for f, size in enumerate(sizes):
        left_n, left_s = (np.cumsum(x[:, start : start + size - 1], axis=1) for x in sums)
        start += size
        if size < 2:
            continue
        right_n, right_s = n - left_n, s - left_s
        both = (left_n > 0) & (right_n > 0)
        score = np.full(left_n.shape, -np.inf)
        np.divide(left_s**2, left_n, out=score, where=both)
        score += np.divide(right_s**2, right_n, out=np.zeros_like(score), where=both)
        at = score.argmax(axis=1)
        top = score[nodes, at]
        new = np.flatnonzero(top > best)
        best[new], feature[new], cut[new] = top[new], f, at[new]
        picked = [x[new, at[new]] for x in (left_n, right_n, left_s, right_s)]
        with np.errstate(divide="ignore", invalid="ignore"):
            weights[new], means[new] = np.stack(picked[:2], axis=1), np.stack([picked[2] / picked[0], picked[3] / picked[1]], axis=1)
    whole = (s * mean)[:, 0]
    with np.errstate(invalid="ignore"):
        leaf = ~(best - whole > NOTHING * best)
    feature[leaf], cut[leaf] = 0, 255
    weights[leaf], means[leaf] = np.hstack([n, np.zeros_like(n)])[leaf], mean[leaf]
    return feature, cut, weights, means


def _best(batches, sizes: list[int], counted: np.ndarray | None, last: bool):
    """Splits of all nodes of the trees that lie in one partition, from the tasks' sums and the parents' whole ones."""
    part: dict = defaultdict(int)
    whole: dict = {}
    for batch in batches:
        for t, is_whole, sums in zip(*[c.to_pylist() for c in batch.columns]):
            sums = np.frombuffer(sums).reshape(2, -1, sum(sizes))
            if is_whole:
                whole[t] = sums
            else:
                part[t] = part[t] + sums
    for t in list(part):
        sums = part.pop(t)
        if counted is not None:
            rest = whole.pop(t) - sums
            rest[1][rest[0] == 0] = 0  # rounding of empty bins would decide between equal cuts
            pair = np.stack([rest, sums], axis=2)
            side = counted[t].astype(np.intp)
            pair = pair[:, np.arange(len(side))[:, None], np.stack([1 - side, side], axis=1)]
            sums = pair.reshape(2, -1, sum(sizes))
        feature, cut, weights, means = _split(sums, sizes)
        yield pa.RecordBatch.from_pydict({"tree": [t], "whole": [True], "sums": [b"" if last else sums.tobytes()], "feature": [feature.tobytes()], "cut": [cut.tobytes()], "weights": [weights.tobytes()], "means": [means.tobytes()]})


def fit_forest(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42, bins: int = BINS, stored: bool = False) -> Forest:
    """A forest fitted on all rows of ``train`` whose features are known; they are written once unless they come from a ``stored`` table."""
    if depth > DEEPEST or bins > 256:
        raise ContractError(f"forests here are at most {DEEPEST} levels deep and have at most 256 bins a feature")
    spark = train.sparkSession
    with Scratch(spark) as own:
        rows = numbers(train, features, label).where(known(features))
        rows = rows if stored else own.write(rows, "training-rows")
        forest = Forest(features, label, *bounds_of_bins(rows, features, label, bins))
        sizes = [len(b) + 1 for b in forest.bounds]
        groups, cores = packs(sizes), spark.sparkContext.defaultParallelism
        blocks = own.hold(own.write(_blocks(rows, forest), "blocks").repartition(cores))
        counted = whole = None
        for level in range(depth):
            last, parents = level == depth - 1, 1 << max(level - 1, 0)
            size = 16 * parents * sum(int(np.prod([sizes[f] for f in g])) for g in groups)
            step = max(1, MEMORY // size)
            sums = []
            for first in range(0, trees, step):
                some = range(first, min(first + step, trees))
                sums.append(blocks.mapInArrow(lambda b, some=some, c=counted: _counted(b, forest, groups, some, trees, c, seed), "tree long, whole boolean, sums binary"))
            if whole is not None:
                sums.append(whole)
            added = reduce(DataFrame.unionByName, sums).repartition(min(trees, cores), "tree")
            done = own.write(added.mapInArrow(lambda b, c=counted, last=last: _best(b, sizes, c, last), "tree long, whole boolean, sums binary, feature binary, cut binary, weights binary, means binary"), f"level-{level}")
            whole = done.select("tree", "whole", "sums")
            found = done.drop("whole", "sums").orderBy("tree").collect()  # splits: some bytes a node
            forest.split_features.append(np.stack([np.frombuffer(r.feature, np.int16) for r in found]))
            forest.cuts.append(np.stack([np.frombuffer(r.cut, np.uint8) for r in found]))
            weights = np.stack([np.frombuffer(r.weights).reshape(-1, 2) for r in found])
            counted = weights[:, :, 1] <= weights[:, :, 0]
            forest.values = np.stack([np.frombuffer(r.means) for r in found])
    return forest
