import numpy as np
import pytest
from pyspark.sql import functions as F

from tripforge.contracts import ContractError
from tripforge.operators import evaluate, forest
from tripforge.plans import catalogue

SF = "/root/testdata/sf0.001"
FEATURES = ["x", "z", "b", "one"]


def _rows(spark, n):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)) / 100_000
    rows = spark.range(0, n, 1, 1).select("id", (u(1) * 50).cast("int").cast("double").alias("x"), F.floor(u(2) * 5).alias("z"), F.floor(u(3) * 2).alias("b"), F.lit(3.0).alias("one"), u(4).alias("noise"))
    return rows.withColumn("y", F.sin(F.col("x") / 8) * 10 + F.when(F.col("b") == 1, F.col("z") * 3).otherwise(-F.col("z")) + F.col("noise"))


def _grown(bins, y, w, sizes, depth):
    """Predictions of one tree for all rows, by trying every cut of every feature at every node."""
    out = np.full(len(y), np.average(y, weights=w) if w.sum() else np.nan)
    if depth == 0 or not w.sum():
        return out
    best, where = np.sum(w * y) ** 2 / w.sum() + 1e-9, None
    for f, size in enumerate(sizes):
        for cut in range(size - 1):
            left = bins[f] <= cut
            n = w[left].sum(), w[~left].sum()
            if min(n) > 0:
                score = np.sum((w * y)[left]) ** 2 / n[0] + np.sum((w * y)[~left]) ** 2 / n[1]
                if score > best + 1e-9:
                    best, where = score, left
    if where is not None:
        for side in (where, ~where):
            out[side] = _grown(bins[:, side], y[side], w[side], sizes, depth - 1)
    return out


@pytest.mark.parametrize("memory", [forest.MEMORY, 1])
def test_forest_takes_the_best_cut_of_each_node(spark, monkeypatch, memory):
    monkeypatch.setattr(forest, "MEMORY", memory)  # 1: each tree has passes of its own
    rows, trees, depth, n = _rows(spark, 7000), 3, 4, 7000
    model = forest.fit_forest(rows, FEATURES, "y", trees, depth, seed=7)
    table = rows.orderBy("id").toPandas()
    bins, y = model.bins([table[c].to_numpy(float) for c in FEATURES]), table["y"].to_numpy() - model.centre
    sizes = [len(b) + 1 for b in model.bounds]
    assert 16 < sizes[0] <= 32 and sizes[1:] == [5, 2, 1]
    taken = np.hstack([forest.bootstrap(7, 0, trees, forest.BLOCK), forest.bootstrap(7, 1, trees, n - forest.BLOCK)])
    want = np.mean([_grown(bins, y, w.astype(float), sizes, depth) for w in taken], axis=0) + model.centre
    got = model.predict(rows).toPandas()
    key = lambda a, b: np.array(sorted(zip(np.round(a, 9), b)))
    assert np.allclose(key(table["y"], want), key(got["y"], got["prediction"]), atol=1e-7)


def test_forest_is_as_good_as_sparks(spark):
    rows = _rows(spark, 6000).withColumn("y", F.col("y") + F.col("noise") * 8).repartition(5, "id")
    train, test = rows.where("id % 4 > 0").cache(), rows.where("id % 4 = 0").cache()
    own = evaluate.binned_forest_utility(train, test, FEATURES, "y", trees=20, depth=6).first()
    theirs = evaluate.forest_utility(train, test, FEATURES, "y", trees=20, depth=6).first()
    assert theirs.r2 > 0.8 and abs(own.r2 - theirs.r2) < 0.01 and abs(own.mae / theirs.mae - 1) < 0.03


def test_bootstrap_counts_are_poisson_and_the_same_again():
    taken = forest.bootstrap(42, 3, 20, 100_000)
    assert (taken == forest.bootstrap(42, 3, 20, 100_000)).all() and (taken != forest.bootstrap(42, 4, 20, 100_000)).any()
    shares = np.bincount(taken.ravel(), minlength=12) / taken.size
    for k, p in enumerate(np.diff(forest._CDF, prepend=0)[:8]):
        assert abs(shares[k] - p) < 5 * (p / taken.size) ** 0.5
    assert abs(np.corrcoef(taken[0], taken[1])[0, 1]) < 0.02


def test_unknown_features_and_labels(spark):
    nan = float("nan")
    rows = [(float(i % 4), i % 4 * 2.0) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, 900.0), (nan, 900.0)], "x double, y double")
    model = forest.fit_forest(df, ["x"], "y", trees=5, depth=3)
    got = model.predict(df, "p").collect()
    assert len(got) == 40 and all(abs(r.p - r.y) < 1e-9 for r in got)
    with pytest.raises(ContractError):
        forest.fit_forest(spark.createDataFrame([(1.0, None)], "x double, y double"), ["x"], "y", trees=2, depth=2)
    with pytest.raises(ContractError):
        forest.fit_forest(df.limit(0), ["x"], "y", trees=2, depth=2)
    flat = spark.createDataFrame([(1.0, 0.1)] * 9, "x double, y double")
    assert {round(r.p, 9) for r in forest.fit_forest(flat, ["x"], "y", trees=3, depth=2).predict(flat, "p").collect()} == {0.1}


def test_utility_query_grows_all_trees_in_passes_over_blocks(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    grown, fit = [], forest.fit_forest
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda *_: pytest.fail("rows are held with 100 counts each"))
    monkeypatch.setattr(evaluate, "fit_forest", lambda *a, **k: grown.append(fit(*a, **k)) or grown[-1])
    row = catalogue.queries()["utility_rf"](spark, SF).first()
    assert row.label and abs(row.transfer_gap - (row.trtr_r2 - row.tstr_r2)) < 2e-4
    assert [m.values.shape for m in grown] == [(100, 1 << catalogue.UTILITY_DEPTH)] * 2
