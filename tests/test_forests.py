"""Trees grown from distinct vectors against plain growers on rows, and the sizes of the registered cross-validation."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from benchlens.operators import attribution, forests, models, trees
from benchlens.plans import registry

SF = "/root/testdata/sf0.001"
DEEP = models.Settings(trees=30, depth=None, random_trees=7)


@pytest.fixture(scope="module")
def data(spark):
    """300 rows of 60 vectors, dense and sparse."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 3))[rng.integers(0, 60, 300)].astype(float)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, 2.0, 0.0) + rng.normal(size=300)
    vector = lambda i, v: Vectors.dense(v) if i % 2 else Vectors.sparse(3, [(int(j), float(v[j])) for j in np.flatnonzero(v)])
    rows = [(i, vector(i, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, ["row_id", "features", "y"]).repartition(3).persist()


def predictions(fitted, df):
    return np.array([r.prediction for r in fitted(df).orderBy("row_id").collect()])


def plain_tree(x, y, w, threshold):
    """Predictions of a tree without a limit of depth on rows that count ``w`` times; ``threshold`` lists a node's cuts of a feature."""
    out, names, level = np.zeros(len(y)), 1, [(0, np.arange(len(y)))]
    while level:
        below = []
        for name, rows in level:
            own = rows[w[rows] > 0]
            mean = np.average(y[own], weights=w[own])
            out[rows], best = mean, None
            for f in range(x.shape[1]):
                for t in threshold(name, f, np.unique(x[own, f])):
                    left, right = own[x[own, f] <= t], own[x[own, f] > t]
                    gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, right))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, t)
            if best:
                below.append((names, rows[x[rows, best[1]] <= best[2]]))
                below.append((names + 1, rows[x[rows, best[1]] > best[2]]))
                names += 2
        level = below
    return out


def test_forest_is_plain_trees_on_bootstrap_samples(data):
    x, y, df = data
    fitted = models.random_forest(df, 5, DEEP)
    assert isinstance(fitted.model, forests.Forest) and fitted.model.trees.count() == 30
    hashes = np.array([r.h for r in df.select("row_id", F.xxhash64("row_id", F.lit(5)).alias("h")).orderBy("row_id").collect()])
    draws = forests.drawn(hashes, np.arange(30))
    assert abs(draws.mean() - 1) < 0.05 and abs(draws.var() - 1) < 0.05 and len({tuple(c) for c in draws.T}) == 30
    cuts = lambda name, f, kinds: (kinds[1:] + kinds[:-1]) / 2
    want = np.mean([plain_tree(x, y, w, cuts) for w in draws.T], axis=0)
    assert np.allclose(predictions(fitted, df), want)
    nodes = lambda model: [tuple(map(tuple, r[1:])) for r in model.trees.orderBy("tree").collect()]
    assert nodes(models.random_forest(df.repartition(7), 5, DEEP).model) == nodes(fitted.model)


def test_random_trees_are_plain_ones_to_the_last_vector(data):
    x, y, df = data
    fitted = models.extra_trees(df, 9, DEEP)

    def cuts(tree):
        uniform = lambda *key: int(md5("::".join(map(str, key)).encode()).hexdigest()[:13], 16) / (1 << 52)
        return lambda name, f, kinds: [kinds[0] + uniform(tree, name, f, 9) * (kinds[-1] - kinds[0])] if len(kinds) > 1 else []

    want = np.mean([plain_tree(x, y, np.ones(len(y)), cuts(t)) for t in range(7)], axis=0)
    got = predictions(fitted, df)
    assert np.allclose(got, want)
    means = {tuple(v): y[(x == v).all(axis=1)].mean() for v in x}  # every vector has a leaf of its own
    assert np.allclose(got, [means[tuple(v)] for v in x])


def test_forests_have_leaves_for_attributions(spark, data, tmp_path):
    *_, df = data
    rows = df.orderBy("row_id").limit(5)
    for fit in (models.random_forest, models.extra_trees):
        fitted = fit(df, 1, models.Settings(trees=3, depth=None, random_trees=3))
        assert np.allclose([r.prediction for r in fitted.model.ensemble().transform(df).orderBy("row_id").collect()], predictions(fitted, df))
        leaves = attribution.ensemble_leaves(spark, fitted.model, f"file://{tmp_path}/leaves")
        found, expected = attribution.explain(rows, leaves, [r.features for r in df.orderBy("row_id").limit(9).collect()])
        sums = {r.row_id: r.s for r in found.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
        assert np.allclose([sums.get(k, 0.0) + expected for k in range(5)], predictions(fitted, rows))


def test_more_vectors_than_a_task_holds(data, monkeypatch):
    *_, df = data
    small = models.Settings(trees=3, depth=None, random_trees=2, bins=16)
    here = predictions(models.extra_trees(df, 2, small), df)
    monkeypatch.setattr(forests, "MOST_CELLS", 10)
    assert type(models.random_forest(df, 2, small).model).__name__ == "RandomForestRegressionModel"
    there = models.extra_trees(df, 2, small)
    assert isinstance(there.model, trees.Ensemble) and np.allclose(predictions(there, df), here)  # both reach every vector


def test_vectors_alike_and_targets_alike(spark):
    rows = spark.createDataFrame([(i, Vectors.sparse(3, []), float(i % 2)) for i in range(50)], ["row_id", "features", "y"])
    flat = spark.createDataFrame([(i, Vectors.dense([float(i)]), 2.5) for i in range(50)], ["row_id", "features", "y"])
    for random in (False, True):
        got = forests.grow(rows, 0, 5, 1, random).transform(rows).select("prediction").distinct().collect()
        assert len(got) == 1 and 0.2 < got[0].prediction < 0.8
        assert [r.prediction for r in trees.boosted_trees(flat, 0, trees.Boosting(iterations=2)).transform(flat).select("prediction").distinct().collect()] == [2.5]
        assert [r.prediction for r in forests.grow(flat, 0, 5, 50, random).transform(flat).select("prediction").distinct().collect()] == [2.5]


@pytest.mark.parametrize("rounds", [3, 12])
def test_rounds_in_one_task_are_those_over_the_cluster(data, rounds):
    """Three rounds on all rows; on noise, as many until held-out rows gain no more."""
    *_, df = data
    noise, held = (df.withColumn("y", F.pmod(F.xxhash64("row_id"), F.lit(997)) / 997), F.col("row_id") % 3 == 0) if rounds > 3 else (df, None)
    fit = lambda cells: trees.boosted_trees(noise, 0, trees.Boosting(iterations=rounds, step=0.9, leaves=6, least=9, bins=4, patience=1, most_cells=cells, subtract_from=1 if rounds > 3 else 10**6), held)
    here, there = fit(1 << 22), fit(0)
    assert here.trees == there.trees and here.by_vector and not there.by_vector and len(here.trees) < 12
    assert np.allclose(predictions(here.transform, df), predictions(there.transform, df))


def test_cross_validation_does_the_whole_study(spark, monkeypatch):
    """Five folds; forests of 300 trees without a limit of depth; 300 rounds or those until no held-out row gains."""
    fitted: dict = {}

    def watched(name, fit):
        def run(train, seed, settings):
            out = fit(train, seed, settings)
            fitted.setdefault(name, []).append((out.model, settings))
            return out

        return run

    for name, fit in models.MODELS.items():
        monkeypatch.setitem(models.MODELS, name, watched(name, fit))
    got = registry.QUERIES["cross_validation"](spark, SF)
    sizes = {(r.model, r.fold): r["count"] for r in got.groupBy("model", "fold").count().collect()}
    assert {k for k in sizes} == {(m, f) for m in models.MODELS for f in range(5)} and len({sum(n for (m, _), n in sizes.items() if m == name) for name in models.MODELS}) == 1
    assert all(len(v) == 5 for v in fitted.values())
    assert all(m.trees.count() == m.n_trees == 300 for name in ("random_forest", "extra_trees") for m, _ in fitted[name])
    rounds = [len(m.trees) for m, _ in fitted["hist_gbrt"]]
    assert all(10 < n <= 300 for n in rounds)
    for _, s in fitted["hist_gbrt"]:
        assert (s.iterations, s.bins, s.leaves, s.step) == (300, 255, 31, 0.05)
