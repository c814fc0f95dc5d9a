"""Best-first boosting and extremely random trees against plain growers."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from benchlens.operators import attribution, models, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (240, 4)).astype(float)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, 2.0, 0.0) + rng.normal(size=240)
    vector = lambda i, v: Vectors.dense(v) if i % 2 else Vectors.sparse(4, [(int(j), float(v[j])) for j in np.flatnonzero(v)])
    rows = [(i, vector(i, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, ["row_id", "features", "y"]).repartition(3).persist()


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("row_id").collect()])


def best_split(x, g, rows, least):
    found = None
    for f in range(x.shape[1]):
        kinds = np.unique(x[:, f])
        for t in (kinds[1:] + kinds[:-1]) / 2:
            left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
            if min(len(left), len(right)) >= least:
                gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[rows].sum() ** 2 / len(rows)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
    return found


def plain_boosting(x, y, rounds, step, most, least):
    out = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, leaves = y - out, [np.arange(len(y))]
        while len(leaves) < most:
            able = [(s[0], k, s) for k, rows in enumerate(leaves) if (s := best_split(x, g, rows, least))]
            if not able:
                break
            _, k, (_, left, right) = max(able, key=lambda a: a[0])
            leaves[k : k + 1] = [left, right]
        for rows in leaves:
            out[rows] += step * g[rows].mean()
    return out


@pytest.mark.parametrize("subtract_from", [1, 10**6])
def test_boosting_is_plain_best_first_growth(data, subtract_from):
    x, y, df = data
    settings = trees.Boosting(iterations=2, step=0.4, leaves=7, least=12, subtract_from=subtract_from)
    model = trees.boosted_trees(df, 0, settings)
    assert np.allclose(predictions(model, df), plain_boosting(x, y, 2, 0.4, 7, 12), atol=1e-9)
    leaves = [c for t in model.trees for f, c in zip(t.feature, t.count, strict=True) if f < 0]
    assert min(leaves) >= 12 and all(sum(f < 0 for f in t.feature) <= 7 for t in model.trees)


def test_boosting_stops_early_and_ignores_the_partitioning(data):
    *_, df = data
    noise = df.withColumn("y", F.rand(3))
    held = F.col("row_id") % 3 == 0
    settings = trees.Boosting(iterations=12, step=0.9, leaves=12, least=5, bins=4, patience=1)
    noise = noise.select("*").persist()
    model = trees.boosted_trees(noise, 0, settings, held)
    assert len(model.trees) < 12
    again = trees.boosted_trees(noise.repartition(5), 0, settings, held)
    assert again.trees[0].feature == model.trees[0].feature and again.trees[0].threshold == model.trees[0].threshold
    noise.unpersist()


def test_cuts(spark):
    entries = spark.createDataFrame([(0, float(v)) for v in [1, 1, 2, 5]] + [(1, float(v)) for v in range(1, 101)], "feature int, v double")
    got = {r.feature: r.cuts for r in trees.cut_points(entries, 104, 4).collect()}
    assert got[0] == [0.5, 1.5, 3.5]  # zeros count, being left out
    assert len(got[1]) == 3 and got[1][1] == 48.5
    assert trees.cut_points(entries.limit(0), 5, 4).collect() == []


def test_random_trees_against_a_plain_grower(data):
    x, y, df = data
    model = trees.extremely_random_trees(df, 9, 3, 3)
    uniform = lambda *key: int(md5("::".join(map(str, key)).encode()).hexdigest()[:13], 16) / (1 << 52)
    out = np.zeros(len(y))
    for k, tree in enumerate(model.trees):
        where, stack = np.zeros(len(y), int), [(0, np.arange(len(y)), 0)]
        while stack:
            node, rows, depth = stack.pop()
            where[rows] = node
            assert tree.count[node] == len(rows) and np.isclose(tree.value[node], y[rows].mean())
            best = None
            for f in range(4) if depth < 3 else ():
                low, high = x[rows, f].min(), x[rows, f].max()
                if low < high:
                    t = low + uniform(k, node, f, 9) * (high - low)
                    left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[rows].sum() ** 2 / len(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, t, left, right)
            if best is None:
                assert tree.feature[node] < 0
                continue
            assert tree.feature[node] == best[1] and np.isclose(tree.threshold[node], best[2])
            stack += [(tree.left[node], best[3], depth + 1), (tree.right[node], best[4], depth + 1)]
        out += np.array([tree.value[n] for n in where]) / 3
    assert np.allclose(predictions(model, df), out)


def test_predicting_needs_no_python_worker_and_models_are_saved(spark, data, tmp_path):
    *_, df = data
    for name in ("extra_trees", "hist_gbrt"):
        fitted = models.MODELS[name](df, 1, models.Settings(random_trees=2, depth=2, iterations=2, leaves=4))
        plan = fitted(df)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        model = fitted.model
        model.save(spark, f"file://{tmp_path}/{name}")
        assert np.allclose(predictions(trees.Ensemble.load(spark, f"file://{tmp_path}/{name}"), df), predictions(model, df))
        leaves = attribution.ensemble_leaves(spark, model, f"file://{tmp_path}/again")
        rows = df.orderBy("row_id").limit(5)
        found, expected = attribution.explain(rows, leaves, [r.features for r in df.orderBy("row_id").limit(9).collect()])
        sums = {r.row_id: r.s for r in found.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
        assert np.allclose([sums.get(k, 0.0) + expected for k in range(5)], predictions(model, rows))


def test_constant_targets_and_rows_without_cells(spark):
    rows = spark.createDataFrame([(i, Vectors.sparse(3, []), 2.5) for i in range(50)], ["row_id", "features", "y"])
    for model in (trees.boosted_trees(rows, 0, trees.Boosting(iterations=2)), trees.extremely_random_trees(rows, 0, 2, 3)):
        assert np.allclose(predictions(model, rows), 2.5)
    with pytest.raises(ValueError, match="no training rows"):
        trees.boosted_trees(rows.limit(0), 0)
