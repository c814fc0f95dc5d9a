"""Models, attributions and whole runs."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from benchlens.operators import attribution as A
from benchlens.operators import explain, folds, models
from benchlens.plans import inputs, pipeline
from benchlens.sources import results

SMALL = models.Settings(trees=3, depth=3, iterations=3, random_trees=3, bins=16)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4))
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, 2.0, 0.0)
    rows = [(i, Vectors.dense(v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, ["row_id", "features", "y", "fold"]).persist()


def test_ridge_is_the_closed_form(data):
    x, y, df = data
    fitted = models.ridge(df, 0, SMALL).model
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-8)


def test_cross_validation(data):
    *_, df = data
    got = models.cross_validate(df, None, "row_kfold", 1, SMALL)
    assert got.count() == 150 * len(models.MODELS)
    assert got.where("y_pred is null").isEmpty()
    with pytest.raises(ValueError):
        models.cross_validate(df, ["unknown"])


def test_permutation_importance_is_a_full_shuffle(spark):
    """On few rows it equals a plain shuffle of all values, in the two orders of the hashes."""
    from hashlib import md5

    x = {f: {i: float((i * k) % 11) for i in range(12)} for f, k in (("a", 3), ("b", 5))}
    weight, repeats = {"a": 2.0, "b": -1.0}, 8
    long = spark.createDataFrame([(i, f, v) for f, own in x.items() for i, v in own.items()], "row_id long, feature string, value double")
    truth = spark.createDataFrame([(i, sum(weight[f] * x[f][i] for f in x)) for i in range(12)], "row_id long, y double")
    got = {r.feature: r.importance_mean for r in explain.permutation_importance(long, spark.createDataFrame(list(weight.items()), "feature string, weight double"), 0.0, truth, repeats, 7).collect()}
    for f, own in x.items():
        order = lambda r, role: sorted(own, key=lambda i: md5(f"{i}::{f}::{r}::7::{role}".encode()).hexdigest())  # noqa: E731, B023
        moved = [[(own[t] - own[s]) ** 2 for t, s in zip(order(r, "to"), order(r, "from"), strict=True)] for r in range(repeats)]
        assert np.isclose(got[f], weight[f] ** 2 * np.mean(moved))
        assert 0.7 < got[f] / (weight[f] ** 2 * 2 * np.var(list(own.values()))) < 1.4  # what a shuffle gives on average


def test_permutation_importance_of_a_model(spark, data):
    """The general form equals the linear one for a linear model."""
    *_, df = data
    fitted = models.ridge(df, 0, SMALL)
    got = {r.feature: (r.importance_mean, r.importance_std) for r in explain.permutation_importance_of(fitted, df, [0, 1, 2, 3], 3).collect()}
    long = df.select("row_id", F.posexplode(vector_to_array("features")).alias("feature", "value"))
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(fitted.model.coefficients.toArray())], "feature int, weight double")
    want = explain.permutation_importance(long, weights, fitted.model.intercept, df.select("row_id", "y"), 3)
    for r in want.collect():
        assert np.allclose(got[r.feature], (r.importance_mean, r.importance_std))
    assert got[2][0] > max(got[0][0], got[1][0], got[3][0])


def brute_shapley(f, x, background):
    p = len(x)
    value = lambda s: np.mean([f(np.where([i in s for i in range(p)], x, b)) for b in background])
    out = np.zeros(p)
    for i in range(p):
        for k in range(p):
            for s in combinations([j for j in range(p) if j != i], k):
                out[i] += factorial(k) * factorial(p - k - 1) / factorial(p) * (value({*s, i}) - value(set(s)))
    return out


@pytest.mark.parametrize("kind", [RandomForestRegressor, GBTRegressor])
def test_attributions_against_subsets(spark, data, tmp_path, kind):
    x, _, df = data
    model = (kind(labelCol="y", maxDepth=3, seed=1, numTrees=3) if kind is RandomForestRegressor else kind(labelCol="y", maxDepth=3, seed=1, maxIter=3)).fit(df)
    leaves = A.ensemble_leaves(spark, model, f"file://{tmp_path}/m")
    predicted = [model.predict(Vectors.dense(v)) for v in x[:20]]
    assert np.allclose(leaves.predict(x[:20]), predicted)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(3)], "row_id long, x array<double>")
    found, expected = A.explain(rows, leaves, x[100:110])
    got = np.zeros((3, 4))
    for r in found.collect():
        got[r.row_id, r.feature_id] = r.shap
    for i in range(3):
        want = brute_shapley(lambda v: leaves.predict(v[None, :])[0], x[i], x[100:110])
        assert np.allclose(got[i], want, atol=1e-10)
        assert np.isclose(got[i].sum() + expected, predicted[i])
    pairs = np.zeros((3, 4, 4))
    for r in A.explain_interactions(rows, leaves, 4).collect():
        pairs[r.row_id, r.feature_i, r.feature_j] = r.value
    for i in range(3):
        assert np.allclose(pairs[i], brute_interactions(leaves, x[i]), atol=1e-10)


def brute_interactions(leaves, x):
    """Subset enumeration of the path-dependent game: absent features weigh by coverage."""
    p = len(x)

    def value(s):
        inside = leaves.inside(x[None, :])[0]
        z = np.where(leaves.feature < 0, 1.0, np.where(np.isin(leaves.feature, list(s)), inside, leaves.ratio))
        return (z.prod(1) * leaves.value).sum()

    out = np.zeros((p, p))
    for i in range(p):
        single = 0.0
        for k in range(p):
            for s in combinations([j for j in range(p) if j != i], k):
                single += factorial(k) * factorial(p - k - 1) / factorial(p) * (value({*s, i}) - value(set(s)))
        for j in range(p):
            if i != j:
                for k in range(p - 1):
                    for s in combinations([h for h in range(p) if h not in (i, j)], k):
                        s = set(s)
                        out[i, j] += factorial(k) * factorial(p - k - 2) / (2 * factorial(p - 1)) * (value(s | {i, j}) - value(s | {i}) - value(s | {j}) + value(s))
        out[i, i] = single - out[i].sum()
    return out


def test_whole_runs(spark, tmp_path):
    sf, root = "/root/testdata/sf0.001", f"file://{tmp_path}/results"
    evals = inputs.evaluations(spark, sf)
    base = {"models": ("ridge", "random_forest"), "prefixes": ("Brand#1.", "small "), "settings": SMALL, "cv_folds": 3, "max_features": 30, "compute_shap": True, "shap_background": 10, "shap_eval": 5, "compute_interactions": True, "interaction_eval": 3}
    grid = [pipeline.Config("tfidf_meta", **base), pipeline.Config("meta_only", text_mode="none", run_row_kfold=False, **{**base, "compute_shap": False, "compute_interactions": False})]
    out = pipeline.run_grid(spark, evals, inputs.tasks(spark, sf), inputs.flows(spark, sf), grid, root)
    tables = out["mean", "tfidf_meta"]
    assert {"cv_results", "summary", "wilcoxon_mse", "global_shap", "local_shap_metrics", "global_shap_topk", "global_shap_stability", "interaction_metrics", "shap_summary_metrics"} <= set(tables)
    assert tables["cv_results"].count() == 2 * 2 * 3
    assert tables["local_shap_metrics"].where("readability between 0 and 1 and sparsity >= 0").count() == tables["local_shap_metrics"].count() == 2 * 2 * 3 * 5
    assert {r.name for r in results.discover_runs(spark, f"{root}/metadata").collect()} == {"tfidf_meta", "meta_only"}
    supervised, long = results.read_artifacts(spark, root, "tfidf_meta")
    assert long.select("row_id").distinct().count() == supervised.count()
    both = pipeline.consolidate(spark, root, "mean")
    assert {r.experiment for r in both["predictive_anchor"].collect()} == {"tfidf_meta", "meta_only"}
    assert both["shap_summary"].count() == both["local_summary"].count() == 2
    told = tables["explained_rows"].join(tables["local_shap"].groupBy("split_mode", "model", "fold", "row_id").agg(F.sum("shap").alias("s")), ["split_mode", "model", "fold", "row_id"], "left")
    assert told.count() == 2 * 2 * 3 * 5 and told.where(F.abs(F.coalesce("s", F.lit(0.0)) + F.col("expected_value") - F.col("y_pred")) > 1e-8).isEmpty()


def test_compute_once_and_csv(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for payload in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert results.materialize(spark, make, f"file://{tmp_path}/cache", "t", payload).count() == 3
    assert len(calls) == 2
    run = tmp_path / "runs" / "one"
    run.mkdir(parents=True)
    for n in ("global_shap_row_kfold_ridge", "global_shap_topk_row_kfold_ridge"):
        (run / f"{n}.csv").write_text("feature,mean_abs_shap\nmeta::a,1.5\n")
    got = results.read_labelled_csv(spark, f"file://{tmp_path}/runs", "feature string, mean_abs_shap double").collect()
    assert [tuple(r) for r in got] == [("one", "row_kfold", "ridge", "meta::a", 1.5)]
    with pytest.raises(ValueError):
        results.write_result(spark.range(1), str(tmp_path), "other", "r")


def test_repeated_validation(spark, data):
    *_, df = data
    rows = df.drop("fold").withColumn("g", F.col("row_id") % 10)
    got = pipeline.repeated_validation(rows, "g", ["ridge"], repeats=2, k=2, settings=SMALL)
    assert got.groupBy("rep", "row_id").count().where("count <> 1").isEmpty() and got.count() == 300
    assert explain.TOP_K == 10


def test_features_fitted_on_training_rows(spark, tmp_path):
    """With ``fit_scope`` fold, no fold's features know its test rows; a table of attributions is kept."""
    sf, root = "/root/testdata/sf0.001", f"file://{tmp_path}/results"
    config = pipeline.Config("scoped", text_mode="none", fit_scope="fold", models=("ridge",), prefixes=("Brand#1.", "small "), settings=SMALL, cv_folds=2, run_row_kfold=False, compute_shap=True, shap_background=5, shap_eval=4)
    out = pipeline.run(spark, inputs.evaluations(spark, sf), inputs.tasks(spark, sf), inputs.flows(spark, sf), config, root)
    long, supervised = out["features"], out["supervised"]
    fold_of = {r.row_id: r.fold for r in folds.with_group_folds(supervised, "task_id", 2).collect()}
    column = "NumberOfInstances"
    values = {r.row_id: r[column] for r in supervised.collect()}
    for fold in (0, 1):
        train = np.array([v for k, v in values.items() if fold_of[k] != fold], float)
        median = np.nanmedian(train)
        std = np.std(np.where(np.isnan(train), median, train))
        for r in long.where(f"fold = {fold} and feature = 'meta::{column}'").collect():
            own = values[r.row_id] if values[r.row_id] is not None else median
            assert np.isclose(r.value, own / (std or 1.0))
    assert out["predictions"].count() == supervised.count()
    assert out["local_shap"].select("feature_id", "feature").distinct().groupBy("feature").count().where("count > 1").isEmpty()


def test_shared_text_weights_are_made_once(spark, tmp_path, monkeypatch):
    sf, root = "/root/testdata/sf0.001", f"file://{tmp_path}/results"
    calls, real = [], pipeline.features.tfidf
    monkeypatch.setattr(pipeline.features, "tfidf", lambda *a, **k: calls.append(1) or real(*a, **k))
    base = {"models": ("ridge",), "prefixes": ("Brand#1.", "small "), "settings": SMALL, "cv_folds": 2, "max_features": 20, "run_row_kfold": False}
    grid = [pipeline.Config("a", **base), pipeline.Config("b", use_task_metafeatures=False, **base)]
    pipeline.run_grid(spark, inputs.evaluations(spark, sf), inputs.tasks(spark, sf), inputs.flows(spark, sf), grid, root)
    assert len(calls) == 1


def test_leaves_in_parts(spark, data, monkeypatch, tmp_path):
    """An ensemble that is broadcast in parts, and compared in small blocks, gives the same attributions."""
    x, _, df = data
    model = RandomForestRegressor(labelCol="y", maxDepth=3, seed=1, numTrees=3).fit(df)
    leaves = A.ensemble_leaves(spark, model, f"file://{tmp_path}/m")
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(3)], "row_id long, x array<double>")
    read = lambda f: {(r.row_id, r.feature_id): r.shap for r in f.collect()}
    whole = read(A.explain(rows, leaves, x[100:110])[0])
    pairs = {(r.row_id, r.feature_i, r.feature_j): r.value for r in A.explain_interactions(rows, leaves, 4).collect()}
    monkeypatch.setattr(A, "PART_BYTES", 900)
    monkeypatch.setattr(A, "BLOCK_CELLS", 64)
    assert len(leaves.parts()) > 2
    found, expected = A.explain(rows, leaves, x[100:110])
    parts = read(found)
    assert parts.keys() == whole.keys() and all(np.isclose(parts[k], whole[k]) for k in whole)
    assert np.isclose(expected, leaves.predict(x[100:110]).mean())
    again = {(r.row_id, r.feature_i, r.feature_j): r.value for r in A.explain_interactions(rows, leaves, 4).collect()}
    assert all(np.isclose(again.get(k, 0.0), v) for k, v in pairs.items())


def test_wide_sparse_rows_cost_what_their_cells_cost(spark):
    """5,010 features, 50 rows, 9,600 leaves: attributions add up, pairs stay on shared paths, memory is bounded."""
    import resource

    rng = np.random.default_rng(0)
    p, n, d = 5010, 9600, 5
    feature = np.sort(np.array([rng.choice(p, d, replace=False) for _ in range(n)]), 1)
    up = rng.random((n, d)) < 0.5
    leaves = A.Leaves(feature, np.where(up, 0.1, -np.inf), np.where(up, np.inf, 0.1), rng.random((n, d)), rng.normal(size=n))
    vector = lambda: Vectors.sparse(p, sorted(rng.choice(p, 30, replace=False).tolist()), rng.random(30).tolist())
    xs, background = [vector() for _ in range(50)], [vector() for _ in range(200)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = spark.createDataFrame(list(enumerate(xs)), ["row_id", "features"])
    found, expected = A.explain(rows, leaves, background)
    sums = {r.row_id: r.s for r in found.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
    predicted = [leaves.predict(v.toArray()[None, :])[0] for v in xs]
    assert np.isclose(expected, np.mean([leaves.predict(v.toArray()[None, :])[0] for v in background]))
    assert np.allclose([sums.get(k, 0.0) + expected for k in range(50)], predicted)
    pairs = A.explain_interactions(rows.limit(3), leaves)
    total = {r.row_id: r.s for r in pairs.groupBy("row_id").agg(F.sum("value").alias("s")).collect()}
    rest = (leaves.ratio.prod(1) * leaves.value).sum()  # prediction where every feature is absent
    assert len(total) == 3 and all(np.isclose(total[k], predicted[k] - rest) for k in total)
    paths = {(int(a), int(b)) for f in feature for a in f for b in f}
    assert all((r.feature_i, r.feature_j) in paths for r in pairs.select("feature_i", "feature_j").distinct().collect())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kilobytes


def test_sparse_and_dense_rows_are_explained_alike(spark, data, tmp_path):
    x, _, df = data
    model = RandomForestRegressor(labelCol="y", maxDepth=3, seed=1, numTrees=3).fit(df)
    leaves = A.ensemble_leaves(spark, model, f"file://{tmp_path}/m")
    x = np.where(np.abs(x) < 0.5, 0.0, x)
    arrays = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(6)], "row_id long, x array<double>")
    sparse = spark.createDataFrame([(i, Vectors.sparse(4, [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])])) for i in range(6)], ["row_id", "features"])
    read = lambda f: {(r.row_id, r.feature_id): r.shap for r in f.collect()}
    one, two = (read(A.explain(rows, leaves, x[50:70])[0]) for rows in (arrays, sparse))
    assert one == two and len(one) > 6
    cells = lambda f: {(r.row_id, r.feature_i, r.feature_j): r.value for r in f.collect()}
    one, two = (cells(A.explain_interactions(rows, leaves)) for rows in (arrays, sparse))
    assert one == two
