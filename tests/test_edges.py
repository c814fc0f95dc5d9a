"""Hand-made tables: nulls, garbage, ties, boundaries; and the errors that inputs raise."""

import math

import pytest
from pyspark.sql import functions as F

from benchlens.functions import text as X
from benchlens.operators import explain, features, folds, metrics, models, tables
from benchlens.plans.pipeline import Config
from benchlens.sources import evaluations as S

EVALS = [(1, 1, "0.5"), (1, 2, "1"), (1, 2, "3"), (2, 1, "NaN"), (2, 2, "abc"), (2, 3, " 2 "), (3, 1, "1.0d"), (3, 2, None), (None, 1, "1"), (1, None, "1"), (4, 1, "inf"), (5, 1, "1e1")]


@pytest.fixture(scope="module")
def evals(spark):
    return spark.createDataFrame(EVALS, "task_id long, flow_id long, value string")


def test_aggregation(evals):
    got = {(r.task_id, r.flow_id): (r.target_value, r.value_std, r.value_count) for r in tables.aggregate_evaluations(evals).collect()}
    assert got == {(1, 1): (0.5, 0.0, 1), (1, 2): (2.0, math.sqrt(2), 2), (2, 3): (2.0, 0.0, 1), (4, 1): (float("inf"), 0.0, 1), (5, 1): (10.0, 0.0, 1)}
    assert {r.target_value for r in tables.aggregate_evaluations(evals, agg_mode="max").where("task_id = 1 and flow_id = 2").collect()} == {3.0}
    with pytest.raises(ValueError):
        tables.aggregate_evaluations(evals, agg_mode="median")
    with pytest.raises(ValueError):
        tables.aggregate_evaluations(evals.drop("value"))


def test_load_evaluations(spark, evals):
    assert S.load_evaluations([evals, evals]).count() == len(EVALS)
    capped = S.load_evaluations([evals, evals], per_task=2, order=["flow_id", "value"])
    assert sorted((r.task_id or 0, r.flow_id or 0) for r in capped.where("task_id = 1").collect()) == [(1, 0)]
    with pytest.raises(ValueError):
        S.load_evaluations([evals.limit(0)])
    with pytest.raises(ValueError):
        S.load_evaluations([])
    flows, missing = S.load_flows(spark.createDataFrame([(1,), (9,)], "id long"), evals)
    assert [r.id for r in flows.collect()] == [1] and sorted(r.flow_id for r in missing.collect()) == [2, 3]


def test_flows(spark):
    rows = [(1, None, "a.b(c=d)", "0", None), (2, "", "", None, None), (None, "x", "y", "1", "z"), (3, "n  m", None, "", "ext==1:2")]
    got = {r.flow_id: r for r in tables.normalize_flows(spark.createDataFrame(rows, "id long, name string, full_name string, version string, external_version string")).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].flow_text == "full_name: a.b(c=d)\nversion: 0" and got[1].flow_text_clean == "full_name a b c d version 0"
    assert got[2].flow_text == got[2].flow_text_clean == "" and got[1].flow_uploader is None
    assert got[3].flow_text_clean == "name n m external_version ext 1 2"
    text = '{"5": {"name": "five"}, "6": [1], "7": {"id": 70, "full_name": "seven"}, "8": "x"}'
    parsed = tables.normalize_flows(tables.flows_from_json(spark.createDataFrame([(text,), (None,), ("junk",)], "value string")))
    assert sorted((r.flow_id, r.flow_text) for r in parsed.collect()) == [(5, "name: five"), (70, "full_name: seven")]


def test_tasks_and_features(spark):
    t = spark.createDataFrame([(1, 10, "a", 1.0, None, 5.0), (2, 10, "b", None, None, 5.0), (3, 11, "c", 2.0, None, 5.0), (4, 11, "d", 10.0, None, 5.0), (5, 11, "e", 11.0, None, 5.0)], "tid long, did long, name string, NumberOfFeatures double, NumberOfClasses double, MinorityClassSize double")
    known, found = tables.normalize_tasks(t)
    assert found == ["MinorityClassSize", "NumberOfClasses", "NumberOfFeatures"]
    stats = features.numeric_statistics(known, found)
    assert "NumberOfClasses" not in stats and stats["MinorityClassSize"] == (5.0, 1.0) and stats["NumberOfFeatures"][0] == 6.0
    assert tables.feature_columns(known) == found
    with pytest.raises(ValueError):
        features.numeric_statistics(known, [])
    rows = known.withColumn("row_id", F.col("task_id"))
    with pytest.raises(ValueError):
        features.build_features(rows, "tfidf2", found)
    with pytest.raises(ValueError):
        features.build_features(rows, "none", None)
    with pytest.raises(ValueError):
        features.build_features(rows, "embedding", None)


def test_supervised(spark):
    e = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.6), (1, 9, 0.7), (1, 2, None)], "task_id long, flow_id long, target_value double")
    t = spark.createDataFrame([(1, "a"), (1, "b")], "task_id long, task_name string")
    f = spark.createDataFrame([(1, ""), (2, "t")], "flow_id long, flow_text string")
    got = sorted((r.row_id, r.task_name) for r in tables.supervised_table(e, t, f).collect())
    assert got == [("1::1", "a"), ("1::1", "b"), ("2::1", None)]
    with pytest.raises(ValueError):
        tables.supervised_table(e, t, f, strict=True)
    with pytest.raises(ValueError):
        tables.supervised_table(e, t, f, text="other")
    assert tables.has_prefix(e) is not None and tables.relevant_flows(f.withColumn("flow_name", F.lit(None).cast("string")), e).count() == 0


def test_tokens_and_encoder(spark):
    df = spark.createDataFrame([("a bb ccc été_1",), (None,), ("bb bb",)], "t string")
    got = [r.x for r in df.select(X.terms(X.tokens(F.col("t"))).alias("x")).collect()]
    assert got == [["bb", "ccc", "été_1", "bb ccc", "ccc été_1"], [], ["bb", "bb", "bb bb"]]
    encoded = {r.text: r.vector for r in features.encode_texts(df, "t", lambda: lambda texts: [[len(x)] for x in texts]).collect()}
    assert encoded == {"": [0.0], "bb bb": [5.0], "a bb ccc été_1": [14.0]}
    assert X.cache_key("p", {"a": 1, "b": 2}) == X.cache_key("p", {"b": 2, "a": 1}) != X.cache_key("p", {"a": 1, "b": 3})
    one, two = (X.fingerprint(df.repartition(k), "t").first()[0] for k in (1, 3))
    assert one == two != X.fingerprint(df.limit(2), "t").first()[0]


def test_metrics(spark):
    p = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 1.0), ("e", 1.0, 1.0), ("f", 1.0, 2.0), ("f", 3.0, 2.0)], "g string, y_true double, y_pred double")
    assert {r.g: r.r2 for r in metrics.fold_metrics(p, ["g"]).collect()} == {"c": 1.0, "d": 0.0, "e": None, "f": 0.0}


def results(spark, *models_):
    rows = [("s", m, i, float(v)) for m, values in models_ for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "split_mode string, model string, fold int, mse double")


def test_wilcoxon(spark):
    one = metrics.wilcoxon(results(spark, ("a", [1, 2, 3, 4, 5]), ("b", [2, 4, 6, 8, 10])))
    assert [(r.statistic, r.p_value) for r in one.collect()] == [(0.0, 0.0625)]
    both = results(spark, ("a", [1, 2, 3]), ("b", [2, 4, 6]))
    both = both.union(both.withColumn("split_mode", F.lit("t")).withColumn("mse", F.col("mse") * 10.5))
    assert [(r.split_mode, r.p_value) for r in metrics.wilcoxon(both, pooled=True).collect()] == [("all", 2 / 64)]
    same = metrics.wilcoxon(results(spark, ("a", [1, 2]), ("b", [1, 2])))
    assert [(r.statistic, r.p_value) for r in same.collect()] == [(0.0, 1.0)]
    assert metrics.wilcoxon(results(spark, ("a", [1, 2, 3]), ("b", [1, 2]))).collect() == []
    assert metrics.wilcoxon(results(spark, ("a", [1, 2, 3]))).columns == ["split_mode", "model_a", "model_b", "metric", "statistic", "p_value"]
    a, b = [0] * 8, [1, 1, -2, 3, 4, -5, 6, 0]  # ties and a zero: the normal approximation
    got = metrics.wilcoxon(results(spark, ("a", a), ("b", b))).first()
    w, n = min(1.5 + 1.5 + 4 + 5 + 7, 3 + 6), 7
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (2**3 - 2) / 48)
    assert got.statistic == w and math.isclose(got.p_value, math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)), rel_tol=1e-9)
    for z in (0.0, 0.5, 2.99, 3.01, 8.0):
        tail = spark.range(1).select(metrics._upper(F.lit(z)).alias("p")).first().p
        assert math.isclose(tail, math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-9)


def test_folds(spark):
    rows = spark.range(23).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 4).alias("g"))
    for parts in (1, 5):
        sizes = [r["count"] for r in folds.row_folds(rows.repartition(parts), "row_id").groupBy("fold").count().orderBy("fold").collect()]
        assert sizes == [5, 5, 5, 4, 4]
    groups = spark.createDataFrame([("huge", 100), ("a", 5), ("b", 5), ("c", 5)], "g string, n long")
    assert {r.g: r.fold for r in folds.group_folds(groups, "g", 3).collect()} == {"huge": 0, "a": 1, "b": 2, "c": 1}
    with pytest.raises(ValueError):
        folds.with_group_folds(rows, "g", 5)
    spread = folds.with_group_folds(rows, "g", 2)
    assert spread.select("g", "fold").distinct().count() == 4 and {r.shared for r in folds.leakage(spread, "g").collect()} == {0}
    one, two = (sorted(r.row_id for r in folds.sample(rows.repartition(k), ["g"], "row_id", 3).collect()) for k in (1, 4))
    assert one == two and len(one) == 12
    assert folds.shuffled_group_folds(rows, "g", 2, 1, 0).count() == 4
    with pytest.raises(ValueError):
        folds.row_folds(rows, "row_id", 1)


ATTR = [(0, 1, i, f"meta::m{i}" if i % 2 else f"text::emb_{i}", v) for i, v in enumerate([3.0, -3.0, 1.0, 1.0])] + [(0, 2, 0, "text::emb_0", 0.0), (1, 3, 1, "meta::m1", 2.0)]


def test_explanations(spark):
    a = spark.createDataFrame(ATTR, "fold int, row_id long, feature_id int, feature string, shap double")
    d = spark.createDataFrame([(i, f"meta::m{i}" if i % 2 else f"text::emb_{i}") for i in range(4)], "feature_id int, feature string")
    by = ["fold", "row_id"]
    assert [(r.feature_id, r["rank"]) for r in explain.local_topk(a, by, 3).where("row_id = 1").orderBy("rank").collect()] == [(1, 1), (0, 2), (3, 3)]
    filled = explain.local_topk(a, by, 3, d)
    assert [r.feature_id for r in filled.where("row_id = 3").orderBy("rank").collect()] == [1, 3, 2]
    assert [r.feature_id for r in filled.where("row_id = 2").orderBy("rank").collect()] == [3, 2, 1]
    assert {r.row_id: r.sparsity for r in explain.sparsity(a, by, 0.75).collect()} == {1: 2, 2: 0, 3: 1}  # reached exactly
    assert {r.row_id: r.readability for r in explain.readability(filled, by).collect()} == {1: 2 / 3, 2: 2 / 3, 3: 2 / 3}
    by_fold = explain.mean_abs(a, ["fold"])
    assert {(r.fold, r.feature_id): r.mean_abs_shap for r in by_fold.collect()} == {(0, 0): 1.5, (0, 1): 1.5, (0, 2): 0.5, (0, 3): 0.5, (1, 1): 2.0}
    assert {r.feature_id: (r.mean_abs_shap, r.std_abs_shap) for r in explain.global_importance(by_fold).collect()}[0] == (0.75, 0.75)
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(explain.jaccard(empty, empty)).first()[0] is None
    inter = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 0.0), (1, 2, 2, 5.0)], "fold int, feature_i int, feature_j int, value double")
    assert {r.fold: r.interaction_ratio for r in explain.interaction_ratio(inter, ["fold"]).collect()} == {0: None, 1: 0.0}


def test_permutation_importance(spark):
    rows = [(i, f, float((i * k) % 17)) for i in range(200) for f, k in (("a", 3), ("b", 5))]
    long = spark.createDataFrame(rows, "row_id long, feature string, value double")
    w = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "feature string, weight double")
    truth = long.where("feature = 'a'").select("row_id", (F.col("value") * 2.0).alias("y"))
    got = {r.feature: (r.importance_mean, r.importance_std) for r in explain.permutation_importance(long, w, 0.0, truth, 4).collect()}
    assert got["a"][0] > 50 and got["b"] == (0.0, 0.0)


def test_configurations():
    for bad in ({"text_mode": "x"}, {"agg_mode": "x"}, {"run_row_kfold": False, "run_task_group_kfold": False}, {"text_mode": "none", "use_task_metafeatures": False}, {"models": ("nope",)}):
        with pytest.raises(ValueError):
            Config("c", **bad).check()
    assert list(models.select_models()) == ["ridge", "random_forest", "extra_trees", "hist_gbrt"]


def test_group_folds_against_plain_greedy(spark):
    """Largest groups first, each to the lightest fold; ties by id, then fold; many groups take linear time."""
    sizes = {g: (g * 7919) % 13 + 1 for g in range(3000)}
    loads, want = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = loads.index(min(loads))
        loads[want[g]] += sizes[g]
    frame = spark.createDataFrame(list(sizes.items()), "g long, n long").repartition(7)
    assert {r.g: r.fold for r in folds.group_folds(frame, "g", 5).collect()} == want


def test_explained_rows_are_drawn_without_ranking_all(spark):
    """Few candidates are ranked, and the draw is that of ``sample`` in every fold; vectors are read once."""
    from benchlens.plans import pipeline

    rows = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), F.col("id").alias("features"))
    config = pipeline.Config("c", shap_background=7, shap_eval=5)
    got = pipeline.drawn(rows, [0, 1, 2], config)
    assert got.count() == 3 * 12
    for k in range(3):
        train, test = folds.split(rows, k)
        of = lambda role: {r.row_id for r in got.where((F.col("fold") == k) & (F.col("role") == role)).collect()}  # noqa: B023, E731
        assert of("eval") == {r.row_id for r in folds.sample(test, ["fold"], "row_id", 5, 42 + k).collect()}
        assert of("background") == {r.row_id for r in folds.sample(train.withColumn("g", F.lit(0)), ["g"], "row_id", 7, 42 + k, "background").collect()}
    assert folds.first_by_hash(rows, "fold", "row_id", 5, {0: 1334, 1: 1333, 2: 1333}).count() < 600
    same = rows.withColumn("row_id", F.lit("r0"))  # one hash: a bound may keep none, so all are ranked
    assert pipeline.drawn(same.limit(3000), [0], config).select("role").distinct().count() == 2
