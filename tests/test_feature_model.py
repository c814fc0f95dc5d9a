"""Fitted features: equal to the long form, saved, loaded and applied to new rows."""

from collections import Counter

import pytest

from benchlens.functions.text import clean_text
from benchlens.operators import feature_model, features, folds, tables, trees
from benchlens.operators.feature_model import FeatureEstimator, FeatureModel
from benchlens.plans import inputs, pipeline
from benchlens.sources import results
from pyspark.sql import functions as F

ROWS = [(1, "Alpha beta, alpha", 1.0, 3, True), (2, "beta gamma", None, 3, False), (3, None, float("nan"), 3, True), (4, "alpha (beta) gamma delta", 7.5, 3, True), (5, "", 2.0, 3, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id long, t string, x double, constant int, flag boolean")


def cells(model, df):
    out = trees.cells(model.transform(df).select("row_id", model.getOrDefault("outputCol")), model.getOrDefault("outputCol"))
    return {(r.row_id, model.names[r.c.f]): r.c.v for r in out.select("row_id", F.explode("_cells").alias("c")).collect()}


def test_equal_to_the_long_form_and_saved(spark, rows, tmp_path):
    model = FeatureEstimator(textCol="t", numericCols=["x", "constant", "flag"], maxFeatures=6).fit(rows)
    long = features.build_features(rows, "tfidf", ["x", "constant", "flag"], text="t", max_features=6)
    want = {(r.row_id, r.feature): r.value for r in long.collect() if r.value}
    got = cells(model, rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    again = FeatureModel.load(f"file://{tmp_path}/m")
    assert again.uid == model.uid and again.names == model.names and cells(again, rows) == got
    new = spark.createDataFrame([(9, "beta unseen", None, 4, None)], rows.schema)
    unseen = cells(again, new)
    assert unseen[9, "text::beta"] == 1.0 and unseen[9, "meta::constant"] == 4.0 and unseen[9, "meta::x"] == again.numeric["x"][0] / again.numeric["x"][1]


def test_rows_never_pass_a_python_worker(rows):
    model = FeatureEstimator(textCol="t", numericCols=["x"], outputCol="v").fit(rows)
    out = model.transform(rows)
    assert out.columns == [*rows.columns, "v"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_block_only_and_nothing(rows):
    text, numbers = FeatureEstimator(textCol="t").fit(rows), FeatureEstimator(numericCols=["x"]).fit(rows)
    assert all(n.startswith("text::") for n in text.names) and numbers.names == ["meta::x"]
    assert {k[0] for k in cells(text, rows)} == {1, 2, 4} and len(cells(numbers, rows)) == 5
    with pytest.raises(ValueError, match="no features"):
        FeatureEstimator().fit(rows)


def test_long_form_to_vectors_without_python(spark):
    long = spark.createDataFrame([("a", "text::x", 0.5), ("a", "meta::y", 2.0), ("b", "meta::y", 0.0), ("b", "text::x", -1.0)], "row_id string, feature string, value double")
    got = features.to_vectors(long, features.feature_dictionary(long), 2)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.row_id: r.features.toArray().tolist() for r in got.collect()} == {"a": [0.5, 2.0], "b": [-1.0, 0.0]}


def test_vocabulary_by_plain_counting(spark):
    """Pairs that words cannot reach are not counted, terms of too many rows give their places on, ties go by alphabet."""
    texts = ["aa bb cc aa bb", "aa bb cc", "aa dd  dd dd ee", "aa bb", "aa bb", None, "zz aa. ff", "aa gg ff"] + ["aa hh"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    total, has = Counter(), Counter()
    for t in texts:
        w = (t or "").replace(".", " ").split()
        own = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        total.update(own)
        has.update(own.keys())
    for n, share in ((1, 1.0), (2, 0.6), (3, 0.5), (6, 0.95), (9, 0.3), (500, 0.95), (2, 0.01)):
        able = sorted((t for t in total if has[t] <= share * len(texts)), key=lambda t: (-total[t], t))[:n]
        got = features.vocabulary(features.tokenized(rows, "t"), len(texts), n, share).collect()
        assert {(r.feature_id, r.term, r.df) for r in got} == {(k, t, has[t]) for k, t in enumerate(sorted(able))}, (n, share)


def test_no_task_groups_the_terms_of_texts(spark):
    """Counting was a hash table of all (text, term) of a task: 2.4 GB for 250 MB of text."""
    rows = spark.createDataFrame([("alpha beta",), ("beta gamma",)], "t string")
    plan = features.tfidf(rows, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_white_space_is_unicode_s(spark):
    white = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    rows = spark.createDataFrame([(f"{w}A{w}{w}b {w}.c{w}D e{w}",) for w in white] + [("a\x1cb​c",)], "t string")
    got = [r[0] for r in rows.select(clean_text(F.col("t"))).collect()]
    assert got == ["a b c d e"] * len(white) + ["a\x1cb​c"]


def test_numeric_vectors_equal_the_long_form_without_a_shuffle(spark, rows):
    columns = ["x", "constant", "flag"]
    got, names = features.numeric_vectors(rows.select("row_id", *columns), columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and got.columns == ["row_id", "features"]
    long = {(r.row_id, r.feature): r.value for r in features.numeric_features(rows, columns).collect()}
    assert {(r.row_id, n): v for r in got.collect() for n, v in zip(names, r.features.toArray().tolist(), strict=True)} == long
    known = features.feature_dictionary(features.numeric_features(rows, columns)).orderBy("feature_id").collect()
    assert names == [r.feature for r in known]


def test_row_vectors_equal_the_long_form_without_grouping_rows(spark, rows, monkeypatch):
    """Rows of a text share its weights; vectors were gathered from a long table of all cells, grouped by row."""
    columns = ["x", "constant", "flag"]
    cleaned = rows.withColumn("t_clean", clean_text(F.col("t"))).drop("t")
    words = features.tokenized_clean(cleaned, "t_clean")
    read = lambda df: {r.text_key: (r.n_rows, r.words) for r in df.collect()}
    assert read(words) == read(features.tokenized(rows, "t"))
    chosen, stats = features.fitted(words, rows.count(), 6)[0], features.numeric_statistics(rows, columns)
    model = FeatureModel([t.term for t in chosen], [t.idf for t in chosen], stats)
    weights = features.text_weights(words, model.vocabulary, model.idf)
    plans, real = [], features.write_table
    monkeypatch.setattr(features, "write_table", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    got = features.row_vectors(features.with_text_key(cleaned, "t_clean"), weights, len(chosen), stats, columns)
    assert "Aggregate" not in plans[0] and "Python" not in plans[0] and got.columns == ["row_id", "features"]
    long = features.build_features(rows, "tfidf", columns, text="t", max_features=6)
    want = features.to_vectors(long, features.feature_dictionary(long), len(model.names))
    of = lambda df: {r.row_id: r.features.toArray().tolist() for r in df.collect()}
    assert of(got) == {k: pytest.approx(v, abs=1e-12) for k, v in of(want).items()} and len(of(got)) == rows.count()
    kept = feature_model.fitted_models(feature_model.fitted_table(spark, {("m", 1): model}))
    again = feature_model.long_features(rows, kept, "t")
    assert {(r.split_mode, r.fold, r.row_id, r.feature): r.value for r in again.collect()} == {("m", 1, r.row_id, r.feature): pytest.approx(r.value) for r in long.collect()}


def test_long_features_of_a_fold_run_are_read_back(spark, tmp_path):
    """A run with features of each fold leaves its fitted models, not a row for every cell, protocol and fold."""
    sf, root = "/root/testdata/sf0.001", f"file://{tmp_path}/results"
    config = pipeline.Config("f", fit_scope="fold", models=("ridge",), prefixes=("Brand#1.", "small "), cv_folds=2, max_features=20)
    out = pipeline.run(spark, inputs.evaluations(spark, sf), inputs.tasks(spark, sf), inputs.flows(spark, sf), config, root)
    supervised, long = results.read_artifacts(spark, root, "f")
    assert spark.read.parquet(f"{root}/features").count() < supervised.count()
    fold_of = {r.row_id: r.fold for r in folds.row_folds(supervised, "row_id", 2).collect()}
    for fold in (0, 1):
        train = supervised.where(F.col("row_id").isin([k for k, v in fold_of.items() if v != fold]))
        want = features.build_features(supervised, "tfidf", [c for c in tables.METAFEATURES if c in supervised.columns], fit_on=train, max_features=20)
        own = long.where(f"split_mode = 'row_kfold' and fold = {fold}")
        assert {(r.row_id, r.feature): r.value for r in own.collect()} == {(r.row_id, r.feature): pytest.approx(r.value) for r in want.collect()}
    assert out["predictions"].count() == 2 * supervised.count()
