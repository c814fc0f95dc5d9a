"""Queries without SQL run and keep their invariants; the entry point works."""

import __spark_entry__ as entry
import pytest
from benchlens.operators import explain
from benchlens.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "target_mean" in got.columns
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_models_and_runs(spark):
    cv = registry.QUERIES["cross_validation"](spark, SF)
    assert {r.model for r in cv.groupBy("model").count().collect()} == {"ridge", "random_forest", "extra_trees", "hist_gbrt"}
    assert registry.QUERIES["repeated_validation"](spark, SF).first().n_repeats == 2
    shap = registry.QUERIES["tree_attributions"](spark, SF)
    assert shap.select("row_id").distinct().count() <= 20 and shap.where("shap = 0 or shap is null").isEmpty()
    pairs = {(r.row_id, r.feature_i, r.feature_j): r.value for r in registry.QUERIES["tree_interactions"](spark, SF).collect()}
    assert all(abs(v - pairs.get((r, j, i), 0.0)) < 1e-9 for (r, i, j), v in pairs.items())
    assert registry.QUERIES["whole_run"](spark, SF).count() == 2
    assert registry.QUERIES["permutation_importance"](spark, SF).count() == 3


def test_all_flows_and_all_pairs(spark):
    """Flows of any task are loaded, and the ratio is that of all pairs of features."""
    of_all, of_some = ({r.id for r in registry.QUERIES[n](spark, SF).collect()} for n in ("load_all_flows", "load_flows"))
    assert of_some == of_all == {r.id for r in spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_partkey as id").join(spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_partkey as id"), "id", "left_semi").collect()}
    a = spark.createDataFrame([(r, r % 2, i, (i - r) / 7.0) for r in range(4) for i in range(12)], "row_id long, fold int, feature_id int, shap double")
    pairs = a.alias("a").join(a.alias("b"), "row_id").select("a.fold", F.col("a.feature_id").alias("feature_i"), F.col("b.feature_id").alias("feature_j"), (F.col("a.shap") * F.col("b.shap")).alias("value"))
    got, want = ({r.fold: r.interaction_ratio for r in f.collect()} for f in (explain.product_interaction_ratio(a, ["fold"]), explain.interaction_ratio(pairs, ["fold"])))
    assert got == pytest.approx(want)


def test_every_fold_is_explained(spark):
    shap = registry.QUERIES["fold_attributions"](spark, SF)
    assert {r.fold for r in shap.select("fold").distinct().collect()} == set(range(5))
    assert {r.fold for r in registry.QUERIES["fold_interactions"](spark, SF).collect()} == set(range(5))


def test_text_run_and_repeats(spark):
    run = registry.QUERIES["whole_text_run"](spark, SF).collect()
    assert [(r.experiment, r.model) for r in run] == [("tfidf_meta", "random_forest")] and run[0].n_local_explanations > 0
    got = {r.model: r for r in registry.QUERIES["robust_stability"](spark, SF).collect()}
    assert set(got) == {"ridge", "random_forest"} and all(r.n_repeats == 2 and 0 <= r.jaccard_mean <= 1 for r in got.values())
