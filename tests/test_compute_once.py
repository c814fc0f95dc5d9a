"""Tables that are computed once: stale data, several writers, dead writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from benchlens.operators.feature_model import FeatureModel
from benchlens.operators import models
from benchlens.plans import inputs, pipeline
from benchlens.sources import results


def test_changed_files_are_another_table(spark, tmp_path):
    root, source = f"file://{tmp_path}/cache", f"file://{tmp_path}/in put=1"
    calls = []

    def once():
        df = spark.read.parquet(source)
        return results.materialize(spark, lambda: calls.append(1) or df.agg(F.avg("v").alias("v")), root, "t", {"a": 1}, [df]).first().v

    spark.createDataFrame([(1, 1.0)], "k long, v double").write.parquet(source)
    assert once() == once() == 1.0 and len(calls) == 1
    spark.createDataFrame([(1, 5.0)], "k long, v double").write.mode("overwrite").parquet(source)
    assert once() == 5.0 and len(calls) == 2


def test_identity_follows_files_plans_and_rows(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(5).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    assert results.identity(read()) == results.identity(read()) != results.identity(read().where("id > 1"))
    local = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert results.identity(local(1, 2)) == results.identity(local(2, 1)) != results.identity(local(1, 3))
    assert results.identity(read().join(local(1).withColumnRenamed("v", "id"), "id")) != results.identity(read().join(local(2).withColumnRenamed("v", "id"), "id"))


def test_one_of_several_writers_wins(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    make = lambda k: results.materialize(spark, lambda: spark.range(1).select(F.lit(k).alias("k")), root, "t", {})
    with ThreadPoolExecutor(4) as pool:
        got = {f.first().k for f in pool.map(make, range(4))}
    assert len(got) == 1
    assert [p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")] == [next(p.name for p in (tmp_path / "cache").iterdir() if p.name.startswith("t"))]


def test_a_late_writer_changes_nothing(spark, tmp_path):
    final = f"file://{tmp_path}/done"
    for k in (1, 2):
        spark.range(k).write.parquet(f"file://{tmp_path}/made{k}")
    assert results.publish(spark, f"file://{tmp_path}/made1", final)
    assert not results.publish(spark, f"file://{tmp_path}/made2", final)
    assert spark.read.parquet(final).count() == 1 and not (tmp_path / "made2").exists()


def test_a_dead_writer_leaves_nothing_visible(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    broken = lambda: spark.range(4).select(F.raise_error(F.lit("dies")).cast("long").alias("x"))
    with pytest.raises(Exception, match="dies"):
        results.materialize(spark, broken, root, "t", {})
    assert results.materialize(spark, lambda: spark.range(3), root, "t", {}).count() == 3


def test_a_run_leaves_its_feature_model(spark, tmp_path):
    sf, root = "/root/testdata/sf0.001", f"file://{tmp_path}/results"
    config = pipeline.Config("kept", models=("ridge",), prefixes=("Brand#1.", "small "), cv_folds=2, max_features=20, run_row_kfold=False, settings=models.Settings())
    out = pipeline.run(spark, inputs.evaluations(spark, sf), inputs.tasks(spark, sf), inputs.flows(spark, sf), config, root)
    model = FeatureModel.load(f"{root}/models/mean-kept/features")
    assert set(model.names) == {r.feature for r in out["features"].select("feature").distinct().collect()}
    unseen = out["supervised"].limit(2).withColumn("flow_text", F.lit("never seen"))
    assert model.transform(unseen).count() == 2


def test_empty_tables_of_runs_at_once(spark, tmp_path, monkeypatch):
    """Another run removes the folder above between the look and the removal."""
    root, real = f"file://{tmp_path}/r", results._file_system

    class Raced:
        def __init__(self, fs):
            self.fs = fs

        def listStatus(self, path):
            held = self.fs.listStatus(path)
            self.fs.delete(path, False)
            return held if held else self.fs.listStatus(path)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    def raced(spark, path):
        fs, at = real(spark, path)
        return Raced(fs), at

    monkeypatch.setattr(results, "_file_system", raced)
    assert not results.write_result(spark.range(0), root, "summary", "a")
    assert not (tmp_path / "r" / "summary" / "agg_mode=mean").exists()
