"""A grid's stages are made once, by any run; a run that failed resumes."""

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from benchlens.operators import models
from benchlens.plans import inputs, pipeline
from benchlens.plans.stages import Stages

SF = "/root/testdata/sf0.001"


def test_three_by_two_writes_each_stage_once_and_resumes(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/results"
    data = inputs.evaluations(spark, SF), inputs.tasks(spark, SF), inputs.flows(spark, SF)
    base = pipeline.Config("base", models=("ridge",), prefixes=("Brand#1.", "small "), cv_folds=2, max_features=20, run_row_kfold=False, settings=models.Settings())
    letters = (lambda: lambda: lambda texts: [[float(len(t))] for t in texts])()
    configs = pipeline.grid(base, {"tfidf_meta": {}, "embedding_meta": {"text_mode": "embedding", "encoder": letters}, "meta_only": {"text_mode": "none"}})
    assert len(configs) == 6
    real, fail = pipeline._fits, [True]

    def once_broken(spark, mode, folded, long, dictionary, config, root):
        if config.name == "meta_only" and config.agg_mode == "mean" and fail:
            raise RuntimeError("lost")
        return real(spark, mode, folded, long, dictionary, config, root)

    monkeypatch.setattr(pipeline, "_fits", once_broken)
    first = Stages(spark, root, data)
    with pytest.raises(RuntimeError, match="lost"):
        pipeline.run_grid(spark, *data, configs, root, stages=first)
    assert Counter(first.made) == {"flows": 1, "targets": 2, "supervised": 2, "folds": 1, "weights": 1, "features": 3, "fits": 5}
    fail.clear()
    second = Stages(spark, root, data)
    out = pipeline.run_grid(spark, *data, configs, root, stages=second)
    assert second.made == ["fits"] and len(out) == 6
    for mode in ("max", "mean"):
        anchor = pipeline.consolidate(spark, root, mode)["predictive_anchor"].collect()
        assert {r.experiment for r in anchor} == {"tfidf_meta", "embedding_meta", "meta_only"}
    found = pipeline.consolidate_discovered(spark, [root], "summary", "max")
    assert {r.experiment for r in found.collect()} == {"tfidf_meta", "embedding_meta", "meta_only"}


def test_a_stage_asked_for_at_once_is_made_once(spark, tmp_path):
    stages, calls = Stages(spark, f"file://{tmp_path}"), []
    ask = lambda _: stages.table("t", {"a": 1}, lambda: calls.append(1) or spark.range(3)).count()
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(ask, range(4))) == [3] * 4
    assert len(calls) == 1 and stages.made == ["t"]
    assert Stages(spark, f"file://{tmp_path}", [spark.range(2)]).table("t", {"a": 1}, lambda: spark.range(9)).count() == 9  # other inputs


def test_a_failed_stage_is_tried_again(spark, tmp_path):
    stages = Stages(spark, f"file://{tmp_path}")
    broken = lambda: spark.range(2).select(F.raise_error(F.lit("dies")).cast("long").alias("x"))
    with pytest.raises(Exception, match="dies"):
        stages.tables("t", {}, lambda: {"good": spark.range(1), "bad": broken()})
    assert set(stages.tables("t", {}, lambda: {"good": spark.range(1), "none": None})) == {"good"}
