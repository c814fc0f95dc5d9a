"""Vectors are computed once for each text."""

import numpy as np

from benchlens.operators import models
from benchlens.operators.encoder_store import EncoderStore, text_key
from benchlens.plans import inputs, pipeline


def encoders():
    """Made here, so that workers get them by value."""

    def never():
        def encode(texts):
            raise AssertionError(f"encoded again: {texts}")

        return encode

    return lambda: lambda texts: [[len(t), 1.0] for t in texts], never


sizes, never = encoders()


def test_only_new_texts_are_encoded(spark, tmp_path):
    store = EncoderStore(spark, f"file://{tmp_path}/vectors", "sizes")
    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    assert store.add(rows("a", "bb", "a", None), "t", sizes) == 3
    assert store.add(rows("bb", ""), "t", never) == 0
    calls = spark.sparkContext.accumulator(0)

    def counting():
        return lambda texts: [calls.add(len(texts)) or [len(t), 2.0] for t in texts] if texts else []

    assert store.add(rows("bb", "ccc", "ccc"), "t", counting) == 1 and calls.value == 1
    got = {r.text_key: list(r.vector) for r in store.vectors(rows("a", "ccc", "a"), "t", never).collect()}
    want = {r.k: r.n for r in rows("a", "ccc").select(text_key("t").alias("k"), "t").selectExpr("k", "length(t) as n").collect()}
    assert {k: v[0] for k, v in got.items()} == want and len(got) == 2


def test_texts_that_two_runs_added_count_once(spark, tmp_path):
    store = EncoderStore(spark, f"file://{tmp_path}/vectors", "sizes")
    one = spark.createDataFrame([("a",), ("b",)], "t string")
    store.add(one.limit(1), "t", sizes)
    other = EncoderStore(spark, f"file://{tmp_path}/vectors", "sizes")
    other.stored = lambda: spark.createDataFrame([], "text_key string, vector array<double>")  # it looked before the first run wrote
    other.add(one, "t", sizes)
    assert store.stored().count() == 3 and store.vectors(one, "t", never).count() == 2


def test_a_run_with_an_encoder(spark, tmp_path):
    sf, root = "/root/testdata/sf0.001", f"file://{tmp_path}/results"
    base = {"text_mode": "embedding", "models": ("ridge",), "prefixes": ("Brand#1.", "small "), "cv_folds": 2, "run_row_kfold": False, "settings": models.Settings()}
    data = inputs.evaluations(spark, sf), inputs.tasks(spark, sf), inputs.flows(spark, sf)
    out = pipeline.run(spark, *data, pipeline.Config("first", encoder=sizes, **base), root)
    again = pipeline.run(spark, *data, pipeline.Config("second", encoder=never, use_task_metafeatures=False, **base), root)
    texts = {r.row_id: len(r.flow_text) for r in out["supervised"].collect()}
    for tables in (out, again):
        assert {r.row_id: r.value for r in tables["features"].where("feature = 'text::emb_0'").collect()} == texts
    assert np.isfinite([r.y_pred for r in again["predictions"].collect()]).all()
