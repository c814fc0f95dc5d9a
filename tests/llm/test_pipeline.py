import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from benchlens.llm import decontamination as D
from benchlens.llm import merge_dropout as M
from benchlens.llm import near_dedup as N
from benchlens.llm import quality as Q
from test_near_dedup import brute as classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_run_against_brute_force(spark, tables):
    """Classifier scores as tested on their own; every later stage by plain code."""
    good = {r.doc_id for r in Q.classify(tables["documents"], tables["labels"]).collect() if r.score >= 0.5}
    docs = sorted((r.doc_id, r.text) for r in tables["documents"].collect() if r.doc_id in good)
    first = {d for d, c in classes(docs) if d == c}
    kept = [(d, t) for d, t in docs if d in first]
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    want = {}
    for d, t in kept:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        lower = [t[a:b].lower() if t[a:b].isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t[a:b]) for a, b in spans]
        hit = set()
        for _, text in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            for k in range(max(1, len(w) - 9) if w else 0):
                key = w[k : k + 10]
                hit |= {x for a in range(len(lower) - len(key) + 1) if lower[a : a + len(key)] == key for x in range(a, a + len(key))}
        out, end = "", 0
        for a in sorted(hit):
            if a - 1 not in hit:
                out += t[end : spans[a][0]]
            end = spans[a][1]
        want[d] = out + t[end:]
    rows = C.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    vocabulary = M.vocabulary(M.MODEL)
    assert all(M.decode(r.piece_ids, vocabulary) == r.text and r.n_chars == len(r.text) for r in rows)
    assert len(first) < len(good) < 200 and any(want[d] != t for d, t in kept)


def test_stage_contract():
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "near_dedup", "benchmark_decontamination", "merge_dropout_encoding"]


def test_stages_keep_columns_and_rows(spark, tables):
    docs = tables["documents"]
    extra = spark.createDataFrame([(100_000, None, "en", None, None), (100_001, "", "en", "s", 0), (None, "no id here", None, "s", 10)], docs.schema)
    extra = docs.limit(50).union(extra).union(docs.limit(3))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.collect()]
        assert {100_000, 100_001, None} <= set(ids)
        assert stage(spark, extra.limit(0), SF).count() == 0
    kept = [r.doc_id for r in N.keep_first(extra).collect()]
    assert len(kept) == len(set(kept))
    assert D.find_contamination(extra, tables["benchmark"]).count() == extra.count()


def test_stages_keep_clashing_columns_and_need_no_n_chars(spark, tables):
    docs = tables["documents"].limit(30).select("doc_id", "text").withColumns({"spans": F.lit(1), "item_ids": F.lit("x"), "N_words": F.lit(2), "score": F.lit(3), "slot": F.lit(4), "hit": F.lit(5), "node": F.lit(6), "before": F.lit(7)})
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r)[2:] for r in out.collect()} == {(1, "x", 2, 3, 4, 5, 6, 7)}
    assert C.encode(spark, docs, SF).columns == [*docs.columns, "piece_ids"]


def test_very_long_texts_and_ids_with_two_texts_pass_all_stages(spark, tables):
    """Every stage in turn: a text of half a million characters stays whole, both texts of one id stay apart."""
    good = [r.text for r in tables["documents"].join(tables["labels"].where("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    words = [w for t in good for w in t.split()]
    long = " ".join(words[(k * 7919) % len(words)] for k in range(100_000))
    docs = spark.createDataFrame([(7_000_001, long, "en", "s", len(long)), (7_000_002, good[0], "en", "s", len(good[0])), (7_000_002, good[1], "en", "s", len(good[1]))], tables["documents"].schema)
    docs = docs.union(tables["documents"].where(~F.col("text").isin(good[:2])).limit(60))
    for _, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF))
    rows = docs.where("doc_id > 7000000").orderBy("doc_id", "text").collect()
    assert [r.doc_id for r in rows] == [7_000_001, 7_000_002, 7_000_002]
    assert len(rows[0].text) > 400_000 and {r.text for r in rows[1:]} == set(good[:2])
    vocabulary = M.vocabulary(M.MODEL)
    assert all(M.decode(r.piece_ids, vocabulary) == r.text for r in rows)
