import random
import re
import zlib
from collections import Counter, namedtuple

import numpy as np
import pyarrow as pa

from benchlens.llm import quality as Q
from benchlens.llm.common import utf8, words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    test = got[got.held_out]
    assert (test.predicted == test.quality).mean() > 0.9
    good, bad = test.score[test.quality == 1].to_numpy(), test.score[test.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_vote_against_brute_force():
    rng = np.random.default_rng(0)
    model = {"vectors": Q._unit(rng.standard_normal((40, 8))), "labels": rng.integers(0, 2, 40).astype(np.float32)}
    model["vectors"][7] = model["vectors"][8]
    x = Q._unit(rng.standard_normal((30, 8)))
    for row, got in zip(x, Q.vote(x, model, 5), strict=True):
        similar = np.maximum(model["vectors"] @ row, 0)
        least = sorted(similar)[-5]
        weight = [s**Q.SHARPNESS if s >= least else 0 for s in similar]
        assert np.isclose(got, np.dot(weight, model["labels"]) / sum(weight))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "abc def", 9.0), (4, "abc " * 50000, 9.0), (5, "GOOD text", 1.0), (5, "GOOD text", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (4, 0, 0), (None, 1, 1), (77, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.score for r in Q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(docs.limit(0), labels).collect() == []


def some_texts():
    rng = random.Random(3)
    alphabet = "abcXYZ 012 .,!?\n<>é*|'(" + " " * 6
    return ["", "a", "ab", *["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(40)], "again and again and again and again " * 9]


def test_term_counts_against_plain_counting():
    texts = some_texts()
    raw, offsets = utf8(pa.array(texts))
    got = Q.term_counts(raw, offsets)
    kind = {**{c: 1 for c in b"abcdefghijklmnopqrstuvwxyz"}, **{c: 2 for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 3 for c in b"0123456789"}, 0x20: 5, 0x0A: 6}
    for k, chars in enumerate((b".", b",;:", b"!", b"?", b"*#$%&", b"|", b"<>/\\", b"'\"`", b"()[]{}")):
        kind |= {c: 7 + k for c in chars}
    for text, row in zip(texts, got, strict=True):
        said = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        place = lambda w: int(words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] % Q.WORD_TERMS)
        want = Counter(place(w) for w in said)
        assert {i: int(v) for i, v in enumerate(row[: Q.WORD_TERMS]) if v} == want
        c = [4 if b >= 0x80 else kind.get(b, 0) for b in text.encode()]
        shapes = Counter(x << 8 | y << 4 | z for x, y, z in zip(c, c[1:], c[2:]))
        assert {i: int(v) for i, v in enumerate(row[Q.WORD_TERMS : Q.WORD_TERMS + Q.SHAPE_TERMS]) if v} == shapes
        tail = row[Q.WORD_TERMS + Q.SHAPE_TERMS :]
        if len(said) <= Q.LAGS:
            assert not tail.any()
        else:
            again = max(sum(a == b for a, b in zip(said[lag:], said)) for lag in range(1, Q.LAGS + 1)) / len(said)
            assert tail.sum() == 1 and tail[max(i for i, least in enumerate(Q.REPEATED) if again >= least)] == 1


def test_fit_against_a_full_decomposition():
    """At full rank latent products are those of the weighted terms; at a low one they keep the exact SVD's energy."""
    texts = some_texts()
    counts = Q.term_counts(*utf8(pa.array(texts)))
    Row = namedtuple("Row", "label terms counts")
    rows = [Row(i % 2, np.flatnonzero(x).astype(np.uint16).tobytes(), x[np.flatnonzero(x)].tobytes()) for i, x in enumerate(counts)]
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    x = Q._weighted(counts, idf.astype(np.float32)).astype(np.float64)
    whole = Q._fit(rows, len(texts))
    assert np.allclose(whole["idf"], idf, rtol=1e-5) and (whole["labels"] == [r.label for r in rows]).all()
    latent = x @ whole["projection"]
    assert np.abs(latent @ latent.T - x @ x.T).max() < 1e-3 * np.abs(x @ x.T).max()
    singular = np.linalg.svd(x, compute_uv=False)
    for rank in (4, 12):
        kept = ((x @ Q._fit(rows, rank)["projection"]) ** 2).sum()
        assert 0.97 * (singular[:rank] ** 2).sum() < kept <= (1 + 1e-4) * (singular[:rank] ** 2).sum()


def test_several_texts_of_an_id_teach_alike_in_any_order(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150"), spark.read.parquet(f"{SF}/labels.parquet")
    other = docs.selectExpr("doc_id", "reverse(text) as text")
    twice = docs.select("doc_id", "text").union(other)
    one, two = (sorted(map(tuple, Q.classify(rows, labels).collect())) for rows in (twice.coalesce(1), other.union(docs.select("doc_id", "text")).repartition(7)))
    assert [r[0] for r in one] == [r[0] for r in two]
    assert np.allclose([r[2] for r in one], [r[2] for r in two], atol=1e-6)  # rounding in single precision differs with the blocks of rows
