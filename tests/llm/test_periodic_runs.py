import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from benchlens.llm import periodic_runs as P
from benchlens.llm import queries


def plain_runs(w, least_length=6, least_exponent=4):
    """All maximal stretches by their smallest period, from the definition."""
    out, n = [], len(w)
    for q in range(1, n // least_exponent + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and w[e] == w[e - q]:
                e += 1
            if e - s >= max(least_length, least_exponent * q) and not any(all(w[i] == w[i + r] for i in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(out)


def test_against_the_definition():
    random.seed(3)
    found = 0
    for _ in range(1500):
        n, kinds = random.randint(0, 45), random.choice([1, 2, 2, 3])
        w = [random.randrange(kinds) for _ in range(n)]
        if random.random() < 0.6 and n:
            p = random.randint(1, 7)
            w = [w[i % p] if random.random() < 0.97 else w[i] for i in range(n)]
        got = P.find_runs(np.array(w, np.int64))
        assert got == plain_runs(w), w
        assert P.find_runs(np.array(w, np.int64), 2, 2) == plain_runs(w, 2, 2), w
        found += len(got)
    assert found > 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=8), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=10), st.integers(1, 9))
def test_repeated_blocks(block, times, tail, again):
    w = block * times + tail * again
    assert P.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_lcp_of_neighbours():
    rng = np.random.default_rng(1)
    for _ in range(50):
        w = np.tile(rng.integers(0, 3, rng.integers(1, 9)), 6)
        order, common = P.repeated_suffixes(w, 5)
        lists = [w[i:].tolist() for i in order]
        assert lists == sorted(lists)
        for a, b, c in zip(lists, lists[1:], common, strict=False):
            assert c == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_large_classes_of_one_prefix():
    rng = np.random.default_rng(2)
    line = np.arange(8)
    w = np.concatenate([np.concatenate([line, rng.integers(10, 400, rng.integers(1, 4))]) for _ in range(1500)])
    assert P.find_runs(w) == plain_runs_fast(w)


def plain_runs_fast(w):
    """The definition for periods up to 60 only, by numpy (longer ones do not occur in the test's words)."""
    out = []
    for q in range(1, 61):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            stretch = w[s : e + q]
            if len(stretch) >= max(6, 4 * q) and not any((stretch[r:] == stretch[:-r]).all() for r in range(1, q)):
                out.append((int(s), len(stretch), q))
    return sorted(out)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_plain_code(spark, tmp_path):
    random.seed(5)
    texts = {i: " ".join(random.choice(["a", "b", "c"]) for _ in range(random.randint(0, 60))) for i in range(200)}
    rows = [(i, t, "en") for i, t in texts.items()]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \t\n\x0b\f\r ", "x"), (1003, "    " * 9, "x"), (None, "go " * 9, "x"), (1004, "tie tie tie tie tie tie x " + "u v " * 5, "x")]
    rows += [(1005, "same row " * 8, "x")] * 2
    h = lambda i: zlib.crc32(str(i).encode())
    planted = next(i for i in range(2000, 9000) if h(i) % 10 == 0 and h(i) // 10 % 8 == 7)  # nine periods and more
    rows.append((planted, " ".join(f"w{k}" for k in range(90)), "x"))
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t)) for i, t, _ in rows)
    assert next(r for r in got if r.doc_id == planted).n_runs >= 1


def test_operator_keeps_columns_and_very_long_texts(spark):
    long = "lead " + "one two three " * 60000
    docs = spark.createDataFrame([(1, "x", 5, long), (2, "y", 6, None)], "doc_id long, runs string, N_words int, text string")
    out = P.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [tuple(x) for x in rows[1].runs] == [(1, 180000, 3)] and rows[1].collapsed == "lead one two three"
    assert rows[2].runs == [] and rows[2].collapsed == "" and rows[2].n_words == 0
    assert P.periodic_runs(docs.limit(0)).collect() == []


def test_exponents_below_two_are_refused():
    with pytest.raises(ValueError, match="twice"):
        P.find_runs(np.zeros(9, np.int64), 6, 1)
