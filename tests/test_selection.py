"""Exact medians by narrowing intervals, and group folds dealt by sizes."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest

from benchlens.operators import folds, selection


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(0)
    n = 30001
    return {
        "normal": rng.normal(size=n),
        "constant": np.full(n, 3.0),
        "skewed": np.exp(rng.normal(size=n) * 50),
        "ties": rng.integers(0, 3, n).astype(float),
        "infinite": np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n)),
        "halves": np.where(np.arange(n) < n // 2, -1e300, 1e300),
    }


@pytest.mark.parametrize("rows", [30001, 30000, 2, 1])
def test_medians(spark, columns, rows):
    part = {c: v[-rows:] for c, v in columns.items()}
    got = selection.medians(spark.createDataFrame(pd.DataFrame(part)).repartition(5), list(part))
    assert got == {c: 0.5 * np.sort(v)[(rows - 1) // 2] + 0.5 * np.sort(v)[rows // 2] for c, v in part.items()}


def test_any_rank_with_a_poor_sketch(spark, columns, monkeypatch):
    """What is counted decides: a sketch of hardly any accuracy costs passes, not results."""
    monkeypatch.setattr(selection, "ACCURACY", 40)
    monkeypatch.setattr(selection, "FEW", 500)
    monkeypatch.setattr(selection, "AT_ONCE", 2)
    part = {c: columns[c][:4000] for c in ("normal", "skewed", "ties")}
    df = spark.createDataFrame(pd.DataFrame(part)).repartition(3).cache()
    ranks = {"normal": [0, 3999], "skewed": [1999], "ties": [1300]}
    got = selection.order_statistics(df, ranks, dict.fromkeys(part, 4000))
    assert got == {c: [float(np.sort(part[c])[r]) for r in wanted] for c, wanted in ranks.items()}
    df.unpersist()


def test_nulls_and_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert selection.medians(df, ["a", "b"]) == {"a": 2.5, "b": None}
    assert selection.medians(df.limit(0), ["a"]) == {"a": None}


def greedy(sizes, k):
    heap, out = [(0, f) for f in range(k)], []
    for s, count in sizes:
        for r in range(count):
            load, f = heap[0]
            heapq.heapreplace(heap, (load + s, f))
            out.append((s, r, f))
    return out


def test_dealing_by_sizes_is_greedy_dealing():
    random.seed(0)
    for _ in range(1500):
        k = random.randint(1, 6)
        sizes = [(s, random.randint(1, 25)) for s in sorted(random.sample(range(30), random.randint(1, 8)), reverse=True)]
        steps = {}
        for s, begin, turns in folds.deal_sizes(iter(sizes), k):
            steps.setdefault(s, []).append((begin, turns))
        got = []
        for s, count in sizes:
            for r in range(count):
                begin, turns = [x for x in steps[s] if x[0] <= r][-1]
                got.append((s, r, turns[(r - begin) % len(turns)]))
        assert got == greedy(sizes, k), (sizes, k)
        assert all(len(v) <= k for v in steps.values())


def test_billions_of_equal_groups_are_a_few_stretches():
    steps = list(folds.deal_sizes(iter([(10**9, 3), (7, 10**12), (1, 10**12)]), 5))
    assert len(steps) <= 15 and steps[-1][0] == 1


def test_rank_within_groups_over_many_ranges(spark):
    rows = [(i % 2 if i < 900 else 7, i * 37 % 1000) for i in range(1000)]
    got = {(r.g, r.v): r["rank"] for r in folds.rank_within(spark.createDataFrame(rows, "g long, v long").repartition(6), ["g"], ["v"]).collect()}
    for g in (0, 1, 7):
        own = sorted(v for h, v in rows if h == g)
        assert [got[g, v] for v in own] == list(range(len(own)))
