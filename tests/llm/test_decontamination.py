import hashlib
import re

import numpy as np
import pytest

from benchlens.llm import decontamination as D

SCHEMA = "doc_id long, text string, n_words string, extra int"


def brute(docs, items, window=D.WINDOW):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[a : a + window]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for key, own in owners.items():
            for a in range(len(w) - len(key) + 1):
                if tuple(w[a : a + len(key)]) == key:
                    hit |= set(range(a, a + len(key)))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


TEXT = "One two three, four five six seven eight nine ten eleven twelve"
ITEMS = [(1, TEXT), (2, "short Item"), (3, None), (4, ""), (5, "..."), (2, "short item"), (None, "été Été\nx1"), (10, "aa aa aa")]
DOCS = [(1, "zz " + TEXT.upper() + " short item."), (2, None), (3, ""), (4, "one two three four five six seven eight nine"), (5, "aa aa aa aa aa aa x aa"), (5, "aa aa aa aa aa aa x aa"), (None, "Short-item été Été x1"), (7, "two three four five six seven eight nine ten eleven " * 3), (8, "word " * 5000 + TEXT)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in DOCS], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.digest(D.find_contamination(docs, items, block_bytes=block_bytes)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(DOCS, ITEMS)))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_spans_are_cut(spark, block_bytes):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in DOCS], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.text for r in D.remove_contamination(docs, items, block_bytes=block_bytes).collect()}
    assert got[1] == "zz ." and got[2] is None and got[4] == DOCS[3][1] and got[None] == ""


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(docs, items).collect() == []
    full = spark.createDataFrame([(1, "a b", "c", 1)], SCHEMA)
    assert D.digest(D.find_contamination(full, items)).first().n_words == 2


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 3000)
    index = D.FMIndex(text, 5, sample=7)
    patterns = rng.integers(1, 5, (50, 4))
    low, high = index.search(patterns, np.full(50, 4))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(2997) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
