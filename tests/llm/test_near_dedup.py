import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from benchlens.llm import near_dedup as N
from benchlens.llm.common import utf8


def bag(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(docs):
    bags = [bag(t) if t is not None else None for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bags[i] is None or bags[j] is None or docs[i][0] is None or docs[j][0] is None:
                continue
            if (docs[i][1] == docs[j][1]) if not (bags[i] and bags[j]) else jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        out.append((d, d if bags[i] is None or d is None else min(docs[j][0] for j in range(len(docs)) if bags[j] is not None and docs[j][0] is not None and find(j) == find(i))))
    return sorted(out, key=str)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["été", "Ü1"]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        if rng.random() < 0.3:
            base = base * 3
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            own = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            docs.append((len(docs) + 1, " ".join(own)))
    docs += [(9001, None), (9002, ""), (9003, ""), (9004, "..."), (9005, None), (None, docs[0][1]), (9006, docs[3][1]), (9006, docs[3][1])]
    rng.shuffle(docs)
    return docs


def test_classes_against_brute_force(spark):
    docs = corpus(5)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, node string, id int").repartition(5)
    got = sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(frame).collect()), key=str)
    assert got == brute(docs)


def test_hot_group_in_small_chunks(spark, monkeypatch):
    """A bucket of many copies that are not all similar to each other is checked in several blocks."""
    monkeypatch.setattr(N, "CHUNK", 7)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = [(i, " ".join(f"x{rng.randrange(99)}" if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    got = sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_weighted_jaccard():
    a = " ".join(f"a{i % 7} b{i % 5} c d e" for i in range(60)) + " " + " ".join(f"u{i}" for i in range(300))
    b = " ".join(f"a{i % 7} b{i % 5} c d e" for i in range(40)) + " " + " ".join(f"u{i}" for i in range(260))
    raw, offsets = utf8(pa.array([a, b, ""]))
    packed, bounds = N.shingles(raw, offsets)
    got = N.signatures(packed, bounds, 4096)
    want = jaccard(bag(a), bag(b))
    assert abs((got[0] == got[1]).mean() - want) < 0.03
    assert (got[2] == 0).all()
    x, y = (N._tokens(packed[bounds[i] : bounds[i + 1]]) for i in (0, 1))
    common = N.overlap(x, y)
    assert np.isclose(common / (len(x) + len(y) - common), want)


def test_blocks_of_long_texts_are_compared_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    tokens = [np.sort(np.where(rng.random(300) < 0.05, rng.integers(0, 1 << 40, 300), base).astype(np.uint64)) for _ in range(20)]
    comps = [bytes([i]) for i in range(20)]
    left, right = np.arange(10), np.arange(10, 20)
    whole = set(N._block_links(comps, tokens, left, right, 0.8))
    monkeypatch.setattr(N, "MOST_TOKENS", 1500)
    parts = N._block_links(comps, tokens, left, right, 0.8)
    joined = lambda links: {frozenset((min(a, b), max(a, b))) for a, b in links}

    def classes(links):
        root = list(range(20))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in map(sorted, links):
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(20)]

    assert classes(joined(parts)) == classes(joined(whole))


def kept(rows):
    """What ``keep_first`` keeps, by plain code: (id, text) of the first row of each class."""
    texts = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=str)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for _, t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i][1] == texts[j][1]) if not (bags[i] and bags[j]) else jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(texts):
        groups.setdefault(find(i), []).append(row)
    return groups.values()


def test_keep_first_loses_no_text(spark):
    """Ids with several texts: every class keeps exactly one row, one with its least id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (5, b + " tail"), (7, c), (7, d), (7, d), (8, d), (9, None), (9, None), (None, a), (10, ""), (11, "")]
    frame = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node int, slot int").repartition(3)
    out = N.keep_first(frame)
    assert out.columns == frame.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (7, c), (7, d), (9, None), (9, None), (None, a), (10, "")], key=str)
    full = [x for x in got if x[0] is not None and x[1] is not None]
    for group in kept(rows):
        assert len([x for x in full if x in group]) == 1 and min(i for i, _ in group) in [i for i, _ in full if (i, _) in group]


def test_keep_first_on_random_repeats(spark):
    docs = corpus(11, 12)
    rng = random.Random(2)
    ids = [d for d, _ in docs if d is not None]
    rows = [(rng.choice(ids) if rng.random() < 0.3 and d is not None else d, t) for d, t in docs] + docs[:5]
    got = [(r.doc_id, r.text) for r in N.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted((x for x in got if None in x), key=str) == sorted((x for x in rows if None in x), key=str)
    full = [x for x in got if None not in x]
    groups = list(kept(rows))
    assert len(full) == len(groups)
    for group in groups:
        assert [i for i, t in full if (i, t) in group] == [min(i for i, _ in group)]


def test_one_very_long_text(spark):
    """A text of 200,000 words and a copy with a few words changed are one class; a half of it is none."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(9000)}" for _ in range(200_000)]
    other = [w if i % 50_000 else "changed" for i, w in enumerate(long)]
    docs = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:100_000]))]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
