import random
import re

import numpy as np

from benchlens.llm import quality_rules as R

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines), len(re.findall("[A-Z]", text)), len(re.findall("[!?]", text))


def test_counts_against_plain_code():
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice(["a", "b", " ", " ", "\n", "é", "#", "|", "X", "!", "\t", " ", "a b a b ", "\x0b"]) for _ in range(random.randint(0, 60)))
        assert R.counted(text.encode()) == plain_counts(text), repr(text)
    assert R.counted(b"") == (0,) * 8


def test_windows_of_other_widths():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 5, 6, 7, 8):
        for _ in range(30):
            ids = rng.integers(0, 2, rng.integers(0, 30))
            windows = [tuple(ids[i : i + width]) for i in range(len(ids) - width + 1)]
            assert R.repeated_words(ids, width) == len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(width)})


def bucket(v):
    shift = max(v.bit_length() - 7, 0)
    return v >> shift << shift


def test_sketches_merge_and_give_quantiles(spark):
    random.seed(4)
    rows = [(i, " ".join("w" * random.randint(1, 900) + str(k) for k in range(random.randint(8, 30))), random.choice(["a", None]), random.choice(["s", "t", None])) for i in range(400)]
    counts = R.measured(spark.createDataFrame(rows, SCHEMA).repartition(5))
    whole = R.sketch(counts)
    halves = R.merge(R.sketch(counts.where("doc_id % 2 = 0")).union(R.sketch(counts.where("doc_id % 2 = 1"))), R.KEYS)
    assert sorted(map(str, whole.collect())) == sorted(map(str, halves.collect()))
    values = {}
    for _, text, lang, source in rows:
        n, chars, *_ = plain_counts(text)
        if n >= 10:
            values.setdefault((lang, source), []).append(chars * 100 // n)
    got = {(r.lang, r.source): r for r in R.quartiles(whole, R.KEYS).where("measure = 'word_length'").collect()}
    assert got.keys() == values.keys()
    for key, v in values.items():
        v = sorted(v)
        assert got[key].total == len(v)
        for quarter, x in ((1, got[key].low), (3, got[key].high)):
            exact = v[-(-quarter * len(v) // 4) - 1]
            assert x == bucket(exact) and x <= exact <= x + x // 64 + 1


def test_cutoffs_follow_the_group(spark):
    plain_text = lambda i, k: " ".join(f"word{i}x{j}" for j in range(k))
    rows = [(i, plain_text(i, 40), "en", "news") for i in range(150)]
    # code has symbols everywhere: in its own source they are usual, in news they are not
    rows += [(1000 + i, " ".join(f"# a{i}b{j} |" for j in range(30)), "en", "code") for i in range(150)]
    rows += [(2000, " ".join(f"# odd{j} |" for j in range(30)), "en", "news"), (2001, " ".join(f"# odd{j} |" for j in range(30)), "en", "code")]
    got = {r.doc_id: r for r in R.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "symbols" in got[2000].failed and not got[2000].kept and got[2001].kept
    assert all(got[i].kept for i in [*range(150), *range(1000, 1150)])


def test_small_groups_use_wider_sketches(spark):
    counts = R.measured(spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20)), "en", "few" if i < 3 else "many") for i in range(130)] + [(900, "z " * 5, "fr", "none")], SCHEMA))
    rows = {(r.lang, r.source): r for r in R.cutoffs(R.sketch(counts)).collect()}
    assert set(rows) == {("en", "few"), ("en", "many")} and rows["en", "few"].symbols == rows["en", "many"].symbols


def test_salted_join_gives_the_same_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = R.measured(docs, keep=("doc_id", "lang", "source"))
    bounds = R.cutoffs(R.sketch(counts)).cache()
    one, two = (R.judged(counts, bounds, broadcast_groups=k) for k in (R.BROADCAST_GROUPS, 1))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))
    bounds.unpersist()


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, text, None, None), (3, text, None, None), (None, text, "en", None), (6, " ".join(f"{k:x}" for k in range(200_000)), "en", "s"), (7, "again and again and then " * 20, "en", "s")]
    docs = spark.createDataFrame([(*r, 0, True) for r in rows], SCHEMA + ", counts int, Kept boolean")
    got = sorted(map(tuple, R.judge(docs).select("doc_id", "n_words", "base_failed", "kept").collect()), key=str)
    assert got == sorted([(1, 0, True, False), (2, 0, True, False), (3, 30, False, True), (3, 30, False, True), (None, 30, False, True), (6, 200_000, False, True), (7, 100, True, False)], key=str)
    assert R.judge(docs.limit(0)).collect() == []
    kept = R.kept_documents(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "6", "None"]


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = R.judge(docs).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1
