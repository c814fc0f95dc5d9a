import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from benchlens.llm import token_rollup as R

SCHEMA = "doc_id long, text string, lang string, source string, version string, docs int"


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(300):
        text = rng.choice([None, "", "same  text ", "tab\tbed line \n x", "".join(rng.choice("ab é\n  1!") for _ in range(rng.randrange(80)))])
        rows.append((i if i % 50 else None, text, rng.choice(["en", None]), rng.choice(["hot", "hot", "s2", None]), "clash", 7))
    return [*rows, rows[5], rows[5], (999, "long " * 40_000, "en", "s2", "", 0)]


def brute(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None and t is not None:
            least[t] = min(d, least.get(t, d))
    total = defaultdict(lambda: [0, 0])
    for d, t, lang, source, *_ in rows:
        if d is not None and t is not None and d != least[t]:
            continue
        for v in R.VERSIONS:
            own = total[source, lang, v]
            own[0] += 1
            own[1] += len(R.encoding(v).encode_ordinary(R.tidy(t or "")))
    return {k: tuple(v) for k, v in total.items()}


def test_totals_against_brute_force(spark):
    rows = corpus()
    got = R.roll_up(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in got} == brute(rows)
    assert R.roll_up(spark.createDataFrame([], SCHEMA)).collect() == []


def test_commits(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.committed() == [] and rollup.totals().collect() == []
    rows = spark.createDataFrame([("s", "en", 3), ("s", "en", 4), ("t", None, 5)], "source string, lang string, n long")
    assert rollup.commit("1", R.change(rows, "v", F.col("n"), 1))
    assert not rollup.commit("1", R.change(rows, "v", F.col("n"), 1))
    assert rollup.commit("2", R.revision(rows, "v", F.col("n"), F.when(F.col("n") == 3, 10).otherwise(F.col("n"))))
    assert rollup.commit("3", R.change(rows.where("source = 't'"), "v", F.col("n"), -1))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 2, 14)]
    # A batch that failed has no mark: it doesn't count, and its id can be committed.
    R.change(rows, "v", F.col("n"), 1).write.parquet(f"file://{tmp_path}/r/batch-4")
    (tmp_path / "r/batch-4/_SUCCESS").unlink()
    assert rollup.committed() == ["batch-1", "batch-2", "batch-3"]
    assert rollup.commit("4", R.change(rows.limit(0), "v", F.col("n"), 1)) and len(rollup.committed()) == 4
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)


def test_compaction(spark, tmp_path):
    """A base gives the totals of its batches, later batches add to it, and a failed base counts for nothing."""
    rollup = R.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("s", "en", 3), ("t", None, 5)], "source string, lang string, n long")
    read = lambda: sorted(map(str, map(tuple, rollup.totals().collect())))
    rollup.commit("1", R.change(rows, "v", F.col("n"), 1))
    rollup.commit("2", R.change(rows, "v", F.col("n"), 1))
    before = read()
    rollup.compact()
    assert read() == before
    for part in (tmp_path / "r").glob("batch-*/part-*"):  # the base alone holds them now
        part.unlink()
    for crc in (tmp_path / "r").glob("batch-*/.part-*"):
        crc.unlink()
    assert read() == before
    assert not rollup.commit("2", R.change(rows, "v", F.col("n"), 1)) and read() == before
    rollup.commit("3", R.change(rows.where("source = 't'"), "v", F.col("n"), -1))
    later = read()
    assert later != before
    rollup.compact()
    assert read() == later
    (tmp_path / "r/base-00000003/sums").mkdir(parents=True)
    assert read() == later
    rollup.compact()
    assert read() == later and (tmp_path / "r/base-00000003/ids/_SUCCESS").exists()


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    """Both looked before either wrote: the second commits nothing and replaces nothing."""
    rollup = R.Rollup(spark, f"file://{tmp_path}/two")
    batch = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], R.CHANGES)
    monkeypatch.setattr(R.Rollup, "is_committed", lambda self, name: False)
    assert rollup.commit("b", batch(10)) and not rollup.commit("b", batch(99))
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(1, 10)]


def test_a_commit_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    rollup = R.Rollup(spark, f"file://{tmp_path}/busy")
    batch = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], R.CHANGES)
    rollup.commit("a", batch(10))
    real = R.Rollup.committed

    def late(self):
        names = real(self)
        if "batch-late" not in names:
            rollup.commit("late", batch(5))  # right after the batches were listed
        return names

    monkeypatch.setattr(R.Rollup, "committed", late)
    rollup.compact()
    monkeypatch.setattr(R.Rollup, "committed", real)
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(2, 15)]
    rollup.compact()
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(2, 15)]
