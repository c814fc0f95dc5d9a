from fractions import Fraction

import numpy as np
import pyarrow as pa

from benchlens.llm import whitening as Wh

SF = "/root/testdata/sf0.01"


def plain(vectors):
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, values[::-1], axes[:, ::-1]


def test_query_against_a_plain_eigensolver(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, values, axes = plain([r.embedding for r in rows])
    n, total = len(x), x.sum(0)
    got = Wh.whiten(df).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    w = got.whitened.to_numpy().reshape(n, 32)
    want = (x - x.mean(0)) @ axes[:, :32] / np.sqrt(values[:32])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w - sign * want).max() < 1e-8
    assert np.allclose(got.explained.to_numpy()[:32], values[:32] / values.sum(), rtol=1e-10)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, total, strict=True)) for r in x]
    assert got.deviation.to_numpy()[::32].tolist() == exact


def test_factor_and_rotations():
    rng = np.random.default_rng(0)
    for d, rank in [(1, 1), (5, 5), (8, 3), (33, 20)]:
        root = rng.standard_normal((d, rank)) * np.logspace(0, -4, rank)
        v = root @ root.T
        factor = Wh.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, rtol=1e-9, atol=1e-12 * np.trace(v))
        turned = Wh.one_sided_jacobi(factor)
        gram = turned.T @ turned
        norms = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        assert np.abs(gram / np.outer(norms, norms) - np.diag(np.diag(gram) / norms**2))[:rank, :rank].max() < 1e-12
        assert np.allclose(np.sort(np.diag(gram))[::-1][:rank], np.linalg.svd(root, compute_uv=False) ** 2, rtol=1e-9)


def test_small_eigenvalues_of_graded_scales_are_accurate():
    scale = np.diag([1e8, 1.0, 1e-8])
    inner = np.array([[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]])
    turned = Wh.one_sided_jacobi(Wh.pivoted_cholesky(scale @ inner @ scale))
    least = np.sort((turned * turned).sum(0))[0]
    exact = np.linalg.det(inner) / np.linalg.det(inner[:2, :2]) * 1e-16  # Schur complement; what the rest adds is 1e-16 of it
    assert abs(least / exact - 1) < 1e-10


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [3.0, -1.0, 0.5]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 2.0]), (7, [inf, 0.0, 0.0]), (8, [-2.5, 0.1, 0.5]), (9, [4.0]), (10, [])]
    df = spark.createDataFrame([(*r, 0.0, "z") for r in rows], "vec_id long, embedding array<float>, whitened double, n string").repartition(4)
    got = Wh.whiten(df).collect()
    held = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.array([np.floor(64 * np.array([*r[1], 0, 0, 0][:3], np.float32).astype(float)) + 1_000_000 for r in held])
    n, total = len(x), x.sum(0)
    assert n == 6 and {r.n for r in got} == {6} and len(got) == 18
    for r, row in zip(held, x, strict=True):
        want = sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True))
        assert {g.deviation for g in got if g.vec_id == r[0]} == {want}
    shares = {g.component: g.explained for g in got}
    assert np.allclose(sorted(shares.values(), reverse=True), plain_shares(x)) and abs(sum(shares.values()) - 1) < 1e-12
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for empty in (same, same.limit(1), same.limit(0), same.where("vec_id = 1").selectExpr("vec_id", "cast(null as array<float>) as embedding")):
        assert Wh.whiten(empty).collect() == []


def plain_shares(x):
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    return values / values.sum()


def test_lower_rank_has_fewer_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(b), float(a + b), 7.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    got = Wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error.iloc[0] < 1e-10 and abs(got[got.vec_id == 0].explained.sum() - 1) < 1e-12


def test_huge_entries_stay_exact():
    block = np.array([[1 << 40, -3], [5, 1 << 41]], np.int64)
    middle = Wh.Centre(1 << 30, (int(block[:, 0].sum()), int(block[:, 1].sum())))
    got = middle.deviations(block)
    assert [[int(x) for x in r] for r in got] == [[int(c) * middle.n - s for c, s in zip(r, middle.sums, strict=True)] for r in block]
    assert Wh._squares(got) == [None, None] and Wh._squares(np.array([[3, -4]])) == [25]
    assert float(middle.centred(block)[0, 0]) == float(Fraction(int(got[0, 0]), middle.n))


def test_lists_in_slices_of_a_column():
    column = pa.array([[1.0, 2.0], None, [3.0, None], [4.0, 5.0], []], pa.list_(pa.float32())).slice(1)
    keep, lengths, ends, whole = Wh.whole_entries(column)
    assert keep.tolist() == [False, False, True, True] and lengths.tolist() == [2, 0] and ends.tolist() == [0, 2, 2] and whole.tolist() == [256, 320]
