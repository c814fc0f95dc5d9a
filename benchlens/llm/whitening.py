"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers first, so counts, sums and deviations are exact.  Partitions sum outer
products of centred vectors; the partial matrices meet in two steps by matrix row, and only the d x d sum
reaches the driver.  There the scatter is factored as P'VP = LL' with pivoting, and plane rotations make
the columns of L orthogonal: their squared norms are the eigenvalues of V, the columns divided by their
norms its eigenvectors.  Working on L instead of V keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlens.llm.common import releasing

MOST_COMPONENTS = 32
#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this count as this (no whole number there has a neighbour in double precision).
MOST = 1 << 52
#: Partial matrices of one row number meet in so many tasks before they meet in one.
FAN_IN = 32
_ROWS_AT_ONCE = 4096
_PARTIAL = "at int, part int, cells binary"


def whole_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors remain, their lengths, the offsets of the remaining ones and their entries less ``OFFSET``.

    A vector remains if it is not null and holds neither null nor non-finite entries.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()  # entries of null vectors are left out
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN
    ends = np.concatenate([[0], np.cumsum(lengths)])
    good = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (good[ends[1:]] == good[ends[:-1]]) if n else np.zeros(0, bool)
    inside = np.repeat(keep, lengths)
    whole = np.clip(np.floor(SCALE * values[inside]), -MOST, MOST).astype(np.int64)
    lengths = lengths[keep]
    return keep, lengths, np.concatenate([[0], np.cumsum(lengths)]), whole


def _matrices(column: pa.Array, d: int, most: int = _ROWS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and entries less ``OFFSET`` (rows x d) of the remaining vectors, a block of rows at a time."""
    keep, lengths, ends, whole = whole_entries(column)
    rows = np.flatnonzero(keep)
    for a in range(0, len(rows), most):
        b = min(a + most, len(rows))
        if (lengths[a:b] == d).all():
            block = whole[ends[a] : ends[b]].reshape(b - a, d)
        else:
            block = np.zeros((b - a, d), np.int64)
            block[np.arange(d) < lengths[a:b, None]] = whole[ends[a] : ends[b]]
        yield rows[a:b], block


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, total) of a partition; dim -1 counts all remaining vectors."""
    n, totals = 0, np.zeros(0, object)
    for batch in batches:
        _, lengths, ends, whole = whole_entries(batch.column(0))
        n += len(lengths)
        if len(whole):
            place = np.arange(len(whole)) - np.repeat(ends[:-1], lengths)
            new = np.zeros(max(place.max() + 1, len(totals)), object)
            new[: len(totals)] = totals
            # sums of halves of 26 bits are exact in double precision
            low, high = np.bincount(place, whole & ((1 << 26) - 1)), np.bincount(place, whole >> 26)
            new[: len(low)] += np.array([int(h) * (1 << 26) + int(m) for h, m in zip(high, low, strict=True)], object)
            totals = new
    dims, counts = [-1, *range(len(totals))], [n, *[0] * len(totals)]
    yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(counts, pa.int64()), pa.array(["0", *map(str, totals)])], names=["dim", "n", "total"])


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums of their entries less ``OFFSET``."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, block: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where that holds it, Python integers beyond."""
        most = max([abs(int(block.max(initial=0))), abs(int(block.min(initial=0)))]) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 63:
            return block * self.n - np.array(self.sums, np.int64)
        return block.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, block: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return self.deviations(block).astype(np.float64) / self.n


def centre(vectors: DataFrame) -> Centre:
    """Counts and sums over all vectors (a single column)."""
    found = vectors.mapInArrow(_sums, "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    rows = {r.dim: r for r in found.collect()}  # one row a dimension
    return Centre(rows[-1].n if -1 in rows else 0, tuple(int(rows[k].total) for k in range(len(rows) - 1)))


def _row(at: int, part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["at", "part", "cells"])


def _partial(matrix: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if matrix is not None:
        part = TaskContext.get().partitionId() % FAN_IN
        for at, row in enumerate(matrix):
            yield _row(at, part, row)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of equal (at, part) summed: a partition holds one array for each."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for at, part, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = np.frombuffer(cells, np.float64)
            if (at, part) in sums:
                sums[at, part] += row
            else:
                sums[at, part] = row.copy()
    for (at, part), row in sums.items():
        yield _row(at, part, row)


def _summed(partials: DataFrame) -> np.ndarray:
    """The sum of all partitions' matrices; its rows meet by (row, part), then by row."""
    some = partials.repartition("at", "part").mapInArrow(_merged, _PARTIAL)
    rows = some.withColumn("part", F.lit(0)).repartition("at").mapInArrow(_merged, _PARTIAL).collect()  # one row a dimension
    return np.array([np.frombuffer(r.cells, np.float64) for r in sorted(rows, key=lambda r: r.at)])


def covariance(vectors: DataFrame, middle: Centre) -> np.ndarray:
    """Covariance (divisor n) of the whole entries, centred before multiplying."""
    d = len(middle.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in releasing(batches):
            for _, block in _matrices(batch.column(0), d):
                z = middle.centred(block)
                total = z.T @ z if total is None else total + z.T @ z
        yield from _partial(total)

    return _summed(vectors.mapInArrow(partial, _PARTIAL)) / middle.n if middle.n and d else np.zeros((d, d))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank) with V = LL', columns in the order of the pivots, rows in that of V.

    A dimension is left over once its remaining variance is rounding noise of its own variance; the factor
    ends when all are.
    """
    d = len(v)
    rest, factor, left = np.diag(v).copy(), np.zeros((d, d)), np.ones(d, bool)
    noise = 64 * d * np.finfo(float).eps * rest
    for k in range(d):
        able = np.where(left & (rest > noise), rest, 0)
        p = int(np.argmax(able))
        if able[p] <= 0:
            return factor[:, :k]
        left[p] = False
        factor[p, k] = np.sqrt(rest[p])
        factor[left, k] = (v[left, p] - factor[left, :k] @ factor[p, :k]) / factor[p, k]
        rest = rest - factor[:, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor``, rotated until they are orthogonal; disjoint pairs of columns turn at once."""
    d, r = factor.shape
    a = np.zeros((d, r + r % 2))
    a[:, :r] = factor
    players = np.arange(a.shape[1])
    half, least = len(players) // 2, np.finfo(float).eps * np.sqrt(max(d, 1))
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(players) - 1):
            p, q = players[:half], players[half:][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > least * np.sqrt(xx * yy)
            if on.any():
                turned = True
                p, q, x, y, xx, yy, xy = p[on], q[on], x[:, on], y[:, on], xx[on], yy[on], xy[on]
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if not turned:
            break
    return a[:, :r]


@dataclass(frozen=True)
class Whitening:
    """Centre, eigenvalues (falling, the first ones), unit eigenvectors as columns, and the covariance's trace."""

    middle: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, block: np.ndarray) -> np.ndarray:
        return (self.middle.centred(block) @ self.vectors) / np.sqrt(self.values)


def fit(vectors: DataFrame, most: int = MOST_COMPONENTS) -> Whitening:
    """The first ``most`` components of a single column of vectors.

    Fewer where the covariance has a lower rank.  Of each component the entry largest in size is positive.
    """
    middle = centre(vectors)
    v = covariance(vectors, middle)
    turned = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    by = by[norms[by] > 0][:most]
    components = turned[:, by] / norms[by]
    if len(by):
        components = components * np.where(components[np.abs(components).argmax(0), np.arange(len(by))] < 0, -1.0, 1.0)
    return Whitening(middle, norms[by] ** 2, components, float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance, measured over all of them, less the identity."""
    d, k = model.vectors.shape
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in releasing(batches):
            for _, block in _matrices(batch.column(0), d):
                w = np.column_stack([model.whitened(block), np.ones(len(block))])
                total = w.T @ w if total is None else total + w.T @ w
        yield from _partial(total)

    moments = _summed(vectors.mapInArrow(partial, _PARTIAL)) / model.middle.n
    mean = moments[k, :k]  # zero but for rounding, as vectors are centred before they are projected
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where a 64-bit integer cannot hold one."""
    largest = max(abs(int(deviations.max(initial=0))), abs(int(deviations.min(initial=0))))
    if largest * largest * max(deviations.shape[1], 1) < 1 << 63:
        return (deviations.astype(np.int64) ** 2).sum(1).tolist()
    exact = [sum(int(x) * int(x) for x in row) for row in deviations]
    return [x if x < 1 << 63 else None for x in exact]


def transform(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The remaining rows of ``df`` with ``deviation`` and ``whitened`` (an array of doubles) in place of the vector.

    Other columns stay, save those of the two names, which are replaced.
    """
    kept = [c for c in df.columns if c != vector and c.lower() not in ("deviation", "whitened")]
    d, k = model.vectors.shape
    narrow = df.select(*[F.col(f"`{c}`") for c in kept], F.col(vector).alias("__vector"))
    schema = narrow.select(*kept, F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in releasing(batches):
            for at, block in _matrices(batch.column(len(kept)), d):
                w = np.ascontiguousarray(model.whitened(block))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(w.reshape(-1), pa.float64()))
                columns = [batch.column(c).take(pa.array(at)) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_squares(model.middle.deviations(block)), pa.int64()), lists], names=[*kept, "deviation", "whitened"])

    return narrow.mapInArrow(rows, schema)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """One row for each remaining vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with null or non-finite entries are dropped; all others are fitted and returned, repeated
    rows and null keys too.  A vector shorter than the longest counts as having zeros there (an empty one only zeros);
    entries beyond 2^52 / 64 in size count as that.  A covariance of rank r has r components; with none (an empty
    table, one vector, equal vectors) there are no rows.  Equal eigenvalues keep the order of their columns.
    ``deviation`` is null where it does not fit a long.  Columns beside key and vector are not read.
    """
    vectors = df.select(F.col(vector).alias("v"))
    model = fit(vectors, most)
    error = identity_error(vectors, model)
    wide = transform(df.select(F.col(key), F.col(vector)), model, vector)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    long = wide.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(model.middle.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


__all__ = ["Centre", "Whitening", "centre", "covariance", "fit", "identity_error", "one_sided_jacobi", "pivoted_cholesky", "transform", "whiten"]
