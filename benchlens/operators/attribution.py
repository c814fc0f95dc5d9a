"""Shapley attributions and interactions of MLlib tree ensembles, as one pass over explained rows.

A saved ensemble is a table of nodes.  Every leaf is a box over the features of its path; for one
explained and one background row a leaf's share follows in closed form from the features that only
the one, or only the other, has inside the box.  These are bits, one for each condition of a path:
background rows with equal bits at a leaf count once, and an index from features to conditions sets a
sparse row's bits from its nonzero cells.  Leaves are broadcast in parts of bounded size, whose shares
add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from benchlens.operators.forests import Forest
from benchlens.operators.trees import Ensemble

#: Bytes of leaves in one broadcast; further parts of an ensemble are further passes over the rows.
PART_BYTES = 64 << 20
#: Cells (background x leaf x depth) that a task compares at once.
BLOCK_CELLS = 1 << 22


@dataclass
class Leaves:
    """Leaf boxes: features (-1 fills up), bounds (low, high], coverage ratios and values."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ratio: np.ndarray
    value: np.ndarray

    def inside(self, x: np.ndarray) -> np.ndarray:
        """For rows (n x p): whether each leaf's features lie inside (n x leaves x depth)."""
        own = x[:, np.maximum(self.feature, 0)]
        return (own > self.low) & (own <= self.high) | (self.feature < 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((part.inside(x).all(2) @ part.value for part in self.cut(BLOCK_CELLS // (max(1, len(x)) * self.feature.shape[1]))), np.zeros(len(x)))

    def cut(self, most: int) -> Iterator[Leaves]:
        """The same leaves in parts of ``most`` at most (of one at least)."""
        most = max(1, most)
        for a in range(0, len(self.value), most):
            yield Leaves(*(getattr(self, f.name)[a : a + most] for f in fields(self)))

    def parts(self, states: int = 0) -> list[Leaves]:
        """Parts of bounded bytes, with their index and up to so many background states a leaf."""
        return list(self.cut(PART_BYTES // (64 * self.feature.shape[1] + 24 * states + 24)))


def boxes(nodes: dict[int, tuple], scale: float) -> list[tuple[dict[int, list], float]]:
    """Leaves of one tree; a node is (left, right, feature, threshold, prediction, count)."""
    out = []
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        left, right, feature, threshold, prediction, count = nodes[at]
        if left < 0:
            out.append((path, prediction * scale))
            continue
        for child, is_left in ((left, True), (right, False)):
            low, high, ratio = path.get(feature, (-np.inf, np.inf, 1.0))
            share = nodes[child][5] / count if count else 0.0
            bounds = (low, min(high, threshold), ratio * share) if is_left else (max(low, threshold), high, ratio * share)
            stack.append((child, {**path, feature: bounds}))
    return out


def pack(leaves: list[tuple[dict[int, tuple], float]]) -> Leaves:
    depth = max([1, *(len(p) for p, _ in leaves)])
    shape = (len(leaves), depth)
    out = Leaves(np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in leaves]))
    for i, (path, _) in enumerate(leaves):
        for j, (f, (low, high, ratio)) in enumerate(sorted(path.items())):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.ratio[i, j] = f, low, high, ratio
    return out


def ensemble_leaves(spark: SparkSession, model, path: str) -> Leaves:
    """Save a tree, forest or boosted model below ``path`` and read its leaves back."""
    if isinstance(model, Forest):
        model = model.ensemble()
    if isinstance(model, Ensemble):
        model.save(spark, path)
        return pack([leaf for nodes in model.nodes() for leaf in boxes(nodes, model.scale)] + [({}, model.base)])
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    weights = list(getattr(model, "treeWeights", [1.0]))
    mean = "Forest" in type(model).__name__
    trees: dict[int, dict[int, tuple]] = {}
    n = "nodeData."
    rows = data.select("treeID", f"{n}id", f"{n}leftChild", f"{n}rightChild", F.col(f"{n}split.featureIndex").alias("f"), F.get(f"{n}split.leftCategoriesOrThreshold", F.lit(0)).alias("t"), f"{n}prediction", F.col(f"{n}rawCount").alias("count"))
    for r in rows.toLocalIterator():  # nodes of one model: bounded by its trees and depth
        trees.setdefault(r.treeID, {})[r.id] = (r.leftChild, r.rightChild, r.f, r.t, r.prediction, r["count"])
    leaves = []
    for k in sorted(trees):
        leaves += boxes(trees[k], (1.0 / len(trees)) if mean else weights[k])
    return pack(leaves)


@dataclass
class Sparse:
    """Rows as (row, feature, value) of their nonzero cells."""

    n: int
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of one row (cells lie by rows)."""
        a, b = np.searchsorted(self.row, (k, k + 1))
        return self.feature[a:b], self.value[a:b]


def sparse(vectors) -> Sparse:
    """From arrays, MLlib vectors, or their (type, size, indices, values) as Spark stores them."""
    rows, features, values, n = [], [], [], 0
    for n, v in enumerate(vectors, 1):
        if isinstance(v, Mapping | Row):
            v = v if isinstance(v, Mapping) else v.asDict()
            own = np.asarray(v["values"], float)
            at = np.arange(len(own)) if v["indices"] is None else np.asarray(v["indices"], np.int64)
        elif isinstance(v, SparseVector):
            at, own = v.indices.astype(np.int64), v.values
        else:
            own = np.asarray(v.toArray() if isinstance(v, DenseVector) else v, float)
            at = np.arange(len(own))
        kept = own != 0
        rows.append(np.full(int(kept.sum()), n - 1))
        features.append(at[kept])
        values.append(own[kept])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Sparse(n, join(rows, np.int64), join(features, np.int64), join(values, float))


class Index:
    """Leaves by feature: which conditions (leaf, place on its path) ask for a feature.

    A leaf's state for a row is one bit for each condition.  Rows without a nonzero cell share one state;
    any other row's state differs from it only at the conditions of its nonzero features.
    """

    def __init__(self, leaves: Leaves):
        self.leaves = leaves
        if leaves.feature.shape[1] > 62:
            raise ValueError("more than 62 features on one path")
        real = leaves.feature >= 0
        bits = np.left_shift(np.int64(1), np.arange(leaves.feature.shape[1], dtype=np.int64))
        self.full = (real * bits).sum(1)
        self.zero = (((leaves.low < 0) & (leaves.high >= 0) & real) * bits).sum(1)
        leaf, place = np.nonzero(real)
        by = np.argsort(leaves.feature[leaf, place], kind="stable")
        self.leaf, place = leaf[by], place[by]
        self.low, self.high = leaves.low[self.leaf, place], leaves.high[self.leaf, place]
        self.bit, self.at_zero = bits[place], (self.low < 0) & (self.high >= 0)
        self.known, self.begin = np.unique(leaves.feature[self.leaf, place], return_index=True)
        self.end = np.append(self.begin[1:], len(self.leaf))

    def states(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The bits of all leaves for one row, from its nonzero cells."""
        out = self.zero.copy()
        k = np.searchsorted(self.known, features)
        k, values = (x[(k < len(self.known)) & (self.known[np.minimum(k, len(self.known) - 1)] == features)] for x in (k, values)) if len(self.known) else (k[:0], values[:0])
        if len(k):
            sizes = self.end[k] - self.begin[k]
            at = np.repeat(self.begin[k] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            x = np.repeat(values, sizes)
            turned = ((x > self.low[at]) & (x <= self.high[at])) != self.at_zero[at]
            np.bitwise_xor.at(out, self.leaf[at[turned]], self.bit[at[turned]])
        return out


class Background:
    """For each leaf the different states that background rows have there, and how many rows have each."""

    def __init__(self, index: Index, rows: Sparse):
        states = np.array([index.states(*rows.of(k)) for k in range(rows.n)]).reshape(rows.n, -1)
        leaf, state, count = [], [], []
        for k in range(states.shape[1]):
            own, n = np.unique(states[:, k], return_counts=True)
            leaf.append(np.full(len(own), k))
            state.append(own)
            count.append(n)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.leaf, self.state, self.share = join(leaf), join(state), join(count) / max(rows.n, 1)

    def mean(self, index: Index) -> float:
        """Mean prediction of the background rows."""
        return float((index.leaves.value[self.leaf] * self.share)[self.state == index.full[self.leaf]].sum())


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def shapley(index: Index, background: Background, features: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with an interventional Shapley value, and the values, of one row against the background."""
    leaves = index.leaves
    mine = index.states(features, values)[background.leaf]
    full = index.full[background.leaf]
    alive = np.flatnonzero(((mine | background.state) == full) & (mine != background.state))
    leaf, mine, theirs = background.leaf[alive], mine[alive], background.state[alive]
    only_x, only_b = mine & ~theirs, theirs & ~mine
    a, b = _bits(only_x), _bits(only_b)
    facts = np.array([float(factorial(k)) for k in range(2 * leaves.feature.shape[1] + 1)])
    weight = leaves.value[leaf] * background.share[alive] / facts[a + b]
    gain = np.where(a > 0, weight * facts[np.maximum(a - 1, 0)] * facts[b], 0.0)
    loss = np.where(b > 0, weight * facts[a] * facts[np.maximum(b - 1, 0)], 0.0)
    found, shares = [], []
    for place in range(leaves.feature.shape[1]):
        bit = np.int64(1 << place)
        share = np.where(only_x & bit, gain, 0.0) - np.where(only_b & bit, loss, 0.0)
        on = np.flatnonzero((only_x | only_b) & bit)
        found.append(leaves.feature[leaf[on], place])
        shares.append(share[on])
    names, at = np.unique(np.concatenate(found), return_inverse=True)
    return names, np.bincount(at, np.concatenate(shares), len(names))


def _product(factors: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Coefficients of the product of (r + z t) over factors, for all leaves."""
    out = np.zeros((n, len(factors) + 1))
    out[:, 0] = 1
    for k, (r, z) in enumerate(factors):
        shifted = np.zeros_like(out)
        shifted[:, 1 : k + 2] = out[:, : k + 1] * z[:, None]
        out = out * r[:, None] + shifted
    return out


class Pairs:
    """The pairs of features that share a path, numbered, and for each leaf size its leaves' pair numbers."""

    def __init__(self, leaves: Leaves):
        sizes = (leaves.feature >= 0).sum(1)
        self.groups, keys, singles = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = int(leaves.feature.max(initial=-1)) + 1
        for d in np.unique(sizes[sizes > 0]).tolist():  # leaves with d path features; they stand first
            on = np.flatnonzero(sizes == d)
            f = leaves.feature[on, :d].astype(np.int64)
            places = [(i, j) for i in range(d) for j in range(i + 1, d)]
            own = [f[:, i] * width + f[:, j] for i, j in places]  # a path's features ascend, so i's is the smaller
            self.groups.append((d, on, places, len(keys)))
            keys += own
            singles.append(np.unique(f))
        self.known, numbers = np.unique(np.concatenate(keys), return_inverse=True)
        self.numbers = np.split(numbers, np.cumsum([len(k) for k in keys])[:-1])
        self.i, self.j = (self.known // width, self.known % width) if width else (self.known, self.known)
        self.features = np.unique(np.concatenate(singles))


def interactions(index: Index, pairs: Pairs, features: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path-dependent Shapley interaction values of one row: (i, j, value) of both cells of a pair, and the diagonal."""
    leaves = index.leaves
    state = index.states(features, values)
    cells, whole = np.zeros(len(pairs.known)), np.zeros(len(pairs.features))
    for d, on, places, first in pairs.groups:
        z = ((state[on, None] >> np.arange(d)) & 1).astype(float)
        r, v = leaves.ratio[on, :d], leaves.value[on]
        weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
        for i in range(d):
            rest = _product([(r[:, h], z[:, h]) for h in range(d) if h != i], len(on))
            whole += np.bincount(np.searchsorted(pairs.features, leaves.feature[on, i]), v * (z[:, i] - r[:, i]) * (rest @ weight), len(whole))
        weight = np.array([factorial(k) * factorial(d - k - 2) / (2 * factorial(d - 1)) for k in range(d - 1)])
        for k, (i, j) in enumerate(places):
            rest = _product([(r[:, h], z[:, h]) for h in range(d) if h not in (i, j)], len(on))
            cells += np.bincount(pairs.numbers[first + k], v * (z[:, i] - r[:, i]) * (z[:, j] - r[:, j]) * (rest @ weight), len(cells))
    i, j = np.searchsorted(pairs.features, pairs.i), np.searchsorted(pairs.features, pairs.j)
    diagonal = whole - np.bincount(i, cells, len(whole)) - np.bincount(j, cells, len(whole))
    return np.concatenate([pairs.i, pairs.j, pairs.features]), np.concatenate([pairs.j, pairs.i, pairs.features]), np.concatenate([cells, cells, diagonal])


def _stored(rows: DataFrame) -> DataFrame:
    """(row_id, x): cells of ``features`` (MLlib vectors, as stored) or the array ``x``."""
    if "features" in rows.columns:
        return rows.select("row_id", F.unwrap_udt(F.col("features")).alias("x"))
    return rows.select("row_id", "x")


def explain(rows: DataFrame, leaves: Leaves, background) -> tuple[DataFrame, float]:
    """(row_id, feature_id, shap), zeros left out; and the expected value.

    ``rows`` is (row_id, features) with MLlib vectors or (row_id, x) with arrays; ``background`` a bounded
    number of vectors or arrays.  What a task holds grows with the leaves and their different background
    states, what a row costs with its nonzero cells and those states: not with the number of features.
    """
    kind = rows.schema["row_id"].dataType.simpleString()
    against = sparse(background)
    stored, expected = _stored(rows), 0.0

    def passed(part: Leaves) -> tuple[DataFrame, float]:
        index = Index(part)
        known = Background(index, against)
        held = rows.sparkSession.sparkContext.broadcast((index, known))  # a part's leaves are bounded, and so are its states

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                cells = sparse(f["x"])
                found = [shapley(*held.value, *cells.of(k)) for k in range(cells.n)]
                ids = np.repeat(f["row_id"].to_numpy(), [len(names) for names, _ in found])
                names, values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0))
                on = values != 0
                yield pd.DataFrame({"row_id": ids[on], "feature_id": names[on], "shap": values[on]})

        return stored.mapInPandas(run, f"row_id {kind}, feature_id int, shap double"), known.mean(index)

    found = [passed(part) for part in leaves.parts(max(1, against.n))]
    out, expected = reduce(DataFrame.unionByName, [f for f, _ in found]), sum(e for _, e in found)
    if len(found) > 1:
        out = out.groupBy("row_id", "feature_id").agg(F.sum("shap").alias("shap")).where("shap <> 0")
    return out, expected


def explain_interactions(rows: DataFrame, leaves: Leaves, width: int | None = None) -> DataFrame:
    """(row_id, feature_i, feature_j, value), zeros left out; only pairs that share a path are ever held."""
    kind = rows.schema["row_id"].dataType.simpleString()
    stored = _stored(rows)

    def passed(part: Leaves) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast((Index(part), Pairs(part)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                cells = sparse(f["x"])
                for k, row_id in enumerate(f["row_id"]):
                    i, j, values = interactions(*held.value, *cells.of(k))
                    on = values != 0
                    yield pd.DataFrame({"row_id": row_id, "feature_i": i[on], "feature_j": j[on], "value": values[on]})

        return stored.mapInPandas(run, f"row_id {kind}, feature_i int, feature_j int, value double")

    found = [passed(part) for part in leaves.parts()]
    out = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        out = out.groupBy("row_id", "feature_i", "feature_j").agg(F.sum("value").alias("value")).where("value <> 0")
    return out
