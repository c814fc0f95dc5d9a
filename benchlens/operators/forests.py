"""Forests without a limit of depth, on exact values, grown from distinct vectors.

Rows with equal vectors never part in a tree, so a tree needs only how many there are and the sum of their targets.
Spark counts both for every tree from all rows; a task then grows a block of trees, level by level, from the counts.
Targets are whole multiples of a power of two: sums are exact, and trees do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlens.operators.trees import MOST_CELLS, Ensemble, Tree, by_vector, whole, whole_unit
from benchlens.sources.results import write_table, written

#: Trees that one task grows, and the most counts (trees x vectors) that it holds for them.
MOST_TREES, MOST_COUNTS = 25, 1 << 20
NODES = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, count array<long>"
#: Chances of up to k draws of a row, for a bootstrap sample of large tables.
DRAWS = np.cumsum([exp(-1) / factorial(k) for k in range(18)])


def few_vectors(train: DataFrame) -> int | None:
    """The number of distinct vectors where their cells fit into a task, whatever the number of rows."""
    n = train.select("features").distinct().count()
    return n if n and n * len(train.first().features) <= MOST_CELLS else None


def drawn(rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """How often each tree draws each row (Poisson of mean one), which the row's hash and the tree alone decide."""
    z = rows.astype(np.uint64)[:, None] + (trees.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(DRAWS, u, side="right")


class _Level:
    """The open nodes of a level: each feature's points by slot (open node), then by value."""

    def __init__(self, x: np.ndarray, n: np.ndarray, g: np.ndarray):
        self.x, self.n, self.g, self.k = x, n, g, 1
        self.order = [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])]
        self.slot = np.zeros(len(x), np.int64)

    def move(self, slot: np.ndarray, k: int) -> None:
        """The points' slots in the next level (-1: in a leaf)."""
        for f, o in enumerate(self.order):
            o = o[slot[o] >= 0]
            self.order[f] = o[np.argsort(slot[o], kind="stable")]
        self.slot, self.k = slot, k

    def starts(self) -> np.ndarray:
        return np.searchsorted(self.slot[self.order[0]], np.arange(self.k))  # no slot is empty

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and sums of the slots, and whether their points' means differ."""
        o, at = self.order[0], self.starts()
        mean = self.g[o] / self.n[o]
        return np.add.reduceat(self.n[o], at), np.add.reduceat(self.g[o], at), np.minimum.reduceat(mean, at) < np.maximum.reduceat(mean, at)


def _gain(n_left, g_left, n, g):
    n_right, g_right = n - n_left, g - g_left
    return g_left.astype(float) ** 2 / n_left + g_right.astype(float) ** 2 / n_right - g.astype(float) ** 2 / n


def exact_cuts(level: _Level, f: int, n: np.ndarray, g: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots that the feature can split, gain and threshold of each one's best cut, halfway between neighbouring values."""
    o, at = level.order[f], level.starts()
    slot, v = level.slot[o], level.x[o, f]
    n_left, g_left = np.cumsum(level.n[o]), np.cumsum(level.g[o])
    before = at[1:] - 1
    n_left, g_left = n_left - np.r_[0, n_left[before]][slot], g_left - np.r_[0, g_left[before]][slot]
    cut = np.flatnonzero((slot[1:] == slot[:-1]) & (v[1:] > v[:-1]))
    if not len(cut):
        return cut, np.zeros(0), np.zeros(0)
    own = slot[cut]
    gain = _gain(n_left[cut], g_left[cut], n[own], g[own])
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    best = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.r_[first, len(cut)]))
    top = np.flatnonzero(gain == best)
    top = top[np.r_[True, own[top][1:] != own[top][:-1]]]  # of equal ones that of the least value
    low, high = v[cut[top]], v[cut[top] + 1]
    middle = low + (high - low) / 2
    return own[top], gain[top], np.where(middle < high, middle, low)


def random_cuts(seed: int, tree: int) -> Callable:
    """Like ``exact_cuts``, of one threshold that is drawn in the slot's own range of values."""

    def cuts(level: _Level, f: int, n: np.ndarray, g: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o, at = level.order[f], level.starts()
        slot, v = level.slot[o], level.x[o, f]
        low, high = v[at], v[np.r_[at[1:], len(o)] - 1]
        u = np.array([int(hashlib.md5(f"{tree}::{node}::{f}::{seed}".encode()).hexdigest()[:13], 16) for node in names]) / float(1 << 52)
        threshold = low + u * (high - low)
        threshold = np.where(threshold < high, threshold, low)
        under = v <= threshold[slot]
        n_left, g_left = np.add.reduceat(np.where(under, level.n[o], 0), at), np.add.reduceat(np.where(under, level.g[o], 0), at)
        able = np.flatnonzero(low < high)
        return able, _gain(n_left[able], g_left[able], n[able], g[able]), threshold[able]

    return cuts


def grow_tree(x: np.ndarray, n: np.ndarray, g: np.ndarray, cuts: Callable) -> dict[str, np.ndarray]:
    """The nodes of a tree, by level, on points of ``n`` rows with target sums ``g``; a node is split while its means differ.

    Of equal gains the least feature's is taken.  Values are means of whole targets.
    """
    own = n > 0
    x, n, g = x[own], n[own], g[own]
    if not len(x):
        return {"feature": np.array([-1], np.int32), "threshold": np.zeros(1), "left": np.array([-1], np.int32), "right": np.array([-1], np.int32), "value": np.zeros(1), "count": np.zeros(1, np.int64)}
    level, names, parts, made = _Level(x, n, g), np.zeros(1, np.int64), [], 1
    while level.k:
        rows, sums, differ = level.totals()
        gain, threshold, feature = np.full(level.k, -np.inf), np.zeros(level.k), np.full(level.k, -1, np.int32)
        for f in range(x.shape[1]):
            slots, found, at = cuts(level, f, rows, sums, names)
            better = differ[slots] & (found > gain[slots])
            slots = slots[better]
            gain[slots], threshold[slots], feature[slots] = found[better], at[better], f
        split = np.flatnonzero(feature >= 0)
        left = np.full(level.k, -1, np.int32)
        left[split] = made + 2 * np.arange(len(split))
        parts.append({"feature": feature, "threshold": threshold, "left": left, "right": np.where(left < 0, -1, left + 1).astype(np.int32), "value": sums / rows, "count": rows})
        names, made = made + np.arange(2 * len(split)), made + 2 * len(split)
        child = np.full(level.k + 1, -1)
        child[split] = 2 * np.arange(len(split))
        down = child[level.slot]  # -1 stays -1: the last entry
        goes = np.flatnonzero(down >= 0)
        at = level.slot[goes]
        down[goes] += x[goes, feature[at]] > threshold[at]
        level.move(down, 2 * len(split))
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def leaf_values(tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree["feature"][node] >= 0)
        if not len(inner):
            return tree["value"][node]
        at = node[inner]
        node[inner] = np.where(x[inner, tree["feature"][at]] <= tree["threshold"][at], tree["left"][at], tree["right"][at])


@dataclass
class Forest:
    """``base`` plus the mean of the trees' leaf values; the trees are a table with one row each."""

    trees: DataFrame
    n_trees: int
    base: float

    def ensemble(self) -> Ensemble:
        """The trees in the driver, for attributions."""
        rows = self.trees.orderBy("tree").collect()
        return Ensemble([Tree(*[list(r[k]) for k in ("feature", "threshold", "left", "right", "value", "count")]) for r in rows], self.base, 1.0 / self.n_trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``prediction``: blocks of distinct vectors meet every tree, the shares of the trees are summed."""
        return by_vector(df, self._predicted)

    def _predicted(self, vectors: DataFrame) -> DataFrame:
        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"_block": [np.stack(b["_x"]).tobytes()], "_n": [len(b)]})

        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for (block, n), trees in b.groupby(["_block", "_n"], sort=False):
                    x = np.frombuffer(block).reshape(n, -1)
                    yield pd.DataFrame({"_x": list(x), "share": sum(leaf_values(t, x) for t in trees.to_dict("records"))})

        blocks = written(vectors.mapInPandas(packed, "_block binary, _n int"))
        found = self.trees.select("feature", "threshold", "left", "right", "value").crossJoin(blocks).mapInPandas(shares, "_x array<double>, share double")
        return found.groupBy("_x").agg((F.lit(self.base) + F.sum("share") / F.lit(self.n_trees)).alias("prediction"))


def grow(train: DataFrame, seed: int, trees: int, vectors: int, random: bool) -> Forest:
    """A forest on the rows (row_id, features, y): bootstrap samples and exact cuts or, if ``random``, all rows and drawn cuts.

    ``vectors`` is the number of distinct vectors, whose cells fit into a task.
    """
    y = F.col("y").cast("double")
    n, low, high = train.agg(F.count("*"), F.min(y), F.max(y)).first()
    middle, unit = low + (high - low) / 2, whole_unit(2 * n, low, high)
    per = max(1, min(MOST_TREES, MOST_COUNTS // vectors))
    rows = train.select(vector_to_array("features").alias("x"), F.xxhash64("row_id", F.lit(seed)).alias("h"), whole(y - F.lit(middle), unit).alias("g"))
    if random:
        rows = rows.groupBy("x").agg(F.count("*").alias("h"), F.sum("g").alias("g"))
    else:
        rows = rows.repartitionByRange("x", "h").sortWithinPartitions("x")  # a vector of many rows may lie in several tasks

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, g = np.stack(b["x"]), b["g"].to_numpy()
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
            for block, some in enumerate(range(0, trees, per)):
                if random:
                    k = b["h"].to_numpy()[:, None]
                    s = g[:, None]
                else:
                    k = drawn(b["h"].to_numpy(), np.arange(some, min(some + per, trees)))
                    s = k * g[:, None]
                yield pd.DataFrame({"block": [block], "x": [x[first].tobytes()], "n": [np.add.reduceat(k, first).astype(np.int64).tobytes()], "g": [np.add.reduceat(s, first).tobytes()], "points": [len(first)]})

    def grown(b: pd.DataFrame) -> pd.DataFrame:
        of = lambda name, kind: np.concatenate([np.frombuffer(v, kind).reshape(m, -1) for v, m in zip(b[name], b["points"], strict=True)])
        x, k, s, out = of("x", float), of("n", np.int64), of("g", np.int64), []
        begin = int(b["block"].iloc[0]) * per
        for t in range(begin, min(begin + per, trees)):
            column = 0 if random else t - begin
            tree = grow_tree(x, k[:, column], s[:, column], random_cuts(seed, t) if random else exact_cuts)
            out.append({"tree": t, **tree, "value": tree["value"] / unit})
        return pd.DataFrame(out)

    table = rows.mapInPandas(counted, "block int, x binary, n binary, g binary, points int").repartition(-(-trees // per), "block").groupBy("block").applyInPandas(grown, NODES)
    return Forest(write_table(table)[0], trees, middle)
