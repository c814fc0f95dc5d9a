"""Tree ensembles grown by Spark aggregations: best-first boosting and extremely random trees.

Both work on a table of rows with sparse cells (feature -> value, zeros left out).  A pass over it is one
job for all open nodes (of all trees, where trees are independent); what comes back is one split a node.
Predicting is a lambda expression over the nodes of all trees: no Python worker takes part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benchlens.sources.results import remove_table, write_table, written

#: Cells of distinct vectors (vectors x features) that a task holds; fits on more go through the cluster pass by pass.
MOST_CELLS = 1 << 22
NODES = "array<struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>>>"


@dataclass
class Tree:
    """Nodes by number: feature (-1 at leaves), threshold (left if at most that), children, value, rows."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    count: list[int] = field(default_factory=list)

    def add(self, value: float, count: int) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.count, count)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, left: tuple[float, int], right: tuple[float, int]) -> tuple[int, int]:
        children = self.add(*left), self.add(*right)
        self.feature[node], self.threshold[node], (self.left[node], self.right[node]) = feature, threshold, children
        return children

    def depth(self) -> int:
        below = [0] * len(self.feature)
        for node in range(len(self.feature) - 1, -1, -1):  # children have larger numbers
            if self.feature[node] >= 0:
                below[node] = 1 + max(below[self.left[node]], below[self.right[node]])
        return below[0]


@dataclass
class Ensemble:
    """``base`` plus ``scale`` times the sum of the trees' leaf values."""

    trees: list[Tree]
    base: float = 0.0
    scale: float = 1.0
    #: Fitted on far fewer vectors than rows: each distinct vector is predicted once.
    by_vector: bool = False

    def nodes(self) -> list[dict[int, tuple]]:
        """Each tree's nodes as (left, right, feature, threshold, prediction, count)."""
        return [dict(enumerate(zip(t.left, t.right, t.feature, t.threshold, t.value, t.count, strict=True))) for t in self.trees]

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a node, the base as the value of tree -1."""
        rows = [(-1, 0, -1, -1, -1, 0.0, self.base, 0, self.scale)]
        rows += [(k, node, *cells, self.scale) for k, t in enumerate(self.trees) for node, cells in enumerate(zip(t.feature, t.left, t.right, t.threshold, t.value, t.count, strict=True))]
        spark.createDataFrame(rows, "tree int, node int, feature int, left int, right int, threshold double, value double, count long, scale double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        rows = spark.read.parquet(path).orderBy("tree", "node").collect()  # the nodes of one model
        trees: dict[int, Tree] = {}
        for r in rows[1:]:
            t = trees.setdefault(r.tree, Tree())
            for name in ("feature", "threshold", "left", "right", "value"):
                getattr(t, name).append(r[name])
            t.count.append(r["count"])
        return Ensemble(list(trees.values()), rows[0].value, rows[0].scale)

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
        """``df`` with a column ``prediction``; the trees travel as one broadcast row."""
        if not self.trees:
            return df.withColumn(prediction, F.lit(self.base))
        if self.by_vector:
            return by_vector(df, lambda vectors: self._predicted(vectors, prediction), features)
        return self._predicted(df.withColumn("_x", vector_to_array(features)), prediction).drop("_x")

    def _predicted(self, df: DataFrame, prediction: str) -> DataFrame:
        spark = df.sparkSession
        text = json.dumps([{k: getattr(t, k) for k in ("feature", "threshold", "left", "right", "value")} for t in self.trees])
        held = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", NODES).alias("_trees"))
        deepest = max(t.depth() for t in self.trees)
        joined = df.crossJoin(F.broadcast(held))  # one row

        def leaf(tree: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                goes = F.get("_x", F.get(tree["feature"], node)) <= F.get(tree["threshold"], node)
                return F.when(F.get(tree["feature"], node) < 0, node).when(goes, F.get(tree["left"], node)).otherwise(F.get(tree["right"], node))

            return F.get(tree["value"], F.aggregate(F.sequence(F.lit(0), F.lit(deepest)), F.lit(0), step))

        total = F.aggregate("_trees", F.lit(0.0), lambda s, tree: s + leaf(tree))
        return joined.withColumn(prediction, F.lit(self.base) + F.lit(self.scale) * total).drop("_trees")


def by_vector(df: DataFrame, predicted: Callable[[DataFrame], DataFrame], features: str = "features") -> DataFrame:
    """``df`` joined to what ``predicted`` makes of its distinct vectors, a column ``_x`` of arrays."""
    rows = df.withColumn("_x", vector_to_array(features))
    return rows.join(predicted(rows.select("_x").distinct()), "_x").drop("_x")


def whole_unit(n: int, low: float, high: float) -> float:
    """The power of two that ``n`` differences of targets are whole multiples of, so that their sums are exact longs."""
    if not low < high:
        return 1.0
    return 2.0 ** min(60 - math.ceil(math.log2(n + 1)) - math.ceil(math.log2(high - low)) - 1, 1000)


def whole(value: Column, unit: float) -> Column:
    return F.floor(value * F.lit(unit) + F.lit(0.5)).cast("long")


def cells(df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with ``_cells``, the nonzero (feature, value) of its vectors in place of these; sparse ones are never filled up."""
    stored = F.unwrap_udt(F.col(features))
    dense = F.transform(stored["values"], lambda v, i: F.struct(i.alias("f"), v.alias("v")))
    sparse = F.zip_with(stored["indices"], stored["values"], lambda i, v: F.struct(i.alias("f"), v.alias("v")))
    both = F.when(stored["indices"].isNull(), dense).otherwise(sparse)
    return df.withColumn("_cells", F.filter(both, lambda c: c["v"] != 0)).drop(features)


#: Tables of fewer rows for each core lie in few files, which would leave most cores idle in every pass.
ROWS_A_CORE = 100_000


def spread(df: DataFrame, n: int, key: str) -> DataFrame:
    """``df`` of ``n`` rows over all cores by a hash of ``key`` if it is small; larger tables keep their partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if n < ROWS_A_CORE * cores else df


# Extremely random trees.


def uniform(tree: Column, node: Column, feature: Column, seed: int) -> Column:
    """A number in [0, 1) that only tree, node, feature and seed decide."""
    digits = F.substring(F.md5(F.concat_ws("::", tree.cast("string"), node.cast("string"), feature.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _long(open_rows: DataFrame) -> DataFrame:
    return open_rows.select("tree", "node", "y", F.explode("_cells").alias("c")).select("tree", "node", "y", F.col("c.f").alias("feature"), F.col("c.v").alias("v"))


def node_ranges(open_rows: DataFrame) -> DataFrame:
    """Rows, sum and range of each feature's cells in each node; feature -1 stands for the target of all its rows."""
    target = F.array(F.struct(F.lit(-1).alias("f"), F.col("y").alias("v")))
    every = _long(open_rows.withColumn("_cells", F.concat(F.col("_cells").cast("array<struct<f:int,v:double>>"), target)))
    return every.groupBy("tree", "node", "feature").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n_cells"), F.sum("y").alias("s_cells"))


def best_random_splits(open_rows: DataFrame, ranges: DataFrame, seed: int, least: int = 1) -> DataFrame:
    """The best split of each node, from its ``node_ranges`` as a table.

    The ranges are read with the size of their files, so that Spark sends them to the cells where they are
    small and only then: no cell of a row is shuffled for a level.
    """
    node, target = W.partitionBy("tree", "node"), F.col("feature") == -1  # a node has a row for each feature
    whole = {"n": "n_cells", "s": "s_cells", "_least": "low", "_most": "high"}
    drawn = ranges.select("*", *[F.max(F.when(target, F.col(c))).over(node).alias(k) for k, c in whole.items()]).where((F.col("_least") < F.col("_most")) & ~target)
    some_zero = F.col("n_cells") < F.col("n")
    low, high = (F.when(some_zero, f(c, F.lit(0.0))).otherwise(F.col(c)) for f, c in ((F.least, "low"), (F.greatest, "high")))
    drawn = drawn.withColumn("low", low).withColumn("high", high).where("low < high")
    drawn = drawn.withColumn("threshold", F.col("low") + uniform(F.col("tree"), F.col("node"), F.col("feature"), seed) * (F.col("high") - F.col("low"))).drop("low", "high", "_least", "_most")
    by = ["tree", "node", "feature"]
    sides = _long(open_rows).join(drawn.select(*by, "threshold"), by).where("v <= threshold").groupBy(*by).agg(F.count("*").alias("n_under"), F.sum("y").alias("s_under"))
    zero_left = F.col("threshold") >= 0  # rows without the cell
    got = drawn.join(sides, by, "left").fillna(0, ["n_under"]).fillna(0.0, ["s_under"])
    got = got.withColumn("n_left", F.col("n_under") + F.when(zero_left, F.col("n") - F.col("n_cells")).otherwise(0)).withColumn("s_left", F.col("s_under") + F.when(zero_left, F.col("s") - F.col("s_cells")).otherwise(0.0))
    got = got.where((F.col("n_left") >= least) & (F.col("n") - F.col("n_left") >= least))
    right_n, right_s = F.col("n") - F.col("n_left"), F.col("s") - F.col("s_left")
    gain = F.col("s_left") * F.col("s_left") / F.col("n_left") + right_s * right_s / right_n - F.col("s") * F.col("s") / F.col("n")
    best = F.max_by(F.struct("feature", "threshold", "gain", "n", "s", "n_left", "s_left"), F.struct("gain", -F.col("feature")))
    return got.withColumn("gain", gain).groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*")


def random_splits(open_rows: DataFrame, seed: int, least: int = 1) -> DataFrame:
    """The best of one random threshold for each feature, for each open (tree, node).

    ``open_rows`` is (tree, node, y, _cells).  One aggregation gives each feature's range in a node, zeros
    counted in; the threshold is drawn inside that range; a second one sums both sides.  Returns (tree, node,
    feature, threshold, gain, n, s, n_left, s_left), nodes without a split left out.
    """
    return best_random_splits(open_rows, written(node_ranges(open_rows)), seed, least)


def extremely_random_trees(train: DataFrame, seed: int, trees: int, depth: int | None, least: int = 1) -> Ensemble:
    """A mean of trees whose thresholds are drawn anew at each node, grown level by level, all trees in one job.

    ``train`` is (row_id, features, y).  Each row carries its node in every tree; a level reads the table,
    splits all open nodes and writes the rows' next nodes.  ``depth`` None: until no node can be split.
    """
    spark = train.sparkSession
    n, mean = train.agg(F.count("*"), F.avg(F.col("y").cast("double"))).first()
    rows = cells(spread(train.select("row_id", "features", F.col("y").cast("double").alias("y")), n, "row_id").drop("row_id")).withColumn("_map", F.map_from_entries("_cells"))
    grown = [Tree() for _ in range(trees)]
    for t in grown:
        t.add(mean, n)
    rows, path = write_table(rows.withColumn("_nodes", F.array_repeat(F.lit(0), trees)))
    for _ in count() if depth is None else range(depth):
        open_rows = rows.select("y", "_cells", F.posexplode("_nodes").alias("tree", "node")).where("node >= 0")
        ranges, ranges_path = write_table(node_ranges(open_rows))
        found = best_random_splits(open_rows, ranges, seed, least).collect()  # one row for each open node of the ensemble
        remove_table(spark, ranges_path)
        if not found:
            break
        moves: list[dict[int, tuple]] = [{} for _ in grown]
        for r in found:
            t = grown[r.tree]
            children = t.split(r.node, r.feature, r.threshold, (r.s_left / r.n_left, r.n_left), ((r.s - r.s_left) / (r.n - r.n_left), r.n - r.n_left))
            moves[r.tree][r.node] = (r.feature, r.threshold, *children)
        text = json.dumps([{str(k): {"f": f, "t": t, "l": a, "r": b} for k, (f, t, a, b) in m.items()} for m in moves])
        held = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "array<map<string,struct<f:int,t:double,l:int,r:int>>>").alias("_moves"))

        def moved(node: Column, tree: Column) -> Column:
            step = F.try_element_at(F.get("_moves", tree), node.cast("string"))
            x = F.coalesce(F.try_element_at(F.col("_map"), step["f"]), F.lit(0.0))
            return F.when(step.isNull(), F.lit(-1)).when(x <= step["t"], step["l"]).otherwise(step["r"])

        rows, last = write_table(rows.crossJoin(F.broadcast(held)).withColumn("_nodes", F.transform("_nodes", moved)).drop("_moves"))  # one row
        remove_table(spark, path)
        path = last
    remove_table(spark, path)
    return Ensemble(grown, 0.0, 1.0 / trees)


# Best-first boosting.


@dataclass(frozen=True)
class Boosting:
    """``leaves`` a tree, ``least`` rows a leaf; stops after ``patience`` rounds without ``tolerance`` gained on held-out rows."""

    iterations: int = 300
    step: float = 0.05
    leaves: int = 31
    least: int = 20
    bins: int = 255
    patience: int = 10
    tolerance: float = 1e-7
    #: Rows whose values place the cuts (all rows are binned and counted).
    cut_rows: int = 200_000
    #: From so many rows on a sibling's histogram is its parent's less the other's, which is kept as a table;
    #: below, counting both in one job is cheaper.  Sums are whole numbers: the result is the same.
    subtract_from: int = 1_000_000
    #: Up to so many cells of distinct vectors all rounds run where the vectors are; the result is the same.
    most_cells: int = MOST_CELLS


def cut_points(entries: DataFrame, n: int, bins: int) -> DataFrame:
    """(feature, cuts): ascending thresholds, at most ``bins`` - 1, out of (feature, v) without zeros of ``n`` rows.

    Midpoints between neighbouring values where these are few, quantiles otherwise; zero counts as often as
    it was left out.
    """
    per = entries.groupBy("feature", "v").agg(F.count("*").alias("c"))
    zeros = per.groupBy("feature").agg((F.lit(n) - F.sum("c")).alias("c")).where("c > 0").select("feature", F.lit(0.0).alias("v"), "c")
    # rows here are the different values of a feature, of cut_rows rows at most
    order = W.partitionBy("feature").orderBy("v")
    ranked = per.unionByName(zeros).select("feature", "v", F.lead("v").over(order).alias("next"), F.sum("c").over(order).alias("upto"), F.count("*").over(W.partitionBy("feature")).alias("kinds"))
    bin_of = F.floor((F.col("upto") - 1) * bins / F.lit(n))
    last = F.coalesce(F.lead(bin_of).over(order) != bin_of, F.lit(False))
    kept = ranked.withColumn("keep", (F.col("kinds") <= bins) | last).where(F.col("next").isNotNull() & F.col("keep"))
    return kept.groupBy("feature").agg(F.sort_array(F.collect_list(F.col("v") + (F.col("next") - F.col("v")) / 2)).alias("cuts"))


def best_splits(histogram: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """The best split (node, feature, bin, gain, n, g, n_left, g_left) of each node.

    ``histogram`` is (node, feature, bin, n, g), complete for every feature; ``totals`` (node, n, g).  Sums are
    whole numbers, so ties are ties: they go to the least feature, then bin.
    """
    order = W.partitionBy("node", "feature").orderBy("bin")
    under = histogram.select("node", "feature", "bin", F.sum("n").over(order).alias("n_left"), F.sum("g").over(order).alias("g_left"))
    rows = under.join(F.broadcast(totals), "node").where((F.col("n_left") >= least) & (F.col("n") - F.col("n_left") >= least))
    square = lambda g, k: g.cast("double") * g.cast("double") / k
    gain = square(F.col("g_left"), F.col("n_left")) + square(F.col("g") - F.col("g_left"), F.col("n") - F.col("n_left")) - square(F.col("g"), F.col("n"))
    best = F.max_by(F.struct("feature", "bin", "gain", "n", "g", "n_left", "g_left"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return rows.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(best.alias("b")).select("node", "b.*")


class _Order:
    """One tree: a tentative tree is split level by level, then leaves are taken best first."""

    settings: Boosting

    def splits(self, size: dict, found: Callable[[list[int], dict, dict], dict]) -> tuple[dict, dict]:
        """Splits and children of the tentative tree; ``found`` gives the best splits of wanted nodes."""
        splits: dict = {}  # node of the tentative tree -> its best split
        children: dict[int, tuple[int, int]] = {}
        wanted = [0] if size[0][0] >= 2 * self.settings.least else []
        while wanted:
            splits |= found(wanted, splits, children)
            wanted = self.take(splits, children, size)
        return splits, children

    def take(self, splits: dict, children: dict, size: dict) -> list[int]:
        """Best first over what is known; the children of taken nodes whose splits are not known yet."""
        missing = []
        for node in self.order(splits, children)[1]:
            if node in children:
                continue
            r, first = splits[node], 1 + 2 * len(children)
            children[node] = (first, first + 1)
            size[first], size[first + 1] = (r.n_left, r.g_left), (r.n - r.n_left, r.g - r.g_left)
            missing += [first, first + 1]
        return [c for c in missing if size[c][0] >= 2 * self.settings.least]

    def order(self, splits: dict, children: dict) -> tuple[list[int], list[int]]:
        """Leaves and split nodes if the best known leaf is split until there are leaves enough."""
        leaves, taken = [0], []
        while len(leaves) < self.settings.leaves:
            able = [c for c in leaves if c in splits and c not in taken]
            if not able:
                break
            node = max(able, key=lambda c: (splits[c].gain, -c))
            taken.append(node)
            leaves.remove(node)
            leaves += children.get(node, (-node - 1, -node - 1))  # stand-ins: not split yet
        return leaves, taken

class _Grower(_Order):
    """A tree on a table of points: n rows each, with the sum g of their whole gradients."""

    def __init__(self, rows: DataFrame, zero_bins: DataFrame, zero_of: list[int], settings: Boosting):
        self.rows, self.zero_bins, self.zero_of, self.settings = rows, zero_bins, zero_of, settings
        self.kept: list[tuple[set[int], DataFrame, str]] = []  # histograms by node, where siblings are subtracted

    def histogram(self, nodes: list[int], splits: dict, children: dict, size: dict) -> DataFrame:
        """(node, feature, bin, n, g) of all rows; those without a cell lie in the bin of zero."""
        totals = self.totals(nodes, size)
        at = self.route(splits, children, set(nodes))
        long = self.rows.select(at.alias("node"), "_codes", "n", "g").where("node is not null").select("node", "n", "g", F.explode("_codes").alias("feature", "bin"))
        held = long.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        # All of a node's rows count at zero, less those that have a cell.
        zero = F.try_element_at(F.lit(self.zero_of).cast("array<int>"), F.col("feature") + 1)
        both = F.array(F.struct("bin", "n", "g"), F.struct(zero.alias("bin"), (-F.col("n")).alias("n"), (-F.col("g")).alias("g")))
        counted = held.select("node", "feature", F.inline(both).alias("bin", "n", "g"))
        every = self.zero_bins.crossJoin(F.broadcast(totals)).select("node", "feature", F.col("zero").alias("bin"), "n", "g")  # open nodes x features
        # Bins of a feature meet here, where best_splits needs them.
        return counted.unionByName(every).repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).where("n > 0")

    def totals(self, nodes: list[int], size: dict) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(c, *size[c]) for c in nodes], "node int, n long, g long")

    def counted(self, wanted: list[int], splits: dict, children: dict, size: dict, n: int) -> DataFrame:
        """Histograms of the wanted nodes; where siblings are subtracted, those of their siblings too."""
        if n < self.settings.subtract_from:
            return self.histogram(wanted, splits, children, size)
        if not children:
            out, nodes = self.histogram(wanted, splits, children, size), set(wanted)
        else:
            parents = {c: p for p, pair in children.items() for c in pair}
            split = sorted({parents[c] for c in wanted})
            small = [min(children[p], key=lambda c: (size[c][0], c)) for p in split]
            pairs = self.rows.sparkSession.createDataFrame([(p, c, next(x for x in children[p] if x != c)) for p, c in zip(split, small, strict=True)], "parent int, node int, sibling int")
            own = self.histogram(small, splits, children, size)
            above = None
            for nodes, table, _ in self.kept:
                if some := [p for p in split if p in nodes]:
                    part = table.where(F.col("node").isin(some))
                    above = part if above is None else above.unionByName(part)
            above = above.withColumnRenamed("node", "parent").join(F.broadcast(pairs), "parent").select(F.col("sibling").alias("node"), "feature", "bin", "n", "g")
            less = own.join(F.broadcast(pairs), "node").select(F.col("sibling").alias("node"), "feature", "bin", (-F.col("n")).alias("n"), (-F.col("g")).alias("g"))
            rest = above.unionByName(less).groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).where("n > 0")
            out, nodes = own.unionByName(rest), {c for p in split for c in children[p]}
        table, path = write_table(out)
        self.kept.append((nodes, table, path))
        return table

    def grow(self) -> tuple[Tree, Column]:
        """The tree (thresholds are bins, values sums of whole gradients over rows), and each row's leaf as an expression."""
        n, g = self.rows.agg(F.sum("n"), F.sum("g")).first()
        size = {0: (n, g)}

        def found(wanted: list[int], splits: dict, children: dict) -> dict[int, Row]:
            best = best_splits(self.counted(wanted, splits, children, size, n), self.totals(wanted, size), self.settings.least)
            return {r.node: r for r in best.collect()}  # one row for each open node

        splits, children = self.splits(size, found)
        for _, _, path in self.kept:
            remove_table(self.rows.sparkSession, path)
        return self.tree(splits, children, size)

    def route(self, splits: dict, children: dict, nodes: set[int]) -> Column:
        """The node of ``nodes`` that a row lies in (null: none)."""

        def below(node: int) -> Column | None:
            if node in nodes:
                return F.lit(node)
            if node not in children:
                return None
            left, right = (below(c) for c in children[node])
            if left is None and right is None:
                return None
            none = F.lit(None).cast("int")
            return F.when(self.goes_left(splits[node]), none if left is None else left).otherwise(none if right is None else right)

        return below(0)

    def goes_left(self, split) -> Column:
        return F.coalesce(F.try_element_at("_codes", F.lit(split.feature)), F.lit(self.zero_of[split.feature])) <= split.bin

    def tree(self, splits: dict, children: dict, size: dict) -> tuple[Tree, Column]:
        taken = set(self.order(splits, children)[1])
        out = Tree()

        def build(node: int, at: int) -> Column:
            if node not in taken:
                return F.lit(out.value[at])
            r = splits[node]
            left, right = out.split(at, r.feature, float(r.bin), *[(size[c][1] / size[c][0], size[c][0]) for c in children[node]])
            return F.when(self.goes_left(r), build(children[node][0], left)).otherwise(build(children[node][1], right))

        return out, build(0, out.add(size[0][1] / size[0][0], size[0][0]))


class _Local(_Order):
    """The same tree where all points lie in one task, as arrays."""

    #: Entries of the histograms that are held at once.
    MOST = 1 << 22

    def __init__(self, codes: np.ndarray, bins: int, n: np.ndarray, settings: Boosting):
        self.codes, self.bins, self.n, self.settings = codes, bins, n, settings

    def best(self, nodes: list[int], g: np.ndarray, size: dict) -> dict[int, Row]:
        """``best_splits`` of the nodes."""
        width, least, out = self.codes.shape[1], self.settings.least, {}
        slots = max(1, self.MOST // (width * self.bins))
        for some in (nodes[k : k + slots] for k in range(0, len(nodes), slots)):
            slot = np.full(max(int(self.at.max()), *some) + 1, -1)
            slot[some] = np.arange(len(some))
            own = np.flatnonzero((slot[self.at] >= 0) & (self.n > 0))
            key = (((slot[self.at[own]])[:, None] * width + np.arange(width)) * self.bins + self.codes[own]).ravel()
            # Sums of both halves of a gradient are exact as doubles.
            count = lambda v: np.bincount(key, np.repeat(v[own], width), len(some) * width * self.bins).astype(np.int64).reshape(len(some), width, self.bins).cumsum(2)  # noqa: B023, E731
            n_left, g_left = count(self.n), (count(g >> 30) << 30) + count(g & ((1 << 30) - 1))
            n, total = (np.array([size[c][i] for c in some])[:, None, None] for i in (0, 1))
            square = lambda s, k: s.astype(float) * s.astype(float) / k
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = square(g_left, n_left) + square(total - g_left, n - n_left) - square(total, n)
            gain = np.where((n_left >= least) & (n - n_left >= least), gain, -np.inf).reshape(len(some), -1)
            for k, (c, top) in enumerate(zip(some, gain.argmax(1).tolist(), strict=True)):  # the first of equal ones
                if gain[k, top] > 0:
                    feature, at = divmod(top, self.bins)
                    out[c] = Row(feature=feature, bin=at, gain=float(gain[k, top]), n=size[c][0], g=size[c][1], n_left=int(n_left[k, feature, at]), g_left=int(g_left[k, feature, at]))
        return out

    def grow(self, g: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree as ``_Grower.grow`` gives it, and the value of each point's leaf."""
        self.at = np.zeros(len(g), np.int64)
        size, done = {0: (int(self.n.sum()), int(g.sum()))}, set()

        def found(wanted: list[int], splits: dict, children: dict) -> dict[int, Row]:
            for node in sorted(set(children) - done):
                r, own = splits[node], np.flatnonzero(self.at == node)
                self.at[own] = np.where(self.codes[own, r.feature] <= r.bin, *children[node])
                done.add(node)
            return self.best(wanted, g, size)

        splits, children = self.splits(size, found)
        taken, out, leaf = set(self.order(splits, children)[1]), Tree(), np.zeros(len(g))
        work = [(0, out.add(size[0][1] / size[0][0], size[0][0]), np.arange(len(g)))]
        while work:
            node, at, own = work.pop()
            if node not in taken:
                leaf[own] = out.value[at]
                continue
            r, pair = splits[node], children[node]
            left, right = out.split(at, r.feature, float(r.bin), *[(size[c][1] / size[c][0], size[c][0]) for c in pair])
            under = self.codes[own, r.feature] <= r.bin
            work += [(pair[1], right, own[~under]), (pair[0], left, own[under])]
        return out, leaf


def _stops(losses: list[float | None], settings: Boosting) -> bool:
    before = losses[: -settings.patience]
    return losses[-1] is not None and bool(before) and min(losses[-settings.patience :]) > min(before) - settings.tolerance


def _local_rounds(points: DataFrame, features: list[int], zero_of: list[int], bins: int, unit: float, settings: Boosting, stop: bool) -> list[Tree]:
    """All rounds of boosting on points that fit into a task."""
    place, names = {f: k for k, f in enumerate(features)}, ("n", "s", "hn", "hs", "hq")

    def rounds(b: pd.DataFrame) -> pd.DataFrame:
        n, s, hn, hs, hq = (b[c].to_numpy() for c in names)
        codes = np.tile(np.array([zero_of[f] for f in features], np.int32), (len(b), 1))
        rows = np.repeat(np.arange(len(b)), [len(f) for f in b["f"]])
        codes[rows, [place[f] for own in b["f"] for f in own]] = [c for own in b["c"] for c in own]
        grower, at, trees, losses = _Local(codes, bins, n, settings), np.zeros(len(b)), [], []
        for _ in range(settings.iterations):
            tree, leaf = grower.grow(s - n * np.floor(at * unit + 0.5).astype(np.int64))
            at = at + settings.step * leaf / unit
            tree.feature = [features[f] if f >= 0 else f for f in tree.feature]
            trees.append(tree)
            if stop:
                losses.append(float((hq - 2 * at * hs + hn * at * at).sum() / hn.sum()) if hn.sum() else None)
                if _stops(losses, settings):
                    break
        return pd.DataFrame({"trees": [json.dumps([vars(t) for t in trees])]})

    table = points.select(*names, F.map_keys("_codes").alias("f"), F.map_values("_codes").alias("c"))
    return [Tree(**t) for t in json.loads(table.groupBy().applyInPandas(rounds, "trees string").first()[0])]  # at most iterations x leaves nodes


def boosted_trees(train: DataFrame, seed: int, settings: Boosting = Boosting(), held: Column | None = None) -> Ensemble:
    """Least-squares boosting with best-first trees over binned features.

    ``train`` is (row_id, features, y); ``held`` marks rows for early stopping (none: no early stopping).
    Rows with equal cells are one point.  Targets and predictions are rounded to whole multiples of a power of two
    small enough that sums of residuals are exact, so the result does not depend on the partitioning.
    """
    rows = cells(train.select("row_id", "features", F.col("y").cast("double").alias("y"), (F.lit(False) if held is None else held).alias("_held")))
    rows = written(rows)
    n, mean, low, high = rows.where("not _held").agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("no training rows")
    share = min(1.0, settings.cut_rows / n)
    placing = rows.where("not _held").where((F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else F.lit(True))
    entries = placing.select(F.explode("_cells").alias("c")).select(F.col("c.f").alias("feature"), F.col("c.v").alias("v"))
    cuts = written(cut_points(entries, placing.count() if share < 1 else n, settings.bins))
    code = lambda v: F.size(F.filter("cuts", lambda c: c < v)).cast("int")
    zero_bins = written(cuts.select("feature", code(F.lit(0.0)).alias("zero")))
    cut_of = {r.feature: r.cuts for r in cuts.collect()}  # features x bins
    if not cut_of:
        return Ensemble([], mean, settings.step)
    width = max(cut_of) + 1
    zero_of = [sum(c < 0 for c in cut_of.get(f, [])) for f in range(width)]
    unit = whole_unit(n, low, high)
    above, taught = F.col("y") - F.lit(mean), ~F.col("_held")
    sums = {"n": F.count_if(taught), "s": F.sum(F.when(taught, whole(above, unit)).otherwise(0)), "hn": F.count_if("_held"), "hs": F.sum(F.when(F.col("_held"), above).otherwise(0.0)), "hq": F.sum(F.when(F.col("_held"), above * above).otherwise(0.0))}
    points = written(rows.groupBy("_cells").agg(*[c.alias(k) for k, c in sums.items()]).withColumn("point", F.monotonically_increasing_id()))
    coded = points.select("point", F.explode("_cells").alias("c")).select("point", F.col("c.f").alias("feature"), F.col("c.v").alias("v")).join(F.broadcast(cuts), "feature")  # features x bins
    coded = coded.groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct("feature", code(F.col("v"))))).alias("_codes"))
    none = F.expr("cast(map() as map<int, int>)")
    rows = points.drop("_cells").join(coded, "point", "left").withColumn("_codes", F.coalesce("_codes", none))
    n_points, out = points.count(), Ensemble([], mean, settings.step)

    def finished(tree: Tree) -> Tree:
        tree.value = [v / unit for v in tree.value]
        tree.threshold = [cut_of[f][int(b)] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold, strict=True)]
        return tree

    if n_points * len(cut_of) <= settings.most_cells:
        out.trees = [finished(t) for t in _local_rounds(rows, sorted(cut_of), zero_of, max(map(len, cut_of.values())) + 1, unit, settings, held is not None)]
        out.by_vector = 2 * n_points <= n
        return out
    rows, path = write_table(spread(rows.withColumn("_f", F.lit(0.0)), n_points, "point"))
    losses: list[float | None] = []
    for _ in range(settings.iterations):
        seen = rows.withColumn("g", F.col("s") - F.col("n") * whole(F.col("_f"), unit))
        tree, leaf = _Grower(seen.where("n > 0"), zero_bins, zero_of, settings).grow()
        rows, last = write_table(seen.withColumn("_f", F.col("_f") + settings.step * leaf / unit).drop("g"))
        remove_table(rows.sparkSession, path)
        path = last
        out.trees.append(finished(tree))
        if held is not None:
            f = F.col("_f")
            losses.append(rows.agg(F.sum(F.col("hq") - 2 * f * F.col("hs") + F.col("hn") * f * f) / F.nullif(F.sum("hn"), F.lit(0))).first()[0])
            if _stops(losses, settings):
                break
    return out
