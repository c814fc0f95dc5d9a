"""Fold assignment: by rows, by groups, shuffled groups; samples and leakage audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benchlens.sources.results import written

#: Hex digits of a hash by which rows are ranked apart; the table of prefixes is broadcast (65,536 rows).
PREFIX_DIGITS = 4


def order_key(key: Column, *parts) -> Column:
    """The md5 of a key and further parts: a random order that is the same on any partitioning."""
    return F.md5(F.concat_ws("::", key.cast("string"), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def row_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..k-1 by shuffled rows; sizes differ by one at most, larger ones first.

    Rows are ranked by hash within hash prefixes; the counts of the 16**PREFIX_DIGITS prefixes give
    each prefix its offset, so no task sorts all rows.
    """
    if k < 2:
        raise ValueError("at least 2 folds")
    hashed = df.withColumn("_h", order_key(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    counts = hashed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_offset"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("_h", key)) - 1).join(F.broadcast(offsets), "_p")
    place = F.col("_offset") + F.col("_r")
    small, larger = F.expr(f"_total div {int(k)}"), F.col("_total") % k
    edge = larger * (small + 1)
    fold = F.when(place < edge, F.call_function("div", place, small + 1)).otherwise(larger + F.call_function("div", place - edge, F.greatest(small, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_h", "_p", "_r", "_offset", "_total")


def rank_within(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) in its group by ``order``; a group of any size is ranked by many tasks.

    Rows are dealt by ranges and kept; each range counts its part of a group, and the counts of the
    ranges before it are its offset.
    """
    dealt = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    # a group has as many rows here as there are ranges with a part of it
    offsets = counts.select(*by, "_range", (F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_offset"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)) - 1)
    return ranked.join(offsets, [*by, "_range"]).withColumn("rank", F.col("_offset") + F.col("_r")).drop("_range", "_r", "_offset")


def deal_sizes(sizes: Iterator[tuple[int, int]], k: int) -> Iterator[tuple[int, int, list[int]]]:
    """Deal groups size by size, largest first, each to the lightest of k folds so far (ties: least fold).

    ``sizes`` is (size, how many groups).  Within one size, fold f would take its groups at loads
    load_f, load_f + size, ...; the groups take these places in order.  So they go round a fixed list of
    folds until the next heavier fold comes to its turn: k stretches at most, however many groups.
    Yields (size, first rank of the stretch, folds in turn).
    """
    loads = [0] * k
    for size, count in sizes:
        if not size:  # empty groups weigh nothing: the lightest fold takes them all
            yield size, 0, [min(range(k), key=lambda f: (loads[f], f))]
            continue
        begin, waiting, turns = 0, sorted((load, f) for f, load in enumerate(loads)), []
        while begin < count:
            turns = sorted([*turns, waiting.pop(0)])
            n = count - begin
            if waiting:  # only the places that come before the next heavier fold's first one
                load_next, f_next = waiting[0]
                n = min(n, sum(max(0, -((load - load_next) // size) + ((load_next - load) % size == 0 and f < f_next)) for load, f in turns))
            if n:
                yield size, begin, [f for _, f in turns]
            whole, rest = divmod(n, len(turns))
            turns = [(load + size * (whole + (i < rest)), f) for i, (load, f) in enumerate(turns)]
            begin += n
        for load, f in turns:
            loads[f] = load


def group_folds(groups: DataFrame, group: str, k: int = 5, size: str = "n") -> DataFrame:
    """(group, fold): largest groups first, each to the lightest fold so far (ties: least id, least fold).

    ``groups`` has one row for each group.  Dealing is sequential, but groups of equal size differ by their
    rank alone: one task deals the distinct sizes (no more than the root of twice the number of rows), and
    every group finds its fold by its rank within its size.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        stretches: list[tuple[int, int, list[int]]] = []
        for row in deal_sizes(pairs, k):
            stretches.append(row)
            if len(stretches) == 1024:
                yield _stretches(stretches)
                stretches = []
        if stretches:
            yield _stretches(stretches)

    sized = groups.select(F.col(group), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    ranked = rank_within(sized, ["_size"], [group])
    counts = ranked.groupBy("_size").agg(F.count("*").alias("_count")).repartition(1).sortWithinPartitions(F.desc("_size"))
    dealt = counts.mapInArrow(deal, "_size long, _begin long, _turns array<int>")
    steps = dealt.groupBy("_size").agg(F.sort_array(F.collect_list(F.struct("_begin", "_turns"))).alias("_steps"))  # k of them at most
    step = F.element_at(F.filter("_steps", lambda s: s["_begin"] <= F.col("rank")), -1)
    fold = F.get(F.col("_step._turns"), F.pmod(F.col("rank") - F.col("_step._begin"), F.size("_step._turns")).cast("int"))
    return ranked.join(steps, "_size").withColumn("_step", step).select(group, fold.alias("fold"))


def _stretches(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    size, begin, turns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(begin, pa.int64()), pa.array(turns, pa.list_(pa.int32()))], names=["_size", "_begin", "_turns"])


def with_group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``df`` with ``fold`` by whole groups; raises if there are fewer groups than folds."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    if sizes.limit(k).count() < k:
        raise ValueError(f"{k} folds need {k} groups")
    return df.join(group_folds(sizes, group, k), group)


def shuffled_group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, rep: int = 0) -> DataFrame:
    """(group, fold): distinct groups in a random order, cut into k near-equal parts."""
    return row_folds(df.select(group).where(F.col(group).isNotNull()).distinct(), group, k, f"{seed}:{rep}")


def split(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold."""
    return folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)


def sample(df: DataFrame, by: list[str], key: str, n: int, seed: int | Column = 42, role: str = "eval") -> DataFrame:
    """Up to n rows of each group, without replacement, the same on any partitioning; keys are unique in a group.

    Only hashes and keys are ranked, in two steps, by shards first, so a group of any size never meets in
    one task; other columns are joined to the keys that were drawn.
    """
    hashed = df.select(*by, key).withColumn("_h", order_key(F.col(key), seed, role)).withColumn("_s", F.substring("_h", -2, 2))
    some = hashed.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_s").orderBy("_h", key))).where(F.col("_r") <= n)
    drawn = some.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h", key))).where(F.col("_r") <= n).select(*by, key)
    if set(df.columns) == {*by, key}:
        return drawn.select(df.columns)
    names = [*by, key]
    other = drawn.select(*[F.col(c).alias(f"_{c}") for c in names])
    return df.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]), "left_semi")


def first_by_hash(df: DataFrame, group: str, key: str, n: int, sizes: dict[int, int], seed: int | Column = 42, role: str = "eval") -> DataFrame:
    """Rows of each group whose hash lies below a bound that about 4 n + 100 of its rows keep; nothing is sorted.

    Where a group keeps n of them (or all rows), ``sample`` draws the same from these as from ``df``; the
    caller counts them.  ``sizes`` has the rows of each of a few groups.
    """
    bounds = F.create_map(*[F.lit(x) for g, size in sizes.items() for x in (g, int((1 << 32) * min(1.0, (4 * n + 100) / max(size, 1))))])
    place = F.conv(F.substring(order_key(F.col(key), seed, role), 1, 8), 16, 10).cast("long")
    return df.where(place < F.element_at(bounds, F.col(group)))


def leakage(folded: DataFrame, entity: str) -> DataFrame:
    """For each fold, how many entities of its test rows occur in its training rows too."""
    pairs = folded.select(entity, "fold").distinct()
    spread = pairs.groupBy(entity).agg(F.count("*").alias("folds"))
    return pairs.join(spread, entity).groupBy("fold").agg(F.count("*").alias("entities"), F.sum(F.when(F.col("folds") > 1, 1).otherwise(0)).alias("shared"))
