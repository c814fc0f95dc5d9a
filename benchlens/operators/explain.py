"""Attribution tables (..., fold, row_id, feature_id, feature, shap) and what is read from them.

Zeros may be absent: means divide by the number of explained rows and folds, and top-k lists are
filled up with absent features, highest id first, as ties are broken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benchlens.functions.text import is_readable
from benchlens.operators.folds import PREFIX_DIGITS

TOP_K, MASS = 10, 0.8


def linear_attributions(features: DataFrame, weights: DataFrame, background: DataFrame) -> DataFrame:
    """(row_id, feature, shap) of a linear model: weight times distance from the background's mean.

    ``features`` and ``background`` are dense (row_id, feature, value); ``weights`` is (feature, weight).
    """
    means = background.groupBy("feature").agg(F.avg("value").alias("_mean"))
    known = F.broadcast(weights.join(means, "feature"))  # one row for each feature of the model
    return features.join(known, "feature").select("row_id", "feature", (F.col("weight") * (F.col("value") - F.col("_mean"))).alias("shap"))


def mean_abs(attr: DataFrame, by: list[str]) -> DataFrame:
    """Mean magnitude of each feature over the explained rows of each group (fold)."""
    rows = attr.select(*by, "row_id").distinct().groupBy(*by).agg(F.count("*").alias("_n"))
    sums = attr.groupBy(*by, "feature_id", "feature").agg(F.sum(F.abs("shap")).alias("_s"))
    return sums.join(F.broadcast(rows), by).select(*by, "feature_id", "feature", (F.col("_s") / F.col("_n")).alias("mean_abs_shap"))


def global_importance(by_fold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation over all folds of each feature's mean magnitude, largest first.

    A fold in which a feature is absent counts as 0.  Folds are few, so each feature's list is short.
    """
    by = by or []
    folds = by_fold.select(*by, "fold").distinct()
    count = folds.groupBy(*by).agg(F.count("*").alias("_k"))
    lists = by_fold.groupBy(*by, "feature_id", "feature").agg(F.collect_list("mean_abs_shap").alias("_v"))
    joined = lists.join(F.broadcast(count), by) if by else lists.crossJoin(F.broadcast(count))  # one row
    total = lambda f: F.aggregate("_v", F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / F.col("_k")
    out = joined.withColumn("_m", mean)
    spread = (total(lambda x: (x - F.col("_m")) * (x - F.col("_m"))) + (F.col("_k") - F.size("_v")) * F.col("_m") * F.col("_m")) / F.col("_k")
    return out.select(*by, "feature_id", "feature", F.col("_m").alias("mean_abs_shap"), F.sqrt(spread).alias("std_abs_shap")).orderBy(*by, F.desc("mean_abs_shap"), F.desc("feature_id"))


def _strongest(by: list[str], value: Column) -> W:
    return W.partitionBy(*by).orderBy(F.desc(value), F.desc("feature_id"))


def local_topk(attr: DataFrame, by: list[str], k: int = TOP_K, dictionary: DataFrame | None = None) -> DataFrame:
    """The k features of each explained row with the largest magnitudes, with ``rank`` 1..k.

    With a ``dictionary`` (feature_id, feature), rows with fewer nonzero features are filled up.
    """
    kept = attr.where("shap <> 0") if dictionary is not None else attr
    if dictionary is not None:
        last = dictionary.orderBy(F.desc("feature_id")).limit(2 * k)  # enough: fewer than k of them are taken
        spare = last.agg(F.collect_list(F.struct("feature_id", "feature")).alias("_spare"))
        rows = attr.groupBy(*by).agg(F.collect_set(F.when(F.col("shap") != 0, F.col("feature_id"))).alias("_have")).where(F.size("_have") < k)
        fill = rows.crossJoin(F.broadcast(spare)).select(*by, "_have", F.explode("_spare").alias("_f")).where(~F.array_contains("_have", F.col("_f.feature_id")))
        kept = kept.select(*by, "feature_id", "feature", "shap").unionByName(fill.select(*by, "_f.feature_id", "_f.feature", F.lit(0.0).alias("shap")))
    return kept.withColumn("rank", F.row_number().over(_strongest(by, F.abs("shap")))).where(F.col("rank") <= k).select(*by, "rank", "feature_id", "feature", "shap")


def readability(topk: DataFrame, by: list[str]) -> DataFrame:
    """Share of readable features among each row's top-k."""
    return topk.groupBy(*by).agg(F.avg(is_readable(F.col("feature")).cast("double")).alias("readability"))


def sparsity(attr: DataFrame, by: list[str], mass: float = MASS) -> DataFrame:
    """How few features reach ``mass`` of each row's total magnitude; 0 where the total is 0."""
    size = F.abs("shap")
    running = F.sum(size).over(_strongest(by, size).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(size).over(W.partitionBy(*by))
    short = F.when((F.col("_t") > 0) & (F.col("_c") / F.col("_t") < mass), 1).otherwise(0)
    summed = attr.withColumn("_c", running).withColumn("_t", total).groupBy(*by).agg(F.sum(short).alias("_short"), F.max("_t").alias("_t"))
    return summed.select(*by, F.when(F.col("_t") > 0, F.col("_short") + 1).otherwise(0).cast("long").alias("sparsity"))


def local_metrics(attr: DataFrame, by: list[str], k: int = TOP_K, mass: float = MASS, dictionary: DataFrame | None = None) -> DataFrame:
    """Readability and sparsity of every explained row."""
    read = readability(local_topk(attr, by, k, dictionary), by)
    return read.join(sparsity(attr, by, mass), by).select(*by, "readability", "sparsity", F.lit(k).alias("top_k"), F.lit(mass).alias("sparsity_mass"))


def global_topk(by_fold: DataFrame, by: list[str], k: int = TOP_K) -> DataFrame:
    """The k strongest features of each fold, with ``rank`` 1..k."""
    return by_fold.withColumn("rank", F.row_number().over(_strongest(by, F.col("mean_abs_shap")))).where(F.col("rank") <= k).select(*by, "rank", "feature_id", "feature", "mean_abs_shap")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; null for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union.cast("double"))


def fold_stability(topk: DataFrame, by: list[str] | None = None, k: int = TOP_K) -> DataFrame:
    """Jaccard overlap of the top-k sets of all fold pairs of a run."""
    by = by or []
    sets = topk.groupBy(*by, "fold").agg(F.sort_array(F.collect_set("feature")).alias("s"))
    a, b = (sets.select(*by, F.col("fold").alias(f"fold_{x}"), F.col("s").alias(f"_{x}")) for x in "ab")
    near = a.join(b, [*by]) if by else a.join(b, F.col("fold_a") < F.col("fold_b"))  # as many rows as folds
    return near.where("fold_a < fold_b").select(*by, "fold_a", "fold_b", F.lit(k).alias("top_k"), jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))


def stability_summary(stability: DataFrame, by: list[str]) -> DataFrame:
    return stability.groupBy(*by).agg(F.avg("jaccard").alias("stability_mean"), F.stddev_pop("jaccard").alias("stability_std"))


def local_summary(local: DataFrame, by: list[str]) -> DataFrame:
    """Number, means and population deviations of readability and sparsity."""
    return local.groupBy(*by).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{n}") for m in ("readability", "sparsity") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def shap_summary(local: DataFrame, stability: DataFrame, by: list[str], k: int = TOP_K, mass: float = MASS) -> DataFrame:
    """One row for each run: local metrics beside the stability of its global top-k."""
    a = local_summary(local, by).withColumnRenamed("n", "n_local_explanations")
    b = stability_summary(stability, by).withColumnsRenamed({"stability_mean": "global_topk_stability_mean", "stability_std": "global_topk_stability_std"})
    return a.join(b, by, "left").withColumns({"top_k": F.lit(k), "sparsity_mass": F.lit(mass)})


def interaction_ratio(interactions: DataFrame, by: list[str]) -> DataFrame:
    """Off-diagonal share of the mean absolute interactions; null where all are 0.

    The mean over rows divides both sums by the same number, so the sums are enough.
    """
    size = F.abs("value")
    sums = interactions.groupBy(*by).agg(F.sum(F.when(F.col("feature_i") != F.col("feature_j"), size).otherwise(0.0)).alias("_off"), F.sum(size).alias("_all"))
    return sums.select(*by, F.when(F.col("_all") > 0, F.col("_off") / F.col("_all")).alias("interaction_ratio"))


def product_interaction_ratio(attr: DataFrame, by: list[str]) -> DataFrame:
    """``interaction_ratio`` where pairs interact by the product of their attributions, over all features.

    A row's magnitudes sum to ``sum(abs(shap)) ** 2`` over all pairs and ``sum(shap ** 2)`` on the
    diagonal, so no pair is made.
    """
    rows = attr.groupBy(*by, "row_id").agg(F.sum(F.abs("shap")).alias("_s"), F.sum(F.col("shap") * F.col("shap")).alias("_q"))
    sums = rows.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s") - F.col("_q")).alias("_off"), F.sum(F.col("_s") * F.col("_s")).alias("_all"))
    return sums.select(*by, F.when(F.col("_all") > 0, F.col("_off") / F.col("_all")).alias("interaction_ratio"))


def keep_last(rows: DataFrame, key: list[str], having: str) -> DataFrame:
    """One row for each key; one whose ``having`` is known wins, then the largest."""
    order = W.partitionBy(*key).orderBy(F.col(having).isNotNull().desc(), F.desc(having))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def common_row(attr: DataFrame, run: str, a: str, b: str) -> DataFrame:
    """The least row that two runs both explain."""
    rows = attr.where(F.col(run) == a).select("row_id").intersect(attr.where(F.col(run) == b).select("row_id"))
    return rows.agg(F.min("row_id").alias("row_id")).where("row_id is not null")


def case_study(attr: DataFrame, run: str, runs: list[str], k: int = TOP_K) -> DataFrame:
    """Top-k signed contributions of one row, for several runs that all explain it."""
    row = common_row(attr, run, runs[0], runs[-1])
    own = attr.where(F.col(run).isin(runs)).join(F.broadcast(row), "row_id")  # one row
    return local_topk(own, [run, "row_id"], k)


def _exchanged(values: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(feature, rep, row_id, value, _new): every value beside another row's, for each feature and repeat.

    Two hash orders number all rows of a feature, and equal numbers pair: a full shuffle.  Rows are
    numbered within hash prefixes, whose counts give each prefix its offset, so no task holds all rows
    of a feature.
    """
    many = values.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = ["feature", "rep"]

    def numbered(role: str) -> DataFrame:
        place = F.md5(F.concat_ws("::", F.col("row_id").cast("string"), F.col("feature").cast("string"), F.col("rep").cast("string"), F.lit(str(seed)), F.lit(role)))
        hashed = many.withColumn("_h", place).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
        counts = hashed.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
        offsets = counts.select(*by, "_p", (F.sum("_n").over(W.partitionBy(*by).orderBy("_p")) - F.col("_n")).alias("_offset"))
        ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_p").orderBy("_h", "row_id")))
        return ranked.join(offsets, [*by, "_p"]).withColumn("_r", F.col("_r") + F.col("_offset")).drop("_h", "_p", "_offset")

    right = numbered("from").select(*by, "_r", F.col("value").alias("_new"))
    return numbered("to").join(right, [*by, "_r"]).drop("_r")


def _importance(after: DataFrame, before: DataFrame) -> DataFrame:
    rise = after.crossJoin(F.broadcast(before)).select("feature", (F.col("_after") - F.col("_mse")).alias("rise"))  # one row
    return rise.groupBy("feature").agg(F.avg("rise").alias("importance_mean"), F.stddev_pop("rise").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")


def permutation_importance(features: DataFrame, weights: DataFrame, intercept: float, truth: DataFrame, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Rise of a linear model's squared error when one feature's values change places.

    The change of a prediction is ``weight * (new - old)``, so predictions are made once.
    """
    known = features.join(F.broadcast(weights), "feature")
    base = known.groupBy("row_id").agg((F.sum(F.col("weight") * F.col("value")) + intercept).alias("pred")).join(truth, "row_id").select("row_id", (F.col("y") - F.col("pred")).alias("e"))
    before = base.agg(F.avg(F.col("e") * F.col("e")).alias("_mse"))
    moved = _exchanged(known, repeats, seed).select("feature", "rep", "row_id", (F.col("weight") * (F.col("_new") - F.col("value"))).alias("d"))
    left = F.col("e") - F.col("d")
    return _importance(moved.join(base, "row_id").groupBy("feature", "rep").agg(F.avg(left * left).alias("_after")), before)


def permutation_importance_of(fitted: Callable[[DataFrame], DataFrame], rows: DataFrame, feature_ids: list[int], repeats: int = 10, seed: int = 42) -> DataFrame:
    """The same for any fitted model and chosen positions of (row_id, features, y): each row is scored
    once for each feature and repeat, all in one job.  ``feature`` is the position."""
    arrays = rows.select("row_id", "y", vector_to_array("features").alias("_x"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.get("_x", F.lit(i)).alias("value")) for i in feature_ids]))
    values = arrays.select("row_id", pairs.alias("p")).select("row_id", "p.feature", "p.value")
    moved = _exchanged(values, repeats, seed).join(arrays, "row_id")
    changed = moved.select("feature", "rep", "y", array_to_vector(F.transform("_x", lambda v, i: F.when(i == F.col("feature"), F.col("_new")).otherwise(v))).alias("features"))
    error = F.col("y") - F.col("prediction")
    before = fitted(rows).agg(F.avg(error * error).alias("_mse"))
    return _importance(fitted(changed).groupBy("feature", "rep").agg(F.avg(error * error).alias("_after")), before)
