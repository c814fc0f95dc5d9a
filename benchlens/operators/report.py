"""Roll-ups of finished runs: anchors, summaries, chart-ready tables and formatted ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benchlens.functions.text import display_name, mean_std, model_label, representation_label
from benchlens.operators.explain import global_importance
from benchlens.operators.metrics import METRICS


def labelled_union(frames: dict[str, DataFrame], label: str = "experiment") -> DataFrame:
    """All runs' tables with a column that names each; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(name)) for name, df in frames.items()])


def predictive_anchor(summary: DataFrame, split_mode: str = "task_group_kfold") -> DataFrame:
    """Scores of all experiments under one protocol, best first in each."""
    return summary.where(F.col("split_mode") == split_mode).orderBy("experiment", F.desc("r2_mean"), "model")


def top_features(importance: DataFrame, by: list[str], n: int = 12) -> DataFrame:
    """The n most important features of each group, with readable names and labels."""
    order = W.partitionBy(*by).orderBy(F.desc("mean_abs_shap"), F.desc("feature"))
    top = importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.select(*by, "rank", display_name(F.col("feature")).alias("feature"), "mean_abs_shap")


def top_of_one(by_fold: DataFrame, n: int = 12) -> DataFrame:
    """The n features of one model with the largest mean over folds."""
    return global_importance(by_fold).select("feature", "mean_abs_shap", "std_abs_shap").orderBy(F.desc("mean_abs_shap"), F.desc("feature")).limit(n)


def score_chart(summary: DataFrame) -> DataFrame:
    """Mean R2 by representation and model label."""
    return summary.select(representation_label(F.col("experiment")).alias("representation"), model_label(F.col("model")).alias("model"), "split_mode", "r2_mean", "r2_std")


def score_table(summary: DataFrame, decimals: int = 3) -> DataFrame:
    """``mean ± std`` of each metric."""
    return summary.select("experiment", "model", "split_mode", *[mean_std(F.col(f"{m}_mean"), F.col(f"{m}_std"), decimals).alias(m) for m in METRICS])


def agg_mode_table(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("max", "mean")) -> DataFrame:
    """R2 of two target aggregations side by side, for the runs that both have."""
    keys = ["experiment", "model", "split_mode"]
    left, right = (x.select(*keys, F.col("r2_mean").alias(f"r2_{n}")) for x, n in zip((a, b), names, strict=True))
    return left.join(right, keys).withColumn("r2_difference", F.col(f"r2_{names[0]}") - F.col(f"r2_{names[1]}"))


def robust_table(summary: DataFrame, decimals: int = 4) -> DataFrame:
    """Repeated-validation scores, rounded half to even."""
    return summary.select(*[c for c in summary.columns if not c.startswith(METRICS)], *[F.bround(c, decimals).alias(c) for m in METRICS for c in (f"{m}_mean", f"{m}_std")])


def interaction_chart(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("experiment", "model").agg(F.avg("interaction_ratio").alias("interaction_ratio"))
