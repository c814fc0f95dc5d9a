"""Regression models, on MLlib and on the trees of ``trees``, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlens.operators import forests, trees
from benchlens.operators.folds import split
from benchlens.sources.results import written

#: Columns of the normal equations that MLlib solves directly.
MOST_NORMAL = 4096
#: The deepest trees of MLlib.
DEEPEST = 30
#: Fits that are submitted at once.
PARALLEL_FITS = 4

Fitted = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Sizes of the ensembles.  ``PAPER`` has those of the full study, whose forests have no limit of ``depth``; the default is a smaller one."""

    trees: int = 20
    depth: int | None = 5
    iterations: int = 20
    step: float = 0.05
    random_trees: int = 10
    bins: int = 64
    leaves: int = 31


PAPER = Settings(trees=300, depth=None, iterations=300, random_trees=300, bins=255)


def ridge(train: DataFrame, seed: int, settings: Settings, alpha: float = 1.0) -> Fitted:
    """Least squares with penalty ``alpha`` on the coefficients alone; MLlib's penalty is a mean, in
    units of the target's deviation."""
    n, std = train.agg(F.count("*"), F.stddev_pop("y")).first()
    width = len(train.first().features)
    solver = "normal" if width <= MOST_NORMAL else "l-bfgs"
    std = std if solver == "normal" else std * (n / max(n - 1, 1)) ** 0.5
    model = LinearRegression(labelCol="y", solver=solver, elasticNetParam=0.0, standardization=False, regParam=alpha * std / n).fit(train)
    return _transformer(model)


def random_forest(train: DataFrame, seed: int, settings: Settings) -> Fitted:
    """MLlib's on binned values; without a limit of depth on exact ones, as long as a task holds the distinct vectors."""
    if settings.depth is None and (vectors := forests.few_vectors(train)):
        return _transformer(forests.grow(train, seed, settings.trees, vectors, False))
    depth = DEEPEST if settings.depth is None else settings.depth
    return _transformer(RandomForestRegressor(labelCol="y", numTrees=settings.trees, featureSubsetStrategy="all", maxBins=settings.bins, maxDepth=depth, minInstancesPerNode=1, seed=seed).fit(train))


def extra_trees(train: DataFrame, seed: int, settings: Settings) -> Fitted:
    """Extremely random trees on all rows: a threshold drawn in a node's own range for each feature."""
    if settings.depth is None and (vectors := forests.few_vectors(train)):
        return _transformer(forests.grow(train, seed, settings.random_trees, vectors, True))
    return _transformer(trees.extremely_random_trees(train, seed, settings.random_trees, settings.depth))


def hist_gbrt(train: DataFrame, seed: int, settings: Settings) -> Fitted:
    """Best-first boosted trees with a tenth of the rows, chosen by hash, for early stopping."""
    held = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(10)) == 0
    return _transformer(trees.boosted_trees(train, seed, trees.Boosting(iterations=settings.iterations, step=settings.step, leaves=settings.leaves, bins=settings.bins), held))


def _transformer(model) -> Fitted:
    def apply(df: DataFrame) -> DataFrame:
        return model.transform(df)

    apply.model = model
    return apply


MODELS: dict[str, Callable[[DataFrame, int, Settings], Fitted]] = {"ridge": ridge, "random_forest": random_forest, "extra_trees": extra_trees, "hist_gbrt": hist_gbrt}


def select_models(names: list[str] | None = None) -> dict[str, Callable]:
    """The named models, or all; unknown names raise."""
    unknown = [n for n in names or [] if n not in MODELS]
    if unknown:
        raise ValueError(f"unknown models: {unknown}; known: {sorted(MODELS)}")
    return {n: MODELS[n] for n in (names or MODELS)}


def cross_validate(folded: DataFrame, names: list[str] | None = None, split_mode: str = "row_kfold", seed: int = 42, settings: Settings = Settings(), keep: dict | None = None, only: int | None = None) -> DataFrame:
    """Out-of-fold predictions (split_mode, model, fold, row_id, y_true, y_pred) of each model.

    ``folded`` is (row_id, features, y, fold).  Fits are submitted from a small pool of threads, each
    of them one MLlib job on the cluster; ``keep`` collects the fitted models by (model, fold).  With
    ``only``, that fold alone is held out.
    """
    models = select_models(names)
    folded = written(folded)  # every fit reads it
    folds = sorted(r.fold for r in folded.select("fold").distinct().collect())
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds")

    def one(job: tuple[str, int]) -> DataFrame:
        name, fold = job
        train, test = split(folded, fold)
        fitted = models[name](train, seed + fold, settings)
        if keep is not None:
            keep[name, fold] = fitted
        return fitted(test).select(F.lit(split_mode).alias("split_mode"), F.lit(name).alias("model"), F.lit(fold).alias("fold"), "row_id", F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(one, [(n, f) for n in models for f in folds if only in (None, f)]))
    return reduce(DataFrame.unionByName, parts)


def mean_predictor(folded: DataFrame, name: str, by: list[str], split_mode: str) -> DataFrame:
    """Out-of-fold means of the training rows with equal keys, or of all of them where there are none.

    ``folded`` is (row_id, y, fold, keys...).
    """
    every = folded.agg(F.sum("y").alias("_s"), F.count("y").alias("_n"))
    inside = folded.groupBy("fold").agg(F.sum("y").alias("_fs"), F.count("y").alias("_fn"))
    overall = inside.crossJoin(F.broadcast(every)).select("fold", ((F.col("_s") - F.col("_fs")) / (F.col("_n") - F.col("_fn"))).alias("_all"))  # one row a fold
    out = folded.join(F.broadcast(overall), "fold")
    guess = F.col("_all")
    if by:
        own = folded.groupBy(*by, "fold").agg(F.sum("y").alias("_ks"), F.count("y").alias("_kn"))
        total = own.groupBy(*by).agg(F.sum("_ks").alias("_ts"), F.sum("_kn").alias("_tn"))
        other = own.join(total, by).select(*by, "fold", F.when(F.col("_tn") > F.col("_kn"), (F.col("_ts") - F.col("_ks")) / (F.col("_tn") - F.col("_kn"))).alias("_own"))
        out = out.join(other, [*by, "fold"])
        guess = F.coalesce("_own", "_all")
    return out.select(F.lit(split_mode).alias("split_mode"), F.lit(name).alias("model"), "fold", "row_id", F.col("y").alias("y_true"), guess.alias("y_pred"))
