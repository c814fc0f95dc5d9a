"""Whole runs: from raw tables to result tables, for one configuration or a grid."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators import attribution, encoder_store, explain, feature_model, features, folds, metrics, report, tables
from benchlens.operators import models as regressors
from benchlens.plans.stages import Stages
from benchlens.sources import results

#: Runs of a grid that are under way at once.
RUNS_AT_ONCE = 2


@dataclass(frozen=True)
class Config:
    """One experiment."""

    name: str
    text_mode: str = "tfidf"
    use_task_metafeatures: bool = True
    agg_mode: str = "mean"
    models: tuple[str, ...] = ("hist_gbrt", "random_forest")
    run_row_kfold: bool = True
    run_task_group_kfold: bool = True
    cv_folds: int = 5
    seed: int = 42
    prefixes: tuple[str, ...] = (tables.PREFIX,)
    max_features: int = 5000
    max_df: float = 0.95
    fit_scope: str = "all"
    compute_shap: bool = False
    shap_background: int = 200
    shap_eval: int = 100
    compute_interactions: bool = False
    interaction_eval: int = 50
    top_k: int = explain.TOP_K
    mass: float = explain.MASS
    settings: regressors.Settings = field(default_factory=regressors.Settings)
    #: For text_mode embedding without given vectors; the name stands for the encoder in the store of vectors.
    encoder: features.Encoder | None = None
    encoder_name: str = "encoder"

    def check(self) -> None:
        if self.text_mode not in features.TEXT_MODES:
            raise ValueError(f"text_mode {self.text_mode!r}")
        if self.fit_scope not in ("all", "fold"):
            raise ValueError(f"fit_scope {self.fit_scope!r}")
        if self.agg_mode not in ("mean", "max"):
            raise ValueError(f"agg_mode {self.agg_mode!r}")
        if not (self.run_row_kfold or self.run_task_group_kfold):
            raise ValueError("no protocol selected")
        if self.text_mode == "none" and not self.use_task_metafeatures:
            raise ValueError("no features selected")
        regressors.select_models(list(self.models))


def supervise(evals: DataFrame, raw_tasks: DataFrame, raw_flows: DataFrame, config: Config, stages: Stages) -> tuple[DataFrame, list[str]]:
    """The supervised table of a configuration, and its metafeatures."""
    known, meta = tables.normalize_tasks(raw_tasks)
    prefixes = list(config.prefixes)

    def join() -> DataFrame:
        flows = stages.table("flows", {"prefixes": prefixes}, lambda: tables.relevant_flows(tables.normalize_flows(raw_flows), evals, config.prefixes))
        # only evaluations of these flows are parsed and grouped
        targets = stages.table("targets", {"agg_mode": config.agg_mode, "prefixes": prefixes}, lambda: tables.aggregate_evaluations(tables.restrict_evaluations(evals, flows), agg_mode=config.agg_mode))
        return tables.supervised_table(targets, known, flows)

    return stages.table("supervised", {"agg_mode": config.agg_mode, "prefixes": prefixes}, join), meta


def run(spark: SparkSession, evals: DataFrame, raw_tasks: DataFrame, raw_flows: DataFrame, config: Config, root: str, vectors: DataFrame | None = None, stages: Stages | None = None) -> dict[str, DataFrame]:
    """One experiment: its tables are written below ``root`` and returned as read back.

    What does not depend on the whole configuration (targets, supervised table, term weights, folds,
    features) and what takes long (each protocol's fits) are stages, which runs of one root share and a run
    that failed finds again.
    """
    config.check()
    out: dict[str, DataFrame] = {}
    root = root.rstrip("/")
    stages = stages or Stages(spark, root, inputs_of(evals, raw_tasks, raw_flows, vectors))

    def keep(kind: str, df: DataFrame) -> DataFrame | None:
        if results.write_result(df, root, kind, config.name, config.agg_mode):
            out[kind] = spark.read.parquet(f"{root}/{kind}/agg_mode={config.agg_mode}/run={config.name}")
            return out[kind]
        return None

    supervised, meta = supervise(evals, raw_tasks, raw_flows, config, stages)
    if keep("supervised", supervised) is None:
        raise ValueError("no supervised rows")
    own_meta = meta if config.use_task_metafeatures else []
    # Vectors made inside the row; texts whose weights all runs share, and embeddings, go by long rows.
    direct = config.text_mode == "none" or (config.text_mode == "tfidf" and config.fit_scope == "fold")
    rows = supervised.select("row_id", "task_id", F.col("target_value").alias("y"), *(own_meta if direct else []), *(["flow_text_clean"] if direct and config.text_mode == "tfidf" else []))
    if direct:
        rows = results.written(features.with_text_key(rows, "flow_text_clean") if config.text_mode == "tfidf" else rows)
    # Pairs of task and flow, and so folds and features, are the same whatever their values are aggregated to.
    same = {"prefixes": list(config.prefixes), "cv_folds": config.cv_folds, "seed": config.seed}
    assign = {}
    if config.run_row_kfold:
        assign["row_kfold"] = lambda: folds.row_folds(rows.select("row_id", "task_id"), "row_id", config.cv_folds, config.seed)
    if config.run_task_group_kfold:
        assign["task_group_kfold"] = lambda: folds.with_group_folds(rows.select("row_id", "task_id"), "task_id", config.cv_folds)
    protocols = {mode: rows.drop("task_id").join(stages.table("folds", {**same, "mode": mode}, lambda make=make: make().select("row_id", "fold")), "row_id") for mode, make in assign.items()}
    fitted_on = {"fit_scope": config.fit_scope} | ({**same, "modes": list(protocols)} if config.fit_scope == "fold" else {})
    chosen = {"text_mode": config.text_mode, "meta": config.use_task_metafeatures, "encoder": config.encoder_name if config.encoder else None, "max_features": config.max_features, "max_df": config.max_df, "prefixes": same["prefixes"]}
    if direct:
        words = features.tokenized_clean(supervised, "flow_text_clean") if config.text_mode == "tfidf" else None
        protocols = {mode: results.written(folded) for mode, folded in protocols.items()}  # every fold's fits read them
        kept = stages.table("features", chosen | fitted_on, lambda: feature_model.fitted_table(spark, _fitted(rows, protocols, words, own_meta, config)))
        long = FoldFeatures(words, feature_model.fitted_models(kept), own_meta)
        if keep("features", kept) is not None:
            out["features"] = feature_model.long_features(out["supervised"], long.models)
        known = {n for m in long.models.values() for n in m.names}
        dictionary = spark.createDataFrame(list(enumerate(sorted(known, key=lambda n: (n.startswith(features.META), n)))), "feature_id int, feature string")
    else:
        long = stages.table("features", chosen | fitted_on, lambda: _features(spark, supervised, meta, config, root, vectors, protocols, stages))
        keep("features", long)
        dictionary = results.written(features.feature_dictionary(long))
    if config.fit_scope == "all" and config.text_mode != "embedding":
        params = {"textCol": "flow_text" if config.text_mode == "tfidf" else "", "numericCols": own_meta, "maxFeatures": config.max_features, "maxDF": config.max_df}
        fitted = long.models[None, None]._set(**params) if direct else feature_model.FeatureEstimator(**params).fit(supervised)
        fitted.write().overwrite().save(f"{root}/models/{config.agg_mode}-{config.name}/features")
    names, by = list(config.models), ["split_mode", "model"]
    payload = {"config": repr(replace(config, name="", encoder=None))}
    done = [stages.tables("fits", {**payload, "mode": mode}, lambda mode=mode, folded=folded: _fits(spark, mode, folded, long, dictionary, config, root)) for mode, folded in protocols.items()]
    every = lambda kind: union([d[kind] for d in done])
    predictions = keep("predictions", every("predictions"))
    cv = keep("cv_results", metrics.fold_metrics(predictions, [*by, "fold"]))
    keep("summary", metrics.summarize(cv))
    keep("wilcoxon_mse", metrics.wilcoxon(cv, "mse"))
    keep("wilcoxon_r2", metrics.wilcoxon(cv, "r2"))
    if config.compute_shap:
        shap = every("attributions")
        if config.fit_scope == "fold":  # one numbering for the features of all folds
            shap = shap.drop("feature_id").join(F.broadcast(dictionary), "feature")
        shap = keep("local_shap", shap)
        keep("explained_rows", every("explained").join(predictions, [*by, "fold", "row_id"]))
        by_fold = explain.mean_abs(shap, [*by, "fold"])
        keep("global_shap", explain.global_importance(by_fold, by))
        local = keep("local_shap_metrics", explain.local_metrics(shap, [*by, "fold", "row_id"], config.top_k, config.mass, dictionary))
        top = keep("global_shap_topk", explain.global_topk(by_fold, [*by, "fold"], config.top_k))
        stability = keep("global_shap_stability", explain.fold_stability(top, by, config.top_k))
        keep("shap_summary_metrics", explain.shap_summary(local, stability, by, config.top_k, config.mass))
        if all("pairs" in d for d in done):
            keep("interaction_metrics", explain.interaction_ratio(every("pairs"), [*by, "fold"]))
    results.write_metadata(spark, root, f"{config.agg_mode}-{config.name}", {"name": config.name, "agg_mode": config.agg_mode, "text_mode": config.text_mode, "use_task_metafeatures": config.use_task_metafeatures, "fit_scope": config.fit_scope, "cv_folds": config.cv_folds, "seed": config.seed, "models": names})
    return out


@dataclass(frozen=True)
class FoldFeatures:
    """What rows' vectors are made from: the words of distinct texts (or None) and the models by protocol and fold."""

    words: DataFrame | None
    models: dict[tuple[str | None, int | None], feature_model.FeatureModel]
    columns: list[str]


def _fitted(rows: DataFrame, protocols: dict[str, DataFrame], words: DataFrame | None, columns: list[str], config: Config) -> dict[tuple[str | None, int | None], feature_model.FeatureModel]:
    """Feature models of all rows, or of each protocol's and fold's training rows.

    Training rows are counted by text, so a fold's terms are chosen from distinct texts.
    """
    models = {}
    for mode, fold in [(None, None)] if config.fit_scope == "all" else [(m, k) for m in protocols for k in range(config.cv_folds)]:
        train = rows if mode is None else protocols[mode].where(F.col("fold") != fold)
        terms = []
        if words is not None:
            seen = results.written(train.groupBy("text_key").agg(F.count("*").alias("n_rows")))
            n = seen.agg(F.sum("n_rows")).first()[0] or 0
            terms = features.fitted(results.written(words.drop("n_rows").join(seen, "text_key")), n, config.max_features, config.max_df)[0]
        stats = features.numeric_statistics(train, columns) if columns else {}
        models[mode, fold] = feature_model.FeatureModel([t.term for t in terms], [t.idf for t in terms], stats)
    return models


def inputs_of(*frames: DataFrame | None) -> list[DataFrame]:
    return [f for f in frames if f is not None]


def _fits(spark: SparkSession, mode: str, folded: DataFrame, long: DataFrame, dictionary: DataFrame, config: Config, root: str) -> dict[str, DataFrame | None]:
    """Predictions of all models and folds of a protocol and, where asked for, attributions, pairs and explained rows."""
    parts, attributions, pairs, rows_explained = [], [], [], []
    # Features fitted on all rows serve every fold; those fitted on training rows have a matrix each.
    for only in [None] if config.fit_scope == "all" else range(config.cv_folds):
        own: dict = {}
        if isinstance(long, FoldFeatures):
            model = long.models.get((None, None) if only is None else (mode, only), feature_model.FeatureModel())
            weights = features.text_weights(long.words, model.vocabulary, model.idf) if model.vocabulary else None
            known = spark.createDataFrame(list(enumerate(model.names)), "feature_id int, feature string")
            matched = features.row_vectors(folded, weights, len(model.vocabulary), model.numeric, long.columns)
        else:
            seen = long if only is None else long.where((F.col("split_mode") == mode) & (F.col("fold") == only)).drop("split_mode", "fold")
            known = dictionary if only is None else results.written(features.feature_dictionary(seen))
            matrix = features.to_vectors(seen, known, known.count())
            matched = results.written(folded.join(matrix, "row_id").select("row_id", "features", "y", "fold"))
        parts.append(regressors.cross_validate(matched, list(config.models), mode, config.seed, config.settings, own, only))
        some = drawn(matched, sorted({fold for _, fold in own}), config) if config.compute_shap else None
        for (name, fold), model in own.items() if config.compute_shap else ():
            a, b, c = explained(spark, some, model, name, fold, mode, config, root, known)
            attributions.append(a)
            pairs += [b] if b is not None else []
            rows_explained.append(c)
    every = lambda frames: union(frames) if frames else None
    return {"predictions": union(parts), "attributions": every(attributions), "pairs": every(pairs), "explained": every(rows_explained)}


def _features(spark: SparkSession, supervised: DataFrame, meta: list[str], config: Config, root: str, vectors: DataFrame | None, protocols: dict[str, DataFrame], stages: Stages) -> DataFrame:
    """Features of all rows; with ``fit_scope`` fold, those of each protocol and fold, fitted on its training rows.

    Term weights that are fitted on all rows depend on the texts and two parameters alone: a stage of theirs.
    """
    wanted = meta if config.use_task_metafeatures else None
    text: dict = {"max_features": config.max_features, "max_df": config.max_df} if config.text_mode == "tfidf" else {}
    if config.text_mode == "embedding" and vectors is None and config.encoder is not None:
        store = encoder_store.EncoderStore(spark, f"{root}/encoded", config.encoder_name)
        vectors = store.vectors(supervised, "flow_text", config.encoder)
        supervised = supervised.withColumn("_text_key", encoder_store.text_key("flow_text"))
        text = {"key": "_text_key", "vector_key": "text_key", "vector": "vector"}
    if config.fit_scope == "all":
        if config.text_mode == "tfidf":
            weights = stages.table("weights", {**text, "prefixes": list(config.prefixes)}, lambda options=text: features.tfidf(supervised, "flow_text", **options))
            text = {"weights": weights}
        return features.build_features(supervised, config.text_mode, wanted, vectors=vectors, **text)
    parts = []
    for mode, folded in protocols.items():
        for fold in range(config.cv_folds):
            train = supervised.join(folded.where(F.col("fold") != fold).select("row_id"), "row_id", "left_semi")
            own = features.build_features(supervised, config.text_mode, wanted, vectors=vectors, fit_on=train, **text)
            parts.append(own.select(F.lit(mode).alias("split_mode"), F.lit(fold).alias("fold"), "*"))
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drawn(folded: DataFrame, held: list[int], config: Config) -> DataFrame:
    """(fold, role, row_id, features) of the rows that explain each held-out fold, as a small table.

    Test rows (role eval) and training rows (background) of all folds are drawn from keys in one pass each,
    and vectors are read once.
    """
    keys = folded.select("row_id", "fold")
    sizes = {r.fold: r.n for r in keys.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    n = max(config.shap_eval, config.interaction_eval if config.compute_interactions else 0)
    sides = {"eval": keys.where(F.col("fold").isin(held)), "background": keys.select("row_id", F.explode(F.filter(F.lit(held).cast("array<int>"), lambda k: k != F.col("fold"))).alias("fold"))}
    chosen = []
    for role, side in sides.items():
        most = n if role == "eval" else config.shap_background
        of = {k: sizes.get(k, 0) if role == "eval" else sum(sizes.values()) - sizes.get(k, 0) for k in held}
        seed = F.col("fold") + config.seed
        few = results.written(folds.first_by_hash(side, "fold", "row_id", most, of, seed, role))
        found = {r.fold: r.n for r in few.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        whole = all(found.get(k, 0) >= min(most, of[k]) for k in held)
        chosen.append(folds.sample(few if whole else side, ["fold"], "row_id", most, seed, role).withColumn("role", F.lit(role)))
    chosen = union(chosen)
    return results.written(folded.select("row_id", "features").join(F.broadcast(chosen), "row_id").select("fold", "role", "row_id", "features"))  # some hundred rows a fold


def explained(spark, some: DataFrame, model, name: str, fold: int, mode: str, config: Config, root: str, dictionary: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Attributions of ``drawn`` test rows against training rows, their interactions, and (row_id, expected_value)."""
    own_rows = some.where(F.col("fold") == fold).select("fold", "role", "row_id", "features")
    background = [r.features for r in own_rows.where("role = 'background'").orderBy("row_id").collect()]  # shap_background rows at most
    test = own_rows.where("role = 'eval'").drop("role")
    rows = folds.sample(test, ["fold"], "row_id", config.shap_eval, config.seed + fold)
    label = lambda df: df.select(F.lit(mode).alias("split_mode"), F.lit(name).alias("model"), F.lit(fold).alias("fold"), "*")
    with_expected = lambda value: label(rows.select("row_id", F.lit(float(value)).alias("expected_value")))
    own = getattr(model, "model", None)
    if name == "ridge":
        weights, mean = own.coefficients.toArray(), np.zeros(own.numFeatures)
        for v in background:
            mean += v.toArray() / len(background)
        long = rows.select("row_id", F.posexplode(vector_to_array("features")).alias("feature_id", "v"))
        known = spark.createDataFrame([(i, float(w), float(m)) for i, (w, m) in enumerate(zip(weights, mean, strict=True))], "feature_id int, w double, m double")
        found = long.join(F.broadcast(known), "feature_id").select("row_id", "feature_id", (F.col("w") * (F.col("v") - F.col("m"))).alias("shap"))
        return label(found.join(F.broadcast(dictionary), "feature_id")), None, with_expected(weights @ mean + own.intercept)
    if own is None:
        raise ValueError(f"{name} has no attributions")
    leaves = attribution.ensemble_leaves(spark, own, f"{root}/models/{config.agg_mode}-{config.name}/{mode}-{name}-{fold}")
    found, expected = attribution.explain(rows, leaves, background)
    found = label(found.join(F.broadcast(dictionary), "feature_id"))
    if not config.compute_interactions:
        return found, None, with_expected(expected)
    paired = folds.sample(test, ["fold"], "row_id", config.interaction_eval, config.seed + fold)
    return found, label(attribution.explain_interactions(paired, leaves)), with_expected(expected)


def run_grid(spark: SparkSession, evals: DataFrame, raw_tasks: DataFrame, raw_flows: DataFrame, configs: list[Config], root: str, vectors: DataFrame | None = None, stages: Stages | None = None, at_once: int = RUNS_AT_ONCE) -> dict[tuple[str, str], dict[str, DataFrame]]:
    """All configurations, each checked before the first starts; runs share their stages, some go at once."""
    for c in configs:
        c.check()
    stages = stages or Stages(spark, root, inputs_of(evals, raw_tasks, raw_flows, vectors))
    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(lambda c: run(spark, evals, raw_tasks, raw_flows, c, root, vectors, stages), configs))
    return {(c.agg_mode, c.name): tables for c, tables in zip(configs, found, strict=True)}


def grid(base: Config, names: dict[str, dict], agg_modes: tuple[str, ...] = ("max", "mean")) -> list[Config]:
    """Every named variation of a configuration under every aggregation."""
    return [replace(base, name=name, agg_mode=mode, **changes) for mode in agg_modes for name, changes in names.items()]


def consolidate(spark: SparkSession, root: str, agg_mode: str, split_mode: str = "task_group_kfold") -> dict[str, DataFrame]:
    """Anchor, attribution summary and local summary over all runs of one aggregation."""
    out = {}
    read = lambda kind: results.read_results(spark, root, kind).where(F.col("agg_mode") == agg_mode).withColumnRenamed("run", "experiment")
    out["predictive_anchor"] = report.predictive_anchor(read("summary"), split_mode)
    if results.exists(spark, f"{root}/shap_summary_metrics"):
        out["shap_summary"] = read("shap_summary_metrics").where(F.col("split_mode") == split_mode).orderBy("experiment", "model")
        out["local_summary"] = explain.local_summary(read("local_shap_metrics").where(F.col("split_mode") == split_mode), ["experiment", "model"]).orderBy("experiment", "model")
    return out


def consolidate_discovered(spark: SparkSession, roots: list[str], kind: str, agg_mode: str) -> DataFrame:
    """One result table of every run whose metadata is found below any root, labelled with root and name.

    Tables of runs without metadata (a run that never finished) are left out.
    """
    parts = []
    for root in roots:
        runs = results.discover_runs(spark, f"{root}/metadata").select(F.col("name").alias("run")).distinct()
        rows = results.read_results(spark, root, kind).where(F.col("agg_mode") == agg_mode)
        parts.append(rows.join(F.broadcast(runs), "run", "left_semi").select(F.lit(root.rstrip("/").rpartition("/")[2]).alias("root"), F.col("run").alias("experiment"), *[c for c in rows.columns if c != "run"]))  # a row a run
    return union(parts)


def repeated_validation(rows: DataFrame, group: str, names: list[str], repeats: int = 6, k: int = 5, seed: int = 2000, settings: regressors.Settings = regressors.Settings()) -> DataFrame:
    """Predictions (rep, split_mode, model, fold, ...) of shuffled group folds, for several repeats."""
    parts = []
    for rep in range(repeats):
        folded = rows.join(folds.shuffled_group_folds(rows, group, k, seed, rep), group).select("row_id", "features", "y", "fold")
        parts.append(regressors.cross_validate(folded, names, "shuffled_groups", seed + rep, settings).withColumn("rep", F.lit(rep)))
    return union(parts)


def repeated_stability(spark: SparkSession, rows: DataFrame, group: str, dictionary: DataFrame, config: Config, root: str, repeats: int = 6, seed: int = 2000) -> dict[str, DataFrame]:
    """Repeated shuffled group folds with attributions: predictions, fold-pair overlaps and their summary.

    ``overlaps`` has the Jaccard overlap of the top-k features of each fold pair, by model and repeat;
    ``stability`` its mean within each repeat, then mean and population deviation over repeats.
    """
    parts, attributions = [], []
    for rep in range(repeats):
        folded = results.written(rows.join(folds.shuffled_group_folds(rows, group, config.cv_folds, seed, rep), group).select("row_id", "features", "y", "fold"))
        own: dict = {}
        parts.append(regressors.cross_validate(folded, list(config.models), "shuffled_groups", seed + rep, config.settings, own).withColumn("rep", F.lit(rep)))
        some = drawn(folded, sorted({fold for _, fold in own}), config)
        for (name, fold), model in own.items():
            attributions.append(explained(spark, some, model, name, fold, f"rep{rep}", config, root, dictionary)[0].withColumn("rep", F.lit(rep)))
    by = ["model", "rep"]
    shap = results.written(union(attributions).select(*by, "fold", "row_id", "feature_id", "feature", "shap"))
    top = explain.global_topk(explain.mean_abs(shap, [*by, "fold"]), [*by, "fold"], config.top_k)
    overlaps = explain.fold_stability(top, by, config.top_k)
    inner = overlaps.groupBy(*by).agg(F.avg("jaccard").alias("j"))
    stability = inner.groupBy("model").agg(F.count("*").alias("n_repeats"), F.avg("j").alias("jaccard_mean"), F.stddev_pop("j").alias("jaccard_std"))
    return {"predictions": union(parts), "overlaps": overlaps, "stability": stability}
