"""Evaluations, tasks, flows and attributions as views of the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = ("small ", "Brand#1.")
FOLDS, SEED = 5, 42


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 5), "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("flow_id"), value.alias("value"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("p"), F.countDistinct("l_returnflag").alias("k"))
    s = _read(spark, sf_dir, "supplier")
    return s.join(lines, s.s_suppkey == lines.l_suppkey, "left").select(
        F.col("s_suppkey").alias("tid"), F.col("s_nationkey").alias("did"), F.col("s_name").alias("name"), F.col("n").alias("NumberOfInstances"), F.col("p").alias("NumberOfFeatures"), F.col("k").alias("NumberOfClasses"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("MajorityClassSize")
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_type", F.lit("(size="), F.col("p_size").cast("string"), F.lit(")")).alias("full_name"), F.col("p_size").cast("string").alias("version"), F.lit(None).cast("string").alias("external_version")
    )


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % FOLDS).alias("fold"), F.posexplode("embedding").alias("feature_id", "x"))
    i = F.col("feature_id").cast("string")
    name = F.when(F.col("feature_id") % 3 == 0, F.concat(F.lit("meta::m"), i)).when(F.col("feature_id") % 3 == 1, F.concat(F.lit("text::emb_"), i)).otherwise(F.concat(F.lit("text::tok"), i))
    return e.select("row_id", "fold", "feature_id", name.alias("feature"), F.col("x").cast("double").alias("shap"))


def interaction_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of all feature pairs of each row, made inside the row."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 5).alias("fold"), "embedding", F.posexplode("embedding").alias("feature_i", "x"))
    pairs = rows.select("row_id", "fold", "feature_i", "x", F.posexplode("embedding").alias("feature_j", "y"))
    return pairs.select("row_id", "fold", "feature_i", "feature_j", (F.col("x").cast("double") * F.col("y").cast("double")).alias("value"))


# The same views for DuckDB.
SQL = {
    "evals_raw": "select l_suppkey as task_id, l_partkey as flow_id, case when l_linenumber = 7 and l_quantity < 5 then 'n/a' else cast(l_extendedprice as varchar) end as value from lineitem",
    "tasks_raw": "select s.s_suppkey as tid, s.s_nationkey as did, s.s_name as name, x.n as NumberOfInstances, x.p as NumberOfFeatures, x.k as NumberOfClasses, case when s.s_suppkey % 7 = 0 then null else s.s_acctbal end as MajorityClassSize from supplier s left join (select l_suppkey, count(*) n, count(distinct l_partkey) p, count(distinct l_returnflag) k from lineitem group by l_suppkey) x on x.l_suppkey = s.s_suppkey",
    "flows_raw": "select p_partkey as id, p_name as name, concat(p_brand, '.', p_type, '(size=', cast(p_size as varchar), ')') as full_name, cast(p_size as varchar) as version, cast(null as varchar) as external_version from part",
    "attr": "select row_id, fold, feature_id, case feature_id % 3 when 0 then 'meta::m' when 1 then 'text::emb_' else 'text::tok' end || cast(feature_id as varchar) as feature, shap from (select vec_id as row_id, label % 5 as fold, cast(unnest(range(0, len(embedding))) as integer) as feature_id, cast(unnest(embedding) as double) as shap from embeddings)",
    "inter": "select a.row_id, a.fold, a.feature_id as feature_i, b.feature_id as feature_j, a.shap * b.shap as value from attr a join attr b on a.row_id = b.row_id",
    "evals": "select task_id, flow_id, try_cast(value as double) as v from evals_raw where try_cast(value as double) is not null",
    "agg_mean": "select task_id, flow_id, avg(v) as target_value, coalesce(stddev_samp(v), 0) as value_std, count(v) as value_count from evals group by 1, 2",
    "flow_parts": "select id as flow_id, name as flow_name, full_name as flow_full_name, version as flow_version, external_version as flow_external_version, cast(null as varchar) as flow_uploader, concat_ws(chr(10), case when name <> '' then 'name: ' || name end, case when full_name <> '' then 'full_name: ' || full_name end, case when version <> '' then 'version: ' || version end, case when external_version <> '' then 'external_version: ' || external_version end) as flow_text from flows_raw",
    "flows": "select *, lower(trim(regexp_replace(translate(flow_text, '.()=,:', '      '), '\\s+', ' ', 'g'))) as flow_text_clean from flow_parts",
    "tasks": "select tid as task_id, did as dataset_id, name as task_name, MajorityClassSize, NumberOfClasses, NumberOfFeatures, NumberOfInstances from tasks_raw",
    "kept_flows": "select * from flows where (starts_with(coalesce(flow_name, ''), 'small ') or starts_with(coalesce(flow_full_name, ''), 'small ') or starts_with(coalesce(flow_name, ''), 'Brand#1.') or starts_with(coalesce(flow_full_name, ''), 'Brand#1.')) and flow_id in (select flow_id from evals_raw)",
    "kept_evals": "select * from agg_mean where flow_id in (select flow_id from kept_flows)",
    "supervised": "select e.*, t.dataset_id, t.task_name, t.MajorityClassSize, t.NumberOfClasses, t.NumberOfFeatures, t.NumberOfInstances, f.flow_name, f.flow_full_name, f.flow_version, f.flow_external_version, f.flow_uploader, f.flow_text, f.flow_text_clean, concat_ws('::', e.task_id, e.flow_id) as row_id from kept_evals e left join tasks t using (task_id) left join kept_flows f using (flow_id) where f.flow_text is not null and e.target_value is not null",
    "row_folds": "select row_id, task_id, flow_id, flow_version, target_value as y, cast(ntile(5) over (order by md5(concat_ws('::', row_id, '42')), row_id) - 1 as integer) as fold from supervised",
    "task_sizes": "select task_id, n, row_number() over (order by n desc, task_id) as rn from (select task_id, count(*) as n from supervised group by 1)",
    "task_folds": "select task_id, fold from greedy where rn > 0",
    "group_folds": "select row_id, task_id, flow_id, flow_version, target_value as y, fold from supervised join task_folds using (task_id)",
    "folded": "select 'row_kfold' as split_mode, * from row_folds union all by name select 'task_group_kfold' as split_mode, * from group_folds",
    "base": "select f.*, (sum(y) over (partition by split_mode) - sum(y) over (partition by split_mode, fold)) / (count(*) over (partition by split_mode) - count(*) over (partition by split_mode, fold)) as global_mean, (sum(y) over (partition by split_mode, task_id) - sum(y) over (partition by split_mode, task_id, fold)) / nullif(count(*) over (partition by split_mode, task_id) - count(*) over (partition by split_mode, task_id, fold), 0) as task_own, (sum(y) over (partition by split_mode, flow_id) - sum(y) over (partition by split_mode, flow_id, fold)) / nullif(count(*) over (partition by split_mode, flow_id) - count(*) over (partition by split_mode, flow_id, fold), 0) as flow_own, (sum(y) over (partition by split_mode, flow_version) - sum(y) over (partition by split_mode, flow_version, fold)) / nullif(count(*) over (partition by split_mode, flow_version) - count(*) over (partition by split_mode, flow_version, fold), 0) as version_own from folded f",
    "predictions": "select split_mode, 'global_mean' as model, fold, row_id, y as y_true, global_mean as y_pred from base union all select split_mode, 'task_mean', fold, row_id, y, coalesce(task_own, global_mean) from base union all select split_mode, 'flow_mean', fold, row_id, y, coalesce(flow_own, global_mean) from base",
    "cv": "select split_mode, model, fold, 1 - sum((y_true - y_pred) ** 2) / sum((y_true - m) ** 2) as r2, avg(abs(y_true - y_pred)) as mae, avg((y_true - y_pred) ** 2) as mse from (select *, avg(y_true) over (partition by split_mode, model, fold) as m from predictions) group by 1, 2, 3",
    "differing": "select split_mode, model, fold, y_true, y_pred from predictions where model <> 'task_mean' union all select split_mode, 'version_mean', fold, y, coalesce(version_own, global_mean) from base",
    "cv_differing": "select split_mode, model, fold, avg((y_true - y_pred) ** 2) as mse from differing group by 1, 2, 3",
    "summary": "select split_mode, model, avg(r2) as r2_mean, stddev_samp(r2) as r2_std, avg(mae) as mae_mean, stddev_samp(mae) as mae_std, avg(mse) as mse_mean, stddev_samp(mse) as mse_std from cv group by 1, 2",
    "by_fold": "select fold, feature_id, feature, sum(abs(shap)) / any_value(n) as mean_abs_shap from attr join (select fold, count(distinct row_id) as n from attr group by 1) using (fold) group by 1, 2, 3",
    "ranked": "select *, row_number() over (partition by fold, row_id order by abs(shap) desc, feature_id desc) as rank from attr",
    "local_topk": "select fold, row_id, rank, feature_id, feature, shap from ranked where rank <= 10",
    "readable": "select fold, row_id, avg(case when starts_with(feature, 'meta::') or (starts_with(feature, 'text::') and not starts_with(feature, 'text::emb_')) then 1.0 else 0.0 end) as readability from local_topk group by 1, 2",
    "running": "select fold, row_id, sum(abs(shap)) over (partition by fold, row_id order by abs(shap) desc, feature_id desc rows unbounded preceding) as c, sum(abs(shap)) over (partition by fold, row_id) as t from attr",
    "sparse": "select fold, row_id, case when max(t) > 0 then count(case when c / t < 0.8 then 1 end) + 1 else 0 end as sparsity from running group by 1, 2",
    "local": "select fold, row_id, readability, sparsity, 10 as top_k, cast(0.8 as double) as sparsity_mass from readable join sparse using (fold, row_id)",
    "topk": "select fold, rank, feature_id, feature, mean_abs_shap from (select *, row_number() over (partition by fold order by mean_abs_shap desc, feature_id desc) as rank from by_fold) where rank <= 10",
    "sets": "select fold, list(feature) as s from topk group by 1",
    "stability": "select a.fold as fold_a, b.fold as fold_b, 10 as top_k, len(list_intersect(a.s, b.s)) / cast(len(list_distinct(list_concat(a.s, b.s))) as double) as jaccard from sets a join sets b on a.fold < b.fold",
}
# The same for the best value of each pair instead of the mean; rows, folds and their keys are equal.
SQL["agg_max"] = SQL["agg_mean"].replace("avg(v)", "max(v)")
SQL["folded_max"] = "select f.* exclude (y), a.target_value as y from folded f join agg_max a using (task_id, flow_id)"
for _name, _below in (("base", "folded"), ("predictions", "base"), ("cv", "predictions"), ("summary", "cv")):
    SQL[f"{_name}_max"] = re.sub(rf"\b{_below}\b", f"{_below}_max", SQL[_name])
GREEDY = "greedy(rn, task_id, fold, loads) as (select cast(0 as bigint), cast(null as bigint), cast(null as integer), [0, 0, 0, 0, 0]::bigint[] union all select t.rn, t.task_id, cast(list_position(g.loads, list_min(g.loads)) - 1 as integer), list_transform(g.loads, lambda v, i: case when i = list_position(g.loads, list_min(g.loads)) then v + t.n else v end) from greedy g join task_sizes t on t.rn = g.rn + 1)"


def oracle(body: str) -> str:
    """A DuckDB query over the views above, with those that it needs in front."""
    need: list[str] = []
    used = lambda text: [n for n in [*SQL, "greedy"] if re.search(rf"\b{n}\b", text)]

    def add(name: str) -> None:
        if name in need:
            return
        for other in used(GREEDY if name == "greedy" else SQL[name]):
            if other != name:
                add(other)
        need.append(name)

    for name in used(body):
        add(name)
    views = [GREEDY if n == "greedy" else f"{n} as materialized ({SQL[n]})" for n in need]
    if not need:
        return body
    rest = f", {body[5:]}" if body.startswith("with ") else f" {body}"
    return f"with recursive {', '.join(views)}{rest}"
