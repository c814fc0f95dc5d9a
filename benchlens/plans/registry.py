"""All queries over the reference-style tables, with their DuckDB SQL.

Every query reads the driver's tables through the views of ``inputs`` and applies one operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.functions import text as X
from benchlens.operators import attribution, encoder_store, explain, feature_model, features, folds, metrics, models, report, selection, tables, trees
from benchlens.plans import inputs as I
from benchlens.plans import pipeline
from benchlens.sources import evaluations as S
from benchlens.sources import results

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "flow_family_summary"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LOCAL = ["fold", "row_id"]
SMALL = models.Settings(trees=5, depth=4, iterations=5, random_trees=3, bins=32)
FLOW_COLUMNS = "flow_id, flow_name, flow_full_name, flow_version, flow_external_version, flow_uploader, flow_text, flow_text_clean"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = I.oracle(sql)
        return f

    return add


# Views that several queries share.


def _flows(s, d):
    return tables.normalize_flows(I.flows(s, d))


def _kept_flows(s, d):
    return tables.relevant_flows(_flows(s, d), I.evaluations(s, d), I.KEEP)


def _targets(s, d):
    return tables.restrict_evaluations(tables.aggregate_evaluations(I.evaluations(s, d)), _kept_flows(s, d))


def _supervised(s, d, agg_mode="mean"):
    kept = results.written(_kept_flows(s, d))  # targets and texts need them
    targets = tables.restrict_evaluations(tables.aggregate_evaluations(I.evaluations(s, d), agg_mode=agg_mode), kept)
    return tables.supervised_table(targets, tables.normalize_tasks(I.tasks(s, d))[0], kept)


def _rows(s, d, agg_mode="mean"):
    return _supervised(s, d, agg_mode).select("row_id", "task_id", "flow_id", "flow_version", F.col("target_value").alias("y"))


def _folded(s, d, agg_mode="mean"):
    """Rows under both protocols, from one written table."""
    rows = results.written(_rows(s, d, agg_mode))
    return {"row_kfold": folds.row_folds(rows, "row_id", I.FOLDS, I.SEED), "task_group_kfold": folds.with_group_folds(rows, "task_id", I.FOLDS)}


GLOBAL, FLOW = ("global_mean", []), ("flow_mean", ["flow_id"])
#: Under group folds no training row has a test row's task, so ``task_mean`` is the global mean there.
STAND_INS = (GLOBAL, ("task_mean", ["task_id"]), FLOW)
#: Predictors that differ under both protocols, so that no difference is rounding noise.
DIFFERING = (GLOBAL, ("version_mean", ["flow_version"]), FLOW)


def _predictions(s, d, stand_ins=STAND_INS, agg_mode="mean"):
    out = None
    for mode, folded in _folded(s, d, agg_mode).items():
        folded = results.written(folded)  # three predictors read it
        for name, by in stand_ins:
            own = models.mean_predictor(folded, name, by, mode)
            out = own if out is None else out.unionByName(own)
    return out


def _cv(s, d, stand_ins=STAND_INS, agg_mode="mean"):
    return metrics.fold_metrics(_predictions(s, d, stand_ins, agg_mode), ["split_mode", "model", "fold"])


def _by_fold(s, d):
    return explain.mean_abs(I.attributions(s, d), ["fold"])


# Sources.


@query("select task_id, flow_id, value from (select *, row_number() over (partition by task_id order by flow_id, value) as r from evals_raw where task_id in (select s_suppkey from supplier where s_acctbal > 0)) where r <= 50 group by 1, 2, 3")
def load_evaluations(s, d):
    suite = s.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("task_id"))
    return S.load_evaluations([I.evaluations(s, d)], suite, per_task=50, order=["flow_id", "value"], check=False)


@query("select distinct l_suppkey as task_id, l_partkey as flow_id, cast(l_extendedprice as varchar) as value from lineitem where l_returnflag = 'A' and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)")
def load_metric_evaluations(s, d):
    """Evaluations of one metric function out of several."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("flow_id"), F.col("l_extendedprice").cast("string").alias("value"), F.col("l_returnflag").alias("function"))
    suite = s.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("task_id"))
    return S.load_evaluations([lines], suite, check=False, function="A")


@query("select tid, did, name from tasks_raw where tid in (select l_suppkey from lineitem where l_quantity > 45)")
def load_tasks(s, d):
    suite = s.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_suppkey").alias("task_id"))
    return S.load_tasks(I.tasks(s, d), suite).select("tid", "did", "name")


@query("select id, name, full_name, version, external_version from flows_raw where id in (select flow_id from evals_raw)")
def load_flows(s, d):
    return S.load_flows(I.flows(s, d), I.evaluations(s, d))[0].select("id", "name", "full_name", "version", "external_version")


@query("select id, name, full_name from flows_raw where id in (select flow_id from evals_raw)")
def load_all_flows(s, d):
    return S.load_flows(I.flows(s, d), I.evaluations(s, d))[0].select("id", "name", "full_name")


@query("select distinct flow_id from evals_raw where flow_id not in (select id from flows_raw where version <> '7')")
def unresolved_flows(s, d):
    return S.load_flows(I.flows(s, d).where("version <> '7'"), I.evaluations(s, d))[1]


@query("select distinct flow_id from evals_raw where flow_id is not null")
def used_flow_ids(s, d):
    return tables.used_flow_ids(I.evaluations(s, d))


@query("select distinct task_id, flow_id, value from evals_raw")
def distinct_rows(s, d):
    return I.evaluations(s, d).dropDuplicates()


# Projections, filters, functions.


@query("select flow_id, flow_text_clean from flows")
def clean_text(s, d):
    return X.with_clean_text(_flows(s, d).select("flow_id", "flow_text"), "flow_text").select("flow_id", "flow_text_clean")


@query("select doc_id, lower(trim(regexp_replace(translate(text, '.()=,:', '      '), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g'))) as text_clean from documents")
def clean_documents(s, d):
    return X.with_clean_text(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "text_clean")


@query(f"select {FLOW_COLUMNS} from flows")
def normalize_flows(s, d):
    return _flows(s, d)


@query("select * from tasks")
def normalize_tasks(s, d):
    out, found = tables.normalize_tasks(I.tasks(s, d))
    return out.select("task_id", "dataset_id", "task_name", *found)


@query("select task_id, flow_id, v as value from evals")
def numeric_values(s, d):
    return tables.numeric_values(I.evaluations(s, d))


@query("select flow_id from flows where starts_with(flow_name, 'small ') or starts_with(flow_full_name, 'Brand#1.')")
def prefix_filter(s, d):
    f = _flows(s, d)
    return f.where(tables.has_prefix(f, I.KEEP)).select("flow_id")


@query("select distinct feature, regexp_replace(feature, '^(meta::|text::)', '') as display, starts_with(feature, 'meta::') or (starts_with(feature, 'text::') and not starts_with(feature, 'text::emb_')) as readable from attr")
def feature_names(s, d):
    f = I.attributions(s, d).select("feature").distinct()
    return f.select("feature", X.display_name(F.col("feature")).alias("display"), X.is_readable(F.col("feature")).alias("readable"))


@query("select id as flow_id, case when contains(lower(full_name), 'economy') then 'TF-IDF' when contains(lower(full_name), 'small') then 'MiniLM' else full_name end as label from flows_raw")
def infer_labels(s, d):
    f = I.flows(s, d)
    return f.select(F.col("id").alias("flow_id"), X.label(F.col("full_name"), (("economy", "TF-IDF"), ("small", "MiniLM"))).alias("label"))


@query("with h as (select md5(flow_text_clean) as h, count(*) as n from flows group by 1), p as (select substr(h, 1, 2) as prefix, md5(string_agg(h || ':' || n, ',' order by h || ':' || n)) as part from h group by 1) select md5(string_agg(prefix || '=' || part, ',' order by prefix || '=' || part)) as fingerprint from p")
def text_fingerprint(s, d):
    return X.fingerprint(_flows(s, d), "flow_text", buckets=256)


# Joins.


@query(f"select {FLOW_COLUMNS} from kept_flows")
def relevant_flows(s, d):
    return _kept_flows(s, d)


@query("select * from kept_evals")
def restrict_evaluations(s, d):
    return _targets(s, d)


@query("select * from supervised")
def supervised_table(s, d):
    return _supervised(s, d)


@query("select split_part(flow_full_name, '(', 1) as family, dataset_id, count(*) as n, avg(target_value) as target_mean, max(target_value) as target_max, avg(value_std) as std_mean from supervised group by 1, 2")
def flow_family_summary(s, d):
    family = F.split_part("flow_full_name", F.lit("("), F.lit(1)).alias("family")
    return _supervised(s, d).groupBy(family, "dataset_id").agg(F.count("*").alias("n"), F.avg("target_value").alias("target_mean"), F.max("target_value").alias("target_max"), F.avg("value_std").alias("std_mean"))


@query("select a.split_mode, a.fold, a.model as model_a, b.model as model_b, a.mse - b.mse as diff from cv_differing a join cv_differing b on a.split_mode = b.split_mode and a.fold = b.fold and a.model < b.model")
def model_pairs(s, d):
    return metrics.model_pairs(_cv(s, d, DIFFERING), "mse")


@query("select 'e' as experiment, a.model, a.split_mode, a.r2_mean as r2_max, b.r2_mean as r2_mean, a.r2_mean - b.r2_mean as r2_difference from summary_max a join summary b using (model, split_mode)")
def agg_mode_table(s, d):
    """Runs on the best value of each pair beside runs on the mean."""
    runs = [metrics.summarize(_cv(s, d, agg_mode=mode)).withColumn("experiment", F.lit("e")) for mode in ("max", "mean")]
    return report.agg_mode_table(*runs)


@query("select min(row_id) as row_id from (select row_id from attr where feature_id = 3 and shap > 0 intersect select row_id from attr where feature_id = 5 and shap > 0)")
def common_row(s, d):
    a = I.attributions(s, d).where("feature_id in (3, 5) and shap > 0").withColumn("run", F.col("feature_id").cast("string"))
    return explain.common_row(a, "run", "3", "5")


@query("select 'a' as experiment, split_mode, model, r2_mean from summary union all select 'b', split_mode, model, r2_mean + 1 from summary")
def labelled_union(s, d):
    one = metrics.summarize(_cv(s, d)).select("split_mode", "model", "r2_mean")
    return report.labelled_union({"a": one, "b": one.withColumn("r2_mean", F.col("r2_mean") + 1)})


@query("select task_id, flow_id, value from (select task_id, flow_id, case when flow_id % 3 > 0 then flow_id end as value, row_number() over (partition by task_id order by (flow_id % 3 > 0) desc, flow_id desc) as r from (select distinct task_id, flow_id from evals_raw)) where r = 1")
def keep_last(s, d):
    rows = I.evaluations(s, d).select("task_id", "flow_id").distinct()
    return explain.keep_last(rows.withColumn("value", F.when(F.col("flow_id") % 3 > 0, F.col("flow_id"))), ["task_id"], "value")


@query("select a.fold as fold_a, b.fold as fold_b, len(list_intersect(a.s, b.s)) as common, len(list_distinct(list_concat(a.s, b.s))) as either from sets a join sets b on a.fold < b.fold")
def set_overlap(s, d):
    sets = explain.global_topk(_by_fold(s, d), ["fold"]).groupBy("fold").agg(F.collect_set("feature").alias("s"))
    a, b = (sets.select(F.col("fold").alias(f"fold_{x}"), F.col("s").alias(x)) for x in "ab")
    return a.join(b, F.col("fold_a") < F.col("fold_b")).select("fold_a", "fold_b", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"))


# Aggregations and scores.


@query("select * from agg_mean")
def aggregate_mean(s, d):
    return tables.aggregate_evaluations(I.evaluations(s, d))


@query("select task_id, flow_id, max(v) as target_value, coalesce(stddev_samp(v), 0) as value_std, count(v) as value_count from evals group by 1, 2")
def aggregate_max(s, d):
    return tables.aggregate_evaluations(I.evaluations(s, d), agg_mode="max")


@query("select split_mode, model, fold, row_id, y_true, y_pred from predictions")
def mean_predictions(s, d):
    return _predictions(s, d)


@query("select * from cv")
def fold_metrics(s, d):
    return _cv(s, d)


@query("select * from summary order by split_mode, r2_mean desc")
def cv_summary(s, d):
    return metrics.summarize(_cv(s, d))


@query("select model, a.r2_mean as row_kfold, b.r2_mean as task_group_kfold, a.r2_mean - b.r2_mean as gap from (select * from summary where split_mode = 'row_kfold') a join (select * from summary where split_mode = 'task_group_kfold') b using (model)")
def protocol_gap(s, d):
    return metrics.protocol_gap(metrics.summarize(_cv(s, d)))


REPEATS = "select split_mode, model, rep, avg(r2) as r2, avg(mae) as mae, avg(mse) as mse from (select *, fold % 2 as rep from cv) group by 1, 2, 3"
REPEATED = f"select split_mode, model, count(*) as n_repeats, avg(r2) as r2_mean, stddev_pop(r2) as r2_std, avg(mae) as mae_mean, stddev_pop(mae) as mae_std, avg(mse) as mse_mean, stddev_pop(mse) as mse_std from ({REPEATS}) group by 1, 2"


@query(REPEATED)
def repeated_summary(s, d):
    return metrics.repeated_summary(_cv(s, d).withColumn("rep", F.col("fold") % 2), ["split_mode", "model"])


_SCORES = ", ".join(f"avg({m}) as {m}_mean, stddev_pop({m}) as {m}_std" for m in ("r2", "mae", "mse"))


@query(f"""with g as (select rep, task_id, ntile(5) over (partition by rep order by md5(concat_ws('::', task_id, '2000:' || rep)), task_id) - 1 as fold from (select distinct task_id from supervised), (select unnest(range(6)) as rep)),
f as (select rep, fold, flow_id, target_value as y from supervised join g using (task_id)),
n as (select *, sum(y) over w as s, count(*) over w as c, sum(y) over i as si, count(*) over i as ci, sum(y) over x as sx, count(*) over x as cx, sum(y) over z as sz, count(*) over z as cz from f window w as (partition by rep), i as (partition by rep, fold), x as (partition by rep, flow_id), z as (partition by rep, flow_id, fold)),
p as (select rep, fold, y, (s - si) / (c - ci) as gm, case when cx > cz then (sx - sz) / (cx - cz) end as fm from n),
m as (select rep, fold, 'global_mean' as model, y, gm as yp from p union all select rep, fold, 'flow_mean', y, coalesce(fm, gm) from p),
e as (select rep, fold, model, 1 - sum((y - yp) ** 2) / sum((y - mu) ** 2) as r2, avg(abs(y - yp)) as mae, avg((y - yp) ** 2) as mse from (select *, avg(y) over (partition by rep, fold, model) as mu from m) group by 1, 2, 3),
r as (select rep, model, avg(r2) as r2, avg(mae) as mae, avg(mse) as mse from e group by 1, 2)
select model, count(*) as n_repeats, {_SCORES} from r group by 1""")
def robust_validation(s, d):
    """Six repeats of five shuffled group folds, as in the robust study."""
    rows, parts = results.written(_rows(s, d)), []
    for rep in range(6):
        folded = results.written(rows.join(folds.shuffled_group_folds(rows, "task_id", 5, 2000, rep), "task_id"))
        parts += [models.mean_predictor(folded, name, by, "shuffled_groups").withColumn("rep", F.lit(rep)) for name, by in (GLOBAL, FLOW)]
    return metrics.repeated_summary(metrics.fold_metrics(pipeline.union(parts), ["model", "rep", "fold"]), ["model"])


@query("select x.split_mode, model_a, model_b, 'mse' as metric, least(up, down) as statistic, least(1.0, 2.0 * (select count(*) from range(32) t(b) where (b & 1) * 1 + ((b >> 1) & 1) * 2 + ((b >> 2) & 1) * 3 + ((b >> 3) & 1) * 4 + ((b >> 4) & 1) * 5 <= least(up, down)) / 32) as p_value from (select split_mode, model_a, model_b, sum(case when diff > 0 then r else 0 end) as up, sum(case when diff < 0 then r else 0 end) as down from (select *, cast(row_number() over (partition by split_mode, model_a, model_b order by abs(diff)) as double) as r from (select a.split_mode, a.model as model_a, b.model as model_b, a.mse - b.mse as diff from cv_differing a join cv_differing b on a.split_mode = b.split_mode and a.fold = b.fold and a.model < b.model)) group by 1, 2, 3) x")
def wilcoxon(s, d):
    return metrics.wilcoxon(_cv(s, d, DIFFERING), "mse")


@query("select split_mode, model_a, model_b, diff, r + (c - 1) / 2.0 as rank, c as ties from (select *, rank() over (partition by split_mode, model_a, model_b order by abs(diff)) as r, count(*) over (partition by split_mode, model_a, model_b, abs(diff)) as c from (select 'all' as split_mode, task_id as model_a, flow_id % 3 as model_b, round(v / 1000) - 5 as diff from evals) where diff <> 0)")
def signed_ranks(s, d):
    value = F.floor(F.col("value") / 1000 + 0.5) - 5
    rows = tables.numeric_values(I.evaluations(s, d)).select(F.lit("all").alias("split_mode"), F.col("task_id").alias("model_a"), (F.col("flow_id") % 3).alias("model_b"), value.cast("double").alias("diff"))
    return metrics.signed_ranks(rows, ["split_mode", "model_a", "model_b"]).select("split_mode", "model_a", "model_b", "diff", "rank", "ties")


# Features.

TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
TERMS = f"tok as (select md5(t) as text_key, n_rows, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as b from (select t, count(*) as n_rows, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from (select lower(trim(regexp_replace(translate(coalesce(text, ''), '.()=,:', '      '), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))) as t from documents) group by t)), counts as (select text_key, n_rows, term, count(*) as tf from (select text_key, n_rows, unnest(list_concat(w, b)) as term from tok) group by 1, 2, 3), total as (select count(*) as n from documents), stats as (select term, sum(tf * n_rows) as total, sum(n_rows) as df from counts group by 1), vocab as (select cast(row_number() over (order by term) - 1 as integer) as feature_id, term, cast(df as bigint) as df, ln((1 + n) / cast(1 + df as double)) + 1 as idf from (select *, (select n from total) as n from stats where df <= 0.95 * (select n from total) order by total desc, term limit 200))"


@query("select doc_id, len(w) as n_tokens, md5(array_to_string(w, ' ')) as digest from (select doc_id, " + TOKENS + " as w from documents)")
def tokenize(s, d):
    w = s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.concat_ws(" ", "w")).alias("digest"))


@query(f"with {TERMS} select feature_id, term, df, idf from vocab")
def vocabulary(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return features.vocabulary(features.tokenized(docs, "text"), docs.count(), 200)


@query(f"with {TERMS} select text_key, term, feature_id, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by text_key)) as weight from counts join vocab using (term)")
def tfidf(s, d):
    return features.tfidf(s.read.parquet(f"{d}/documents.parquet"), "text", max_features=200)


@query(f"with {TERMS}, keyed as (select doc_id, md5(lower(trim(regexp_replace(translate(coalesce(text, ''), '.()=,:', '      '), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')))) as text_key, n_chars from documents), weights as (select text_key, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by text_key)) as value from counts join vocab using (term)) select doc_id, 'text::' || term as feature, value from keyed join weights using (text_key) union all select doc_id, 'meta::n_chars', coalesce(n_chars, (select median(n_chars) from documents)) / (select stddev_pop(coalesce(n_chars, (select median(n_chars) from documents))) from documents) from documents")
def saved_features(s, d):
    """Words and length of documents by a model that was fitted, saved and loaded again."""
    docs, path = s.read.parquet(f"{d}/documents.parquet"), f"{results.work_dir(s)}/features"
    feature_model.FeatureEstimator(textCol="text", numericCols=["n_chars"], maxFeatures=200).fit(docs).write().save(path)
    model = feature_model.FeatureModel.load(path)
    names = s.createDataFrame(list(enumerate(model.names)), "f int, feature string")
    cells = trees.cells(model.transform(docs).select("doc_id", "features")).select("doc_id", F.explode("_cells").alias("c"))
    return cells.select("doc_id", F.col("c.f").alias("f"), F.col("c.v").alias("value")).join(F.broadcast(names), "f").select("doc_id", "feature", "value")


@query("select 'NumberOfInstances' as feature, median(NumberOfInstances) as median, stddev_pop(coalesce(NumberOfInstances, (select median(NumberOfInstances) from tasks))) as std from tasks union all select 'MajorityClassSize', median(MajorityClassSize), stddev_pop(coalesce(MajorityClassSize, (select median(MajorityClassSize) from tasks))) from tasks")
def numeric_statistics(s, d):
    stats = features.numeric_statistics(tables.normalize_tasks(I.tasks(s, d))[0], ["NumberOfInstances", "MajorityClassSize"])
    return s.createDataFrame([(c, float(m), float(std)) for c, (m, std) in stats.items()], "feature string, median double, std double")


@query("select unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as feature, unnest([median(cast(l_quantity as double)), median(cast(l_extendedprice as double)), median(cast(l_discount as double))]) as median, count(*) as n from lineitem")
def exact_medians(s, d):
    """Medians of columns that no task holds."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    values = s.read.parquet(f"{d}/lineitem.parquet").select(*[F.col(c).cast("double").alias(c) for c in names])
    n = values.count()
    return s.createDataFrame([(c, m, n) for c, m in selection.medians(values, names).items()], "feature string, median double, n long")


SCALED = ", ".join(f"coalesce({c}, (select median({c}) from tasks)) / (select case when s = 0 then 1 else s end from (select stddev_pop(coalesce({c}, (select median({c}) from tasks))) as s from tasks)) as {c}" for c in ("MajorityClassSize", "NumberOfInstances", "NumberOfClasses"))


@query(f"select task_id, {SCALED} from tasks")
def scale_numeric(s, d):
    t = tables.normalize_tasks(I.tasks(s, d))[0].select("task_id", "MajorityClassSize", "NumberOfInstances", "NumberOfClasses")
    return features.scale_numeric(t, ["MajorityClassSize", "NumberOfInstances", "NumberOfClasses"])


@query("select task_id as row_id, 'text::emb_' || (i - 1) as feature, cast(embedding[i] as double) as value from tasks join embeddings on vec_id = task_id, range(1, 65) r(i) union all select task_id, 'meta::NumberOfInstances', coalesce(NumberOfInstances, (select median(NumberOfInstances) from tasks)) / (select stddev_pop(coalesce(NumberOfInstances, (select median(NumberOfInstances) from tasks))) from tasks) from tasks")
def build_features(s, d):
    t = tables.normalize_tasks(I.tasks(s, d))[0].select(F.col("task_id").alias("row_id"), F.col("task_id").alias("flow_id"), "NumberOfInstances")
    return features.build_features(t, "embedding", ["NumberOfInstances"], vectors=s.read.parquet(f"{d}/embeddings.parquet"))


def letter_counts():
    """An encoder that SQL can state: length and two letters' counts."""
    return lambda texts: [[len(t), t.count("e"), t.count("a")] for t in texts]


@query("select flow_id as row_id, 'text::emb_' || i as feature, cast(case i when 0 then length(flow_text) when 1 then length(flow_text) - length(replace(flow_text, 'e', '')) else length(flow_text) - length(replace(flow_text, 'a', '')) end as double) as value from flows, range(3) r(i)")
def encoded_texts(s, d):
    """Texts of flows by an encoder, whose vectors are stored: the second run encodes nothing."""
    flows = _flows(s, d).select(F.col("flow_id").alias("row_id"), "flow_text")
    store = encoder_store.EncoderStore(s, results.work_dir(s), "letters")
    store.add(flows.where("row_id % 2 = 0"), "flow_text", letter_counts)
    vectors = store.vectors(flows, "flow_text", letter_counts)
    keyed = flows.withColumn("text_key", encoder_store.text_key("flow_text"))
    return features.embedding_features(keyed, vectors, "text_key", "text_key", "vector")


# Folds.


@query("select row_id, fold from row_folds")
def row_folds(s, d):
    return _folded(s, d)["row_kfold"].select("row_id", "fold")


@query("select task_id, fold from task_folds")
def group_folds(s, d):
    return folds.group_folds(_rows(s, d).groupBy("task_id").agg(F.count("*").alias("n")), "task_id", I.FOLDS)


@query("select task_id, cast(ntile(5) over (order by md5(concat_ws('::', task_id, '42:1')), task_id) - 1 as integer) as fold from (select distinct task_id from supervised)")
def shuffled_group_folds(s, d):
    return folds.shuffled_group_folds(_rows(s, d), "task_id", I.FOLDS, I.SEED, 1)


@query("select split_mode, fold, count(*) as entities, count(case when k > 1 then 1 end) as shared from (select *, count(*) over (partition by split_mode, task_id) as k from (select distinct split_mode, fold, task_id from folded)) group by 1, 2")
def leakage(s, d):
    out = [folds.leakage(f, "task_id").select(F.lit(m).alias("split_mode"), "fold", "entities", "shared") for m, f in _folded(s, d).items()]
    return out[0].unionByName(out[1])


@query("select row_id, fold from (select *, row_number() over (partition by fold order by md5(concat_ws('::', row_id, '42', 'eval')), row_id) as r from row_folds) where r <= 20")
def sample_rows(s, d):
    return folds.sample(_folded(s, d)["row_kfold"].select("row_id", "fold"), ["fold"], "row_id", 20)


# Explanations.


@query("select fold, feature_id, feature, mean_abs_shap from by_fold")
def mean_abs_shap(s, d):
    return _by_fold(s, d)


@query("select feature_id, feature, avg(mean_abs_shap) as mean_abs_shap, stddev_pop(mean_abs_shap) as std_abs_shap from by_fold group by 1, 2 order by 3 desc")
def global_importance(s, d):
    return explain.global_importance(_by_fold(s, d))


@query("select * from local_topk")
def local_topk(s, d):
    return explain.local_topk(I.attributions(s, d), LOCAL)


@query("select * from readable")
def readability(s, d):
    return explain.readability(explain.local_topk(I.attributions(s, d), LOCAL), LOCAL)


@query("select * from sparse")
def sparsity(s, d):
    return explain.sparsity(I.attributions(s, d), LOCAL)


@query("select * from local")
def local_metrics(s, d):
    return explain.local_metrics(I.attributions(s, d), LOCAL)


@query("select fold, count(*) as n, avg(readability) as readability_mean, stddev_pop(readability) as readability_std, avg(sparsity) as sparsity_mean, stddev_pop(sparsity) as sparsity_std from local group by 1")
def local_summary(s, d):
    return explain.local_summary(explain.local_metrics(I.attributions(s, d), LOCAL), ["fold"])


@query("select * from topk")
def global_topk(s, d):
    return explain.global_topk(_by_fold(s, d), ["fold"])


@query("select * from stability")
def fold_stability(s, d):
    return explain.fold_stability(explain.global_topk(_by_fold(s, d), ["fold"]))


@query("select top_k, avg(jaccard) as stability_mean, stddev_pop(jaccard) as stability_std from stability group by 1")
def stability_summary(s, d):
    return explain.stability_summary(explain.fold_stability(explain.global_topk(_by_fold(s, d), ["fold"])), ["top_k"])


@query("select 'r' as run, l.*, s.*, 10 as top_k, cast(0.8 as double) as sparsity_mass from (select count(*) as n_local_explanations, avg(readability) as readability_mean, stddev_pop(readability) as readability_std, avg(sparsity) as sparsity_mean, stddev_pop(sparsity) as sparsity_std from local) l, (select avg(jaccard) as global_topk_stability_mean, stddev_pop(jaccard) as global_topk_stability_std from stability) s")
def shap_summary(s, d):
    a = I.attributions(s, d).withColumn("run", F.lit("r"))
    local = explain.local_metrics(a, ["run", *LOCAL])
    top = explain.global_topk(explain.mean_abs(a, ["run", "fold"]), ["run", "fold"])
    return explain.shap_summary(local, explain.fold_stability(top, ["run"]), ["run"])


@query("select fold, sum(case when feature_i <> feature_j then abs(value) else 0 end) / sum(abs(value)) as interaction_ratio from inter group by 1")
def interaction_ratio(s, d):
    return explain.interaction_ratio(I.interaction_values(s, d), ["fold"])


@query("select 'e' as experiment, 'm' as model, avg(x) as interaction_ratio from (select fold, sum(case when feature_i <> feature_j then abs(value) else 0 end) / sum(abs(value)) as x from inter group by 1)")
def interaction_chart(s, d):
    r = explain.interaction_ratio(I.interaction_values(s, d), ["fold"])
    return report.interaction_chart(r.withColumns({"experiment": F.lit("e"), "model": F.lit("m")}))


RATIO_ALL = "select fold, sum(s * s - q) / sum(s * s) as interaction_ratio from (select fold, row_id, sum(abs(shap)) as s, sum(shap * shap) as q from attr group by 1, 2) group by 1"


@query(RATIO_ALL)
def interaction_ratio_all(s, d):
    return explain.product_interaction_ratio(I.attributions(s, d), ["fold"])


@query(f"select 'e' as experiment, 'm' as model, avg(interaction_ratio) as interaction_ratio from ({RATIO_ALL})")
def interaction_chart_all(s, d):
    r = explain.product_interaction_ratio(I.attributions(s, d), ["fold"])
    return report.interaction_chart(r.withColumns({"experiment": F.lit("e"), "model": F.lit("m")}))


WEIGHTS = (("NumberOfInstances", 0.5), ("NumberOfFeatures", -1.25), ("NumberOfClasses", 2.0))
_LONG = " union all ".join(f"select task_id as row_id, '{c}' as feature, cast({c} as double) as value, cast({w} as double) as weight from tasks where {c} is not null" for c, w in WEIGHTS)


def _task_values(s, d):
    t = tables.normalize_tasks(I.tasks(s, d))[0]
    long = t.select(F.col("task_id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c, _ in WEIGHTS])).alias("p")).select("row_id", "p.*").where("value is not null")
    return long, s.createDataFrame(list(WEIGHTS), "feature string, weight double")


@query(f"select row_id, feature, weight * (value - avg(value) over (partition by feature)) as shap from ({_LONG})")
def linear_attributions(s, d):
    long, weights = _task_values(s, d)
    return explain.linear_attributions(long, weights, long)


_ORDER = "row_number() over (partition by feature, rep order by md5(concat_ws('::', row_id, feature, rep, '42', '{}')), row_id)"
_IMPORTANCE = f"""
with long as ({_LONG}), many as (select long.*, r.rep from long, range(10) r(rep)),
numbered as (select *, {_ORDER.format("to")} as t, {_ORDER.format("from")} as f from many),
errors as (select row_id, any_value(coalesce(MajorityClassSize, 0)) - (sum(weight * value) + 1.0) as e from long join tasks on task_id = row_id group by 1),
moved as (select a.feature, a.rep, a.row_id, a.weight * (b.value - a.value) as d from numbered a join numbered b on a.feature = b.feature and a.rep = b.rep and a.t = b.f),
rises as (select feature, rep, avg((e - d) * (e - d)) - (select avg(e * e) from errors) as rise from moved join errors using (row_id) group by 1, 2)
select feature, avg(rise) as importance_mean, stddev_pop(rise) as importance_std from rises group by 1
""".strip()


@query(_IMPORTANCE)
def permutation_importance(s, d):
    long, weights = _task_values(s, d)
    truth = tables.normalize_tasks(I.tasks(s, d))[0].select(F.col("task_id").alias("row_id"), F.coalesce("MajorityClassSize", F.lit(0.0)).alias("y"))
    return explain.permutation_importance(long, weights, 1.0, truth)


# Reports.


@query("select fold, rank, regexp_replace(feature, '^(meta::|text::)', '') as feature, mean_abs_shap from (select *, row_number() over (partition by fold order by mean_abs_shap desc, feature desc) as rank from by_fold) where rank <= 12")
def top_features(s, d):
    return report.top_features(_by_fold(s, d), ["fold"])


@query("select feature, avg(mean_abs_shap) as mean_abs_shap, stddev_pop(mean_abs_shap) as std_abs_shap from by_fold group by 1 order by 2 desc, 1 desc limit 12")
def top_of_one(s, d):
    return report.top_of_one(_by_fold(s, d))


@query("with runs as (select 'a' as run, row_id, feature_id, feature, shap from attr union all select 'b', row_id, feature_id, feature, case when feature_id % 2 = 0 then shap else -shap / 2 end from attr where fold = 2) select run, row_id, rank, feature_id, feature, shap from (select *, row_number() over (partition by run order by abs(shap) desc, feature_id desc) as rank from runs where row_id = (select min(row_id) from runs where run = 'b')) where rank <= 10")
def case_study(s, d):
    """Run a explains every row, run b only those of fold 2: their least common row, side by side."""
    a = I.attributions(s, d)
    b = a.where("fold = 2").withColumn("shap", F.when(F.col("feature_id") % 2 == 0, F.col("shap")).otherwise(-F.col("shap") / 2))
    runs = a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b")))
    return explain.case_study(runs, "run", ["a", "b"])


@query("select 'tfidf_meta' as experiment, * from summary where split_mode = 'task_group_kfold' order by r2_mean desc")
def predictive_anchor(s, d):
    return report.predictive_anchor(metrics.summarize(_cv(s, d)).withColumn("experiment", F.lit("tfidf_meta")))


@query("select 'TF-IDF' as representation, model, split_mode, r2_mean, r2_std from summary")
def score_chart(s, d):
    return report.score_chart(metrics.summarize(_cv(s, d)).withColumn("experiment", F.lit("tfidf_meta")))


@query("select 'e' as experiment, model, split_mode, printf('%.3f ± %.3f', r2_mean, r2_std) as r2, printf('%.3f ± %.3f', mae_mean, mae_std) as mae, printf('%.3f ± %.3f', mse_mean, mse_std) as mse from summary")
def score_table(s, d):
    return report.score_table(metrics.summarize(_cv(s, d)).withColumn("experiment", F.lit("e")))


@query("select split_mode, model, n_repeats, " + ", ".join(f"round_even({m}_{k}, 4) as {m}_{k}" for m in ("r2", "mae", "mse") for k in ("mean", "std")) + f" from ({REPEATED})")
def robust_table(s, d):
    r = metrics.repeated_summary(_cv(s, d).withColumn("rep", F.col("fold") % 2), ["split_mode", "model"])
    return report.robust_table(r)


# What runs leave behind: written, found again and consolidated.


def _stored_importance(s, d):
    """Importance tables as CSV exports, one run a fold, below folders that name run, split and model."""
    root = results.work_dir(s)
    for fold in range(I.FOLDS):
        own = _by_fold(s, d).where(F.col("fold") == fold).select("feature", "mean_abs_shap")
        results.export_csv(own, f"{root}/run{fold}/global_shap_row_kfold_ridge.csv")
    return root


@query("select 'run' || fold as run, 'row_kfold' as split_mode, 'ridge' as model, feature, mean_abs_shap from by_fold")
def labelled_csv(s, d):
    return results.read_labelled_csv(s, _stored_importance(s, d), "feature string, mean_abs_shap double")


@query("select distinct l_returnflag as name from lineitem")
def discovered_runs(s, d):
    root = results.work_dir(s)
    for r in s.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag").distinct().collect():  # three values
        results.write_metadata(s, root, f"run-{r.l_returnflag}", {"name": r.l_returnflag, "agg_mode": "mean", "cv_folds": I.FOLDS, "seed": I.SEED})
    return results.discover_runs(s, root).select("name")


@query("select agg_mode, experiment, count(*) as n_rows, avg(target_value) as target_mean, count(*) as n_predictions from (select 'mean' as agg_mode, target_value from supervised union all select 'max', a.target_value from supervised s join agg_max a on s.task_id = a.task_id and s.flow_id = a.flow_id), (select unnest(['one', 'two']) as experiment) group by 1, 2")
def grid_runs(s, d):
    """Two configurations under both aggregations, whose stages are shared: what each run left behind."""
    root = results.work_dir(s)
    base = pipeline.Config("base", text_mode="none", models=("ridge",), prefixes=I.KEEP, run_task_group_kfold=False, settings=SMALL)
    pipeline.run_grid(s, I.evaluations(s, d), I.tasks(s, d), I.flows(s, d), pipeline.grid(base, {"one": {}, "two": {"seed": 7}}), root)
    of = lambda kind, *sums: results.read_results(s, root, kind).groupBy("agg_mode", F.col("run").alias("experiment")).agg(*sums)
    rows = of("supervised", F.count("*").alias("n_rows"), F.avg("target_value").alias("target_mean"))
    return rows.join(of("predictions", F.count("*").alias("n_predictions")), ["agg_mode", "experiment"])


@query("select row_id, task_id, flow_id, target_value from supervised")
def run_artifacts(s, d):
    root = results.work_dir(s)
    supervised = _supervised(s, d)
    results.write_result(supervised, root, "supervised", "one")
    results.write_result(supervised.where("false"), root, "features", "none")
    results.write_result(features.numeric_features(supervised, ["NumberOfInstances"]), root, "features", "one")
    return results.read_artifacts(s, root, "one")[0].select("row_id", "task_id", "flow_id", "target_value")


@query("select * from agg_mean")
def computed_once(s, d):
    """The second call reads what the first one wrote, its own table is never made; other data are another table."""
    root, payload, evals = results.work_dir(s), {"table": "targets", "agg_mode": "mean"}, I.evaluations(s, d)
    results.materialize(s, lambda: tables.aggregate_evaluations(evals.withColumn("value", F.lit(5.0))), root, "targets", payload, [evals.withColumn("value", F.lit(5.0))])
    results.materialize(s, lambda: tables.aggregate_evaluations(evals), root, "targets", payload, [evals])
    return results.materialize(s, lambda: s.range(0), root, "targets", payload, [evals])


@query("select experiment, agg_mode, model, split_mode, r2_mean, r2_std from (select unnest(['a', 'b']) as experiment, 'mean' as agg_mode, * from summary) where split_mode = 'task_group_kfold'")
def consolidated_anchor(s, d):
    root, summary = results.work_dir(s), results.written(metrics.summarize(_cv(s, d)))
    for run, agg in (("a", "mean"), ("b", "mean"), ("c", "max")):
        results.write_result(summary, root, "summary", run, agg)
    return pipeline.consolidate(s, root, "mean")["predictive_anchor"].select("experiment", "agg_mode", "model", "split_mode", "r2_mean", "r2_std")


@query("select unnest(['one', 'one', 'two']) as root, unnest(['a', 'b', 'a']) as experiment, model, split_mode, r2_mean from summary")
def consolidated_discovered(s, d):
    """Runs found by their metadata below two roots; run c has none."""
    base, summary = results.work_dir(s), results.written(metrics.summarize(_cv(s, d)))
    for root, run in (("one", "a"), ("one", "b"), ("one", "c"), ("two", "a")):
        results.write_result(summary, f"{base}/{root}", "summary", run)
        if run != "c":
            results.write_metadata(s, f"{base}/{root}", f"mean-{run}", {"name": run, "agg_mode": "mean"})
    return pipeline.consolidate_discovered(s, [f"{base}/one", f"{base}/two"], "summary", "mean").select("root", "experiment", "model", "split_mode", "r2_mean")


@query("select unnest(['a', 'b']) as experiment, 'm' as model, count(*) as n, avg(readability) as readability_mean, stddev_pop(readability) as readability_std, avg(sparsity) as sparsity_mean, stddev_pop(sparsity) as sparsity_std from local")
def consolidated_local(s, d):
    root = results.work_dir(s)
    labels = {"split_mode": F.lit("task_group_kfold"), "model": F.lit("m")}
    local = results.written(explain.local_metrics(I.attributions(s, d), LOCAL).withColumns(labels))
    shap = explain.shap_summary(local, explain.fold_stability(explain.global_topk(_by_fold(s, d), ["fold"])).withColumns(labels), ["split_mode", "model"])
    summary = results.written(local.select("split_mode", "model").distinct().withColumn("r2_mean", F.lit(0.0)))
    for run in ("a", "b"):
        for kind, table in (("local_shap_metrics", local), ("shap_summary_metrics", shap), ("summary", summary)):
            results.write_result(table, root, kind, run)
    return pipeline.consolidate(s, root, "mean")["local_summary"]


@query("select r.row_id, h.held, case when r.fold = h.held then 'test' else 'train' end as part from row_folds r, (select unnest(range(5)) as held) h")
def split_rows(s, d):
    """Train and test rows of every fold."""
    folded = results.written(_folded(s, d)["row_kfold"].select("row_id", "fold"))
    parts = [side.select("row_id", F.lit(k).alias("held"), F.lit(name).alias("part")) for k in range(I.FOLDS) for name, side in zip(("train", "test"), folds.split(folded, k), strict=True)]
    return pipeline.union(parts)


_X = "select row_id, fold, y, x from row_folds join (select row_id, NumberOfInstances / (select stddev_pop(NumberOfInstances) from supervised) as x from supervised) using (row_id)"


@query(f"with points as ({_X}), sums as (select h.held, count(*) as n, avg(x) as mx, avg(y) as my, sum(x * x) as xx, sum(x * y) as xy from points, (select unnest(range(5)) as held) h where fold <> h.held group by 1), line as (select held, (xy - n * mx * my) / (xx - n * mx * mx + 1) as w, mx, my from sums) select fold, row_id, y as y_true, my + w * (x - mx) as y_pred from points join line on fold = held")
def ridge_validation(s, d):
    """Cross-validated ridge on one metafeature, whose closed form SQL can state."""
    supervised = results.written(_supervised(s, d))
    long = features.numeric_features(supervised, ["NumberOfInstances"])
    matrix = features.to_vectors(long, features.feature_dictionary(long), 1)
    rows = supervised.select("row_id", F.col("target_value").alias("y")).join(matrix, "row_id")
    folded = folds.row_folds(rows, "row_id", I.FOLDS, I.SEED)
    return models.cross_validate(folded, ["ridge"], "row_kfold", I.SEED, SMALL).select("fold", "row_id", "y_true", "y_pred")


_POINTS = "points as (select row_id, target_value as y, coalesce(NumberOfInstances, 0) as x from supervised)"


@query(f"""with {_POINTS}, mean as (select avg(y) as m from points), kinds as (select x, count(*) as n, sum(y - m) as g from points, mean group by 1),
sides as (select x, sum(n) over (order by x) as nl, sum(g) over (order by x) as gl, lead(x) over (order by x) as next, sum(n) over () as n, sum(g) over () as g from kinds),
best as (select (x + next) / 2 as t, gl / nl as l, (g - gl) / (n - nl) as r from sides where next is not null and nl >= 20 and n - nl >= 20 order by gl * gl / nl + (g - gl) * (g - gl) / (n - nl) desc, x limit 1)
select row_id, m + 0.5 * case when x <= t then l else r end as y_pred from points, mean, best""")
def boosted_split(s, d):
    """One round of boosting with one split on one feature, whose cuts are all midpoints."""
    rows = _supervised(s, d).select("row_id", F.col("target_value").alias("y"), array_to_vector(F.array(F.coalesce(F.col("NumberOfInstances").cast("double"), F.lit(0.0)))).alias("features"))
    rows = results.written(rows)
    every = trees.Boosting(iterations=1, step=0.5, leaves=2, bins=1 << 40, cut_rows=1 << 60)
    return trees.boosted_trees(rows, I.SEED, every).transform(rows).select("row_id", F.col("prediction").alias("y_pred"))


_RANDOM = ("NumberOfInstances", "NumberOfFeatures", "NumberOfClasses")


@query(f"""with long as ({" union all ".join(f"select {k} as feature, cast(coalesce({c}, 0) as double) as x, target_value as y from supervised" for k, c in enumerate(_RANDOM))}),
ranges as (select feature, min(x) as low, max(x) as high, count(*) as n, sum(y) as s from long group by 1),
drawn as (select tree, feature, n, s, low + cast(cast('0x' || substr(md5(concat_ws('::', tree, 0, feature, 42)), 1, 13) as bigint) as double) / 4503599627370496 * (high - low) as threshold from ranges, (select unnest(range(20)) as tree) where low < high),
sides as (select tree, d.feature, threshold, d.n, d.s, count(*) as n_left, sum(y) as s_left from drawn d join long l on l.feature = d.feature and x <= threshold group by all),
gains as (select *, s_left * s_left / n_left + (s - s_left) * (s - s_left) / (n - n_left) - s * s / n as gain from sides where n_left < n)
select tree, feature, threshold, n_left, s_left / n_left as left_mean, (s - s_left) / (n - n_left) as right_mean from (select *, row_number() over (partition by tree order by gain desc, feature) as r from gains) where r = 1""")
def random_split(s, d):
    """The first level of twenty extremely random trees."""
    cells = F.array(*[F.struct(F.lit(k).alias("f"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for k, c in enumerate(_RANDOM)])
    rows = _supervised(s, d).select(F.col("target_value").alias("y"), F.filter(cells, lambda c: c["v"] != 0).alias("_cells"))
    found = trees.random_splits(rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("tree"), F.lit(0).alias("node")), I.SEED)
    return found.select("tree", "feature", "threshold", "n_left", (F.col("s_left") / F.col("n_left")).alias("left_mean"), ((F.col("s") - F.col("s_left")) / (F.col("n") - F.col("n_left"))).alias("right_mean"))


@query("select column_name as feature from (describe select * from supervised) where column_type in ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE', 'BOOLEAN') and column_name not in ('task_id', 'flow_id', 'dataset_id', 'target_value', 'value_std', 'value_count')")
def feature_columns(s, d):
    return s.createDataFrame([(c,) for c in tables.feature_columns(_supervised(s, d))], "feature string")


# Models and whole runs: no SQL; tests hold them against closed forms, subset enumeration and invariants.


def _matrix(s, d):
    """(row_id, task_id, features, y) with scaled task metafeatures, and their number."""
    meta = tables.normalize_tasks(I.tasks(s, d))[1]
    supervised = results.written(_supervised(s, d).select("row_id", "task_id", F.col("target_value").alias("y"), *meta))  # statistics, folds and every fit read it
    rows, names = features.numeric_vectors(supervised, meta)
    return rows, len(names)


def _forest(s, d):
    """Leaves of a forest on the training rows of one fold, sampled test rows and background."""
    rows, width = _matrix(s, d)
    train, test = folds.split(results.written(folds.row_folds(rows, "row_id", I.FOLDS, I.SEED)), 0)
    model = models.random_forest(train, I.SEED, SMALL).model
    narrow = lambda df: df.select("row_id", "fold", "features")
    background = folds.sample(narrow(train).withColumn("g", F.lit(0)), ["g"], "row_id", 50, I.SEED, "background").orderBy("row_id").collect()
    leaves = attribution.ensemble_leaves(s, model, f"{results.work_dir(s)}/forest")
    return leaves, folds.sample(narrow(test), ["fold"], "row_id", 20, I.SEED), [r.features for r in background], width


@query(None)
def cross_validation(s, d):
    """All models with the folds and sizes of the full study."""
    folded = folds.with_group_folds(_matrix(s, d)[0], "task_id", I.FOLDS)
    return models.cross_validate(folded.select("row_id", "features", "y", "fold"), None, "task_group_kfold", I.SEED, models.PAPER)


@query(None)
def repeated_validation(s, d):
    predictions = pipeline.repeated_validation(_matrix(s, d)[0], "task_id", ["ridge"], repeats=2, k=3, settings=SMALL)
    return metrics.repeated_summary(metrics.fold_metrics(predictions, ["model", "rep", "fold"]), ["model"])


@query(None)
def robust_stability(s, d):
    """Overlap of the two strongest metafeatures over the folds of repeated group folds."""
    supervised = results.written(_supervised(s, d))
    long = results.written(features.build_features(supervised, "none", tables.normalize_tasks(I.tasks(s, d))[1]))
    dictionary = results.written(features.feature_dictionary(long))
    matrix = features.to_vectors(long, dictionary, dictionary.count())
    rows = results.written(supervised.select("row_id", "task_id", F.col("target_value").alias("y")).join(matrix, "row_id"))
    config = pipeline.Config("robust", text_mode="none", models=("ridge", "random_forest"), cv_folds=3, top_k=2, settings=SMALL)
    return pipeline.repeated_stability(s, rows, "task_id", dictionary, config, results.work_dir(s), repeats=2)["stability"]


@query(None)
def tree_attributions(s, d):
    leaves, rows, background, _ = _forest(s, d)
    return attribution.explain(rows, leaves, background)[0]


@query(None)
def tree_interactions(s, d):
    leaves, rows, _, width = _forest(s, d)
    return attribution.explain_interactions(rows, leaves, width)


def _explained_folds(s, d, interactions: bool):
    """Attributions (and interactions) of a forest in every fold, with the sample sizes of the full study."""
    meta = tables.normalize_tasks(I.tasks(s, d))[1]
    supervised = results.written(_supervised(s, d).select("row_id", F.col("target_value").alias("y"), *meta))
    rows, names = features.numeric_vectors(supervised, meta)
    dictionary = s.createDataFrame(list(enumerate(names)), "feature_id int, feature string")
    folded = results.written(folds.row_folds(rows, "row_id", I.FOLDS, I.SEED))
    config = pipeline.Config("folds", text_mode="none", models=("random_forest",), compute_interactions=interactions, settings=SMALL)
    own: dict = {}
    models.cross_validate(folded, list(config.models), "row_kfold", I.SEED, SMALL, own)
    some = pipeline.drawn(folded, list(range(I.FOLDS)), config)
    found = [pipeline.explained(s, some, own[k], *k, "row_kfold", config, results.work_dir(s), dictionary) for k in sorted(own)]
    return pipeline.union([f[1 if interactions else 0] for f in found])


@query(None)
def fold_attributions(s, d):
    return _explained_folds(s, d, False).select("fold", "row_id", "feature", "shap")


@query(None)
def fold_interactions(s, d):
    return explain.interaction_ratio(_explained_folds(s, d, True), ["fold"])


def _text_rows(s, d):
    """(row_id, features, y, fold) with the whole vocabulary and scaled metafeatures, and the feature names."""
    meta = tables.normalize_tasks(I.tasks(s, d))[1]
    supervised = results.written(_supervised(s, d).select("row_id", F.col("target_value").alias("y"), "flow_text_clean", *meta))
    words = features.tokenized_clean(supervised, "flow_text_clean")
    chosen, stats = features.fitted(words, supervised.count())[0], features.numeric_statistics(supervised, meta)
    model = feature_model.FeatureModel([t.term for t in chosen], [t.idf for t in chosen], stats)
    weights = features.text_weights(words, model.vocabulary, model.idf) if chosen else None
    keyed = folds.row_folds(features.with_text_key(supervised, "flow_text_clean"), "row_id", I.FOLDS, I.SEED)
    return features.row_vectors(keyed, weights, len(chosen), stats, meta), s.createDataFrame(list(enumerate(model.names)), "feature_id int, feature string")


def _text_explained(s, d, interactions: bool):
    """A forest over words and metafeatures in every fold, its sampled rows explained."""
    folded, dictionary = _text_rows(s, d)
    config = pipeline.Config("text", models=("random_forest",), compute_interactions=interactions, settings=SMALL)
    own: dict = {}
    models.cross_validate(folded, list(config.models), "row_kfold", I.SEED, SMALL, own)
    some = pipeline.drawn(folded, list(range(I.FOLDS)), config)
    return [pipeline.explained(s, some, own[k], *k, "row_kfold", config, results.work_dir(s), dictionary) for k in sorted(own)]


@query(None)
def text_attributions(s, d):
    """(fold, row_id, feature, shap) of sparse rows over the whole vocabulary."""
    return pipeline.union([a for a, _, _ in _text_explained(s, d, False)]).select("fold", "row_id", "feature", "shap")


@query(None)
def text_interactions(s, d):
    """(fold, row_id, feature_i, feature_j, value) of all pairs that share a path, over the whole vocabulary."""
    return pipeline.union([b for _, b, _ in _text_explained(s, d, True)]).select("fold", "row_id", "feature_i", "feature_j", "value")


@query(None)
def whole_text_run(s, d):
    """Text and metafeatures, fitted on each fold's training rows, with attributions of every fold."""
    config = pipeline.Config("tfidf_meta", fit_scope="fold", models=("random_forest",), prefixes=I.KEEP, cv_folds=3, compute_shap=True, settings=SMALL)
    root = results.work_dir(s)
    pipeline.run(s, I.evaluations(s, d), I.tasks(s, d), I.flows(s, d), config, root)
    return pipeline.consolidate(s, root, "mean")["shap_summary"]


@query(None)
def whole_run(s, d):
    config = pipeline.Config("meta_only", text_mode="none", models=("ridge", "random_forest"), prefixes=I.KEEP, cv_folds=3, settings=SMALL)
    root = results.work_dir(s)
    pipeline.run(s, I.evaluations(s, d), I.tasks(s, d), I.flows(s, d), config, root)
    return pipeline.consolidate(s, root, "mean")["predictive_anchor"]
