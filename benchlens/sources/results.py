"""Result tables of runs: partitioned Parquet, run metadata, compute-once tables and CSV exports."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.functions.text import cache_key

#: Tables of a run.
KINDS = ("cv_results", "summary", "wilcoxon_mse", "wilcoxon_r2", "global_shap", "local_shap_metrics", "global_shap_topk", "global_shap_stability", "interaction_metrics", "shap_summary_metrics", "local_shap", "explained_rows", "predictions", "supervised", "features")
METADATA = "name string, agg_mode string, text_mode string, use_task_metafeatures boolean, fit_scope string, cv_folds int, seed long, models array<string>, created string"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def work_dir(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process is a temporary one set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="benchlens-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/runs-{fresh()}"


def fresh() -> str:
    """A name that no other writer takes."""
    return uuid.uuid4().hex


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with no lineage behind it."""
    return write_table(df)[0]


def remove_table(spark: SparkSession, path: str) -> None:
    """Only tables that no frame still to be computed reads."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())


def write_result(df: DataFrame, root: str, kind: str, run: str, agg_mode: str = "mean") -> bool:
    """One table of one run, under its run's partition, computed once; empty tables are removed again."""
    if kind not in KINDS:
        raise ValueError(f"result kind {kind!r}")
    spark, path = df.sparkSession, f"{root}/{kind}/agg_mode={agg_mode}/run={run}"
    df.write.mode("overwrite").parquet(path)
    if not spark.read.schema(df.schema).parquet(path).isEmpty():
        return True
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
    for above in (at.getParent(), at.getParent().getParent()):
        try:
            if not fs.listStatus(above):
                fs.delete(above, False)
        except Py4JJavaError:  # another run of a grid has removed it, or writes to it
            if fs.exists(above) and not fs.listStatus(above):
                raise
            break
    return False


def read_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One table of all runs; the filters on agg_mode and run prune folders."""
    return spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}")


def read_artifacts(spark: SparkSession, root: str, run: str, agg_mode: str = "mean") -> tuple[DataFrame, DataFrame]:
    """The supervised table and the long features of a finished run.

    Where a run has left its fitted feature models in place of long rows, these are made from the supervised table.
    """
    from benchlens.operators import feature_model  # operators are built on this module

    own = lambda kind: spark.read.parquet(f"{root}/{kind}/agg_mode={agg_mode}/run={run}")
    supervised, kept = own("supervised"), own("features")
    return supervised, feature_model.long_features(supervised, feature_model.fitted_models(kept)) if "kind" in kept.columns else kept


def publish(spark: SparkSession, finished: str, path: str) -> bool:
    """Give a finished folder its name; False, and the folder is gone, where another one has the name already.

    The rename refuses an existing target, so of several writers one wins, and nobody ever sees a part of a
    table under ``path``.
    """
    fs, at = _file_system(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs.mkdirs(at.getParent())
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(finished), at, options)
        return True
    except Py4JJavaError:
        if not fs.exists(at):
            raise
        remove_table(spark, finished)
        return False


def identity(df: DataFrame) -> str:
    """A digest of what a frame would read: its plan, and path, size and time of every file below it.

    Frames that are not made of files alone (local rows, say) are told apart by their rows, in any order.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(k).getClass().getSimpleName() for k in range(leaves.size())}
    told = [re.sub(r"#\d+L?|file:\S*|\S+://\S*", "", plan.canonicalized().toString())]
    if kinds <= {"LogicalRelation", "OneRowRelation", "Range"}:
        folders = {}
        for f in df.inputFiles():
            folders.setdefault(f.rpartition("/")[0], set()).add(f.rpartition("/")[2])
        for folder in sorted(folders):
            fs, at = _file_system(spark, unquote(folder))
            held = {s.getPath().getName(): s for s in fs.listStatus(at)}
            told += [f"{folder}/{n}:{held[unquote(n)].getLen()}:{held[unquote(n)].getModificationTime()}" for n in sorted(folders[folder])]
    else:
        row = F.xxhash64(F.to_json(F.struct(*df.columns)))
        n, total = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
        told.append(f"{df.schema.simpleString()}:{n}:{total}")
    return hashlib.md5("\n".join(told).encode()).hexdigest()


def materialize(spark: SparkSession, make: Callable[[], DataFrame], root: str, prefix: str, payload: dict, inputs: Iterable[DataFrame] = ()) -> DataFrame:
    """The table of ``make``, computed once for each payload and each state of its ``inputs``.

    Every parameter and the identity of every frame that ``make`` reads is part of the table's name.  It is
    written beside and published whole: of several writers one wins, and one that dies leaves nothing to see.
    """
    read = [identity(df) for df in inputs]
    path = f"{root}/{cache_key(prefix, {**payload, 'inputs': read} if read else payload)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        beside = f"{root}/.making-{fresh()}"
        make().write.parquet(beside)
        publish(spark, beside, path)
    return spark.read.parquet(path)


def write_metadata(spark: SparkSession, root: str, run: str, metadata: dict) -> None:
    """One JSON row beside the run's tables."""
    row = spark.createDataFrame([json.dumps(metadata)], "string").select(F.from_json("value", METADATA).alias("m")).select("m.*")
    row.coalesce(1).write.mode("overwrite").json(f"{root}/metadata/{run}/run_metadata.json")


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """(name, dir) of every folder below ``root`` with a run_metadata.json (a file, or Spark's folder)."""
    rows = spark.read.schema(METADATA).option("recursiveFileLookup", "true").json(root, pathGlobFilter="*.json", multiLine=False)
    place = F.regexp_replace(F.col("_metadata.file_path"), r"/run_metadata\.json(?:/[^/]*)?$", "")
    found = rows.where(F.col("_metadata.file_path").rlike(r"/run_metadata\.json(?:/[^/]*)?$")).select("name", place.alias("dir"))
    return found.select(F.coalesce("name", F.regexp_extract("dir", r"([^/]+)$", 1)).alias("name"), "dir").distinct()


def read_labelled_csv(spark: SparkSession, root: str, schema: str, prefix: str = "global_shap") -> DataFrame:
    """CSV tables ``<run>/<prefix>_<split>_<model>.csv`` with run, split and model from their names.

    Each is one file, or a folder as ``export_csv`` writes it.  Files of other kinds whose names begin
    alike (``<prefix>_topk_...``) are not taken.
    """
    rows = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(root)
    pattern = rf"/([^/]+)/{prefix}_(row_kfold|task_group_kfold)_([^/]+?)\.csv(?:/[^/]*)?$"
    path = F.col("_metadata.file_path")
    return rows.where(path.rlike(pattern)).select(*[F.regexp_extract(path, pattern, k).alias(n) for k, n in ((1, "run"), (2, "split_mode"), (3, "model"))], *rows.columns)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
