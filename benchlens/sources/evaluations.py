"""Readers of evaluations, tasks and flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benchlens.operators.tables import used_flow_ids


def read_tables(spark: SparkSession, paths: list[str], kind: str = "parquet", **options) -> DataFrame:
    """Files of one kind (parquet, json, csv, orc) as one table; columns that some lack are null there."""
    if not paths:
        raise ValueError("no input paths")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.options(**options).format(kind).load(p) for p in paths])


def load_evaluations(parts: list[DataFrame], tasks: DataFrame | None = None, per_task: int | None = None, order: list[str] | None = None, check: bool = True, function: str | None = None) -> DataFrame:
    """The union of evaluation batches, of one metric ``function`` if named (a column of that name, which
    then goes), limited to listed tasks, with at most ``per_task`` rows of
    each task in a stable order, and whole rows distinct.  Raises if nothing is left.

    The cap comes before the dedup.  Each task keeps its first rows of every shard of a hash before
    these meet, so a task of any size is ranked by many tasks of Spark.
    """
    if not parts:
        raise ValueError("no evaluations")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if function is not None:
        rows = rows.where(F.col("function") == function).drop("function")
    if tasks is not None:
        rows = rows.join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    if per_task is not None:
        keys = order or [c for c in rows.columns if c != "task_id"]
        rows = rows.withColumn("_s", F.pmod(F.xxhash64(*keys), F.lit(64)))
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("task_id", "_s").orderBy(*keys))).where(F.col("_r") <= per_task)
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("task_id").orderBy(*keys))).where(F.col("_r") <= per_task).drop("_s", "_r")
    rows = rows.dropDuplicates()
    if check and rows.isEmpty():
        raise ValueError("no evaluations were loaded")
    return rows


def load_tasks(tasks: DataFrame, suite: DataFrame, key: str = "tid") -> DataFrame:
    """Tasks that a suite (task_id) lists."""
    return tasks.join(suite.select(F.col("task_id").alias(key)).distinct(), key, "left_semi")


def load_flows(flows: DataFrame, evals: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Flows that evaluations refer to, and the referred ids that no flow has."""
    used = used_flow_ids(evals)
    return flows.join(used.withColumnRenamed("flow_id", key), key, "left_semi"), used.join(flows.select(F.col(key).alias("flow_id")), "flow_id", "left_anti")
