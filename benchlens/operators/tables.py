"""From raw evaluations, tasks and flows to the supervised table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.functions.text import clean_text, number

# Numeric task descriptions that may serve as features.
METAFEATURES = (
    "MajorityClassSize",
    "MaxNominalAttDistinctValues",
    "MinorityClassSize",
    "NumberOfClasses",
    "NumberOfFeatures",
    "NumberOfInstances",
    "NumberOfInstancesWithMissingValues",
    "NumberOfMissingValues",
    "NumberOfNumericFeatures",
    "NumberOfSymbolicFeatures",
)
#: Columns of the supervised table that are never features.
NOT_FEATURES = frozenset("row_id task_id flow_id dataset_id tid did target_value value_std value_count value fold rep".split())
PREFIX = "sklearn."


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def normalize_flows(flows: DataFrame, flow_id: str = "flow_id", text: str = "flow_text") -> DataFrame:
    """Flow records with a composed description, and that cleaned.

    Empty and null parts are left out of the description; a record without id falls back to a
    column ``key``, if there is one, and is dropped where that is null too.
    """
    have = {f.name for f in flows.schema}
    part = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    known = [F.col(c).try_cast("long") for c in ("id", "key") if c in have]
    lines = [F.when(part(c) != "", F.concat(F.lit(f"{c}: "), part(c))) for c in ("name", "full_name", "version", "external_version")]
    out = flows.select(F.coalesce(*known).alias(flow_id), *[part(c).alias(f"flow_{c}") for c in ("name", "full_name", "version", "external_version", "uploader")], F.concat_ws("\n", *lines).alias(text))
    return out.where(F.col(flow_id).isNotNull()).withColumn(f"{text}_clean", clean_text(F.col(text)))


def flows_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows ``(key, id, name, ...)`` from JSON texts that map ids to records; what is no record goes."""
    record = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("name", "full_name", "version", "external_version", "uploader")]])
    parsed = lines.select(F.from_json(column, T.MapType(T.StringType(), T.StringType())).alias("m"))
    rows = parsed.select(F.explode("m").alias("key", "text")).where(F.ltrim("text").startswith("{"))
    return rows.select("key", F.from_json("text", record).alias("r")).where("r is not null").select("key", "r.*")


def normalize_tasks(tasks: DataFrame) -> tuple[DataFrame, list[str]]:
    """Tasks with ids renamed and the metafeatures that are there, and the list of those."""
    found = [c for c in METAFEATURES if c in tasks.columns]
    renamed = tasks.withColumnsRenamed({"tid": "task_id", "did": "dataset_id", "name": "task_name"})
    require(renamed, ["task_id", "dataset_id", "task_name"])
    return renamed.select("task_id", "dataset_id", "task_name", *found), found


def numeric_values(evals: DataFrame, value: str = "value") -> DataFrame:
    """Evaluations whose value is a number, as double; null keys go."""
    require(evals, ["task_id", "flow_id", value])
    kept = evals.withColumn(value, number(F.col(value)))
    return kept.where(F.col(value).isNotNull() & F.col("task_id").isNotNull() & F.col("flow_id").isNotNull())


def aggregate_evaluations(evals: DataFrame, value: str = "value", agg_mode: str = "mean") -> DataFrame:
    """Target, sample deviation (0 for one observation) and count for each task and flow."""
    if agg_mode not in ("mean", "max"):
        raise ValueError(f"agg_mode {agg_mode!r}: mean or max")
    target = F.avg(value) if agg_mode == "mean" else F.max(value)
    return numeric_values(evals, value).groupBy("task_id", "flow_id").agg(target.alias("target_value"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("value_std"), F.count(value).alias("value_count"))


def has_prefix(df: DataFrame, prefixes: str | tuple[str, ...] = PREFIX):
    """Whether a flow's name or full name begins with one of the prefixes (null and absent: no)."""
    prefixes = (prefixes,) if isinstance(prefixes, str) else prefixes
    out = F.lit(False)
    for c in ("flow_name", "flow_full_name"):
        if c in df.columns:
            for p in prefixes:
                out = out | F.coalesce(F.col(c).startswith(p), F.lit(False))
    return out


def used_flow_ids(evals: DataFrame) -> DataFrame:
    """The distinct flow ids of raw evaluations that are whole numbers."""
    return evals.select(F.col("flow_id").try_cast("long").alias("flow_id")).na.drop().distinct()


def relevant_flows(flows: DataFrame, evals: DataFrame, prefixes: str | tuple[str, ...] = PREFIX) -> DataFrame:
    """Flows that evaluations use and whose names have a prefix.  Filtered before the semi-join."""
    return flows.where(has_prefix(flows, prefixes)).join(used_flow_ids(evals), "flow_id", "left_semi")


def restrict_evaluations(evals: DataFrame, flows: DataFrame) -> DataFrame:
    """Evaluations of flows that were kept.  The optimizer broadcasts the ids where they are few."""
    return evals.join(flows.select("flow_id").distinct(), "flow_id", "left_semi")


def with_row_id(df: DataFrame) -> DataFrame:
    require(df, ["task_id", "flow_id"])
    return df.withColumn("row_id", F.concat_ws("::", F.col("task_id").cast("string"), F.col("flow_id").cast("string")))


def supervised_table(evals: DataFrame, tasks: DataFrame, flows: DataFrame, text: str = "flow_text", target: str = "target_value", strict: bool = False) -> DataFrame:
    """Aggregated evaluations with what is known of their tasks and flows.

    Rows without a task stay, with null metafeatures; rows without text or target go; empty text
    stays.  Repeated task or flow keys repeat rows, or raise if ``strict``.
    """
    if strict:
        for name, side, key in (("tasks", tasks, "task_id"), ("flows", flows, "flow_id")):
            if not side.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{name} repeat a {key}")
    joined = evals.join(tasks, "task_id", "left").join(flows, "flow_id", "left")
    require(joined, [text, target])
    return with_row_id(joined.na.drop(subset=[text, target]))


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns that may be features; from the schema alone."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType | T.BooleanType) and f.name not in NOT_FEATURES]
