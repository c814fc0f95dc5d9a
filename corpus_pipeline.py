"""Corpus cleaning: quality classifier, near-dedup, benchmark decontamination, subword encoding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns that they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.llm import decontamination, merge_dropout, near_dedup, quality
from benchlens.llm.common import free_name, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds of low quality go (score under 0.5).

    Null and empty texts score the labels' mean; repeated rows are judged each; very long texts whole.
    All columns stay, one named ``score`` too; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    scored = quality.score(docs, model, name=name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays, in one row.

    Rows without id or text all stay; every text of a repeated id is judged by itself.  All columns
    stay; an empty table stays empty.
    """
    return near_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents without one stay as they are.

    ``n_chars``, where there is such a column, follows a cut text.  Null and empty texts stay, very long
    texts are searched whole, repeated rows are cut each, and an empty table or benchmark cuts nothing.
    All columns stay, those named like the operator's own too.
    """
    before = free_name(docs, "before")
    cut = decontamination.remove_contamination(docs.withColumn(before, F.length("text")), table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.length("text") < F.col(before), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.drop(before)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids by seeded merge-dropout, as ``piece_ids`` beside the document.

    Null text has null ids, an empty one none; very long texts are encoded whole; repeated rows get
    equal ids.  A column named ``piece_ids`` is replaced; an empty table stays empty.
    """
    return merge_dropout.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("merge_dropout_encoding", encode),
]

#: The stages hold a fitted model, hashed signatures and a subword vocabulary: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
