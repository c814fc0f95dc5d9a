"""Text vectors that are computed once: kept under the md5 of their text, new texts alone are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators.features import Encoder, encode_texts
from benchlens.sources import results

_SCHEMA = "text_key string, vector array<double>"


def text_key(column: str):
    """The md5 of a text; null is the empty text."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))


class EncoderStore:
    """Vectors of one encoder below ``root``/``name``, in one folder for each run that added some.

    ``name`` must change with the encoder.  A folder is named by the texts that it holds and published whole,
    so of two runs that encode the same texts one adds them, and a run that died added nothing.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def stored(self) -> DataFrame:
        """(text_key, vector) of all folders; runs whose texts overlap may have added a text twice."""
        if not results.exists(self.spark, self.path):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def add(self, df: DataFrame, text: str, encoder: Encoder) -> int:
        """Encode those texts of ``df`` that are not stored yet; returns how many these were."""
        texts = df.select(text_key(text).alias("text_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        new, path = results.write_table(texts.dropDuplicates(["text_key"]).join(self.stored().select("text_key"), "text_key", "left_anti"))
        n, digest = new.agg(F.count("*"), F.sum(F.conv(F.substring("text_key", 1, 15), 16, 10).cast("decimal(38,0)"))).first()
        if n:
            beside = f"{self.path}/.making-{digest}-{results.fresh()}"
            encode_texts(new, "text", encoder).select(text_key("text").alias("text_key"), "vector").write.parquet(beside)
            results.publish(self.spark, beside, f"{self.path}/texts-{n}-{digest}")
        results.remove_table(self.spark, path)
        return n

    def vectors(self, df: DataFrame, text: str, encoder: Encoder) -> DataFrame:
        """(text_key, vector) of the distinct texts of ``df``, new ones encoded first."""
        self.add(df, text, encoder)
        wanted = df.select(text_key(text).alias("text_key")).distinct()
        return self.stored().join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
