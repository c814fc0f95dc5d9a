"""Features as a fitted model: vocabulary, term weights, medians and scales that can be saved and applied to new rows.

The estimator fits by aggregations; the model transforms in the JVM alone (count vectorizer, element-wise
product, normaliser, assembler), so rows never pass a Python worker.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.functions.text import META, TEXT, clean_text, tokens
from benchlens.operators import features as long_form


class _FeatureParams(Params):
    textCol = Param(Params._dummy(), "textCol", "text column; empty: no text features", TypeConverters.toString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms of the vocabulary at most", TypeConverters.toInt)
    maxDF = Param(Params._dummy(), "maxDF", "share of rows that a term may occur in", TypeConverters.toFloat)
    bigrams = Param(Params._dummy(), "bigrams", "pairs of neighbouring tokens too", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(textCol="", numericCols=[], outputCol="features", maxFeatures=5000, maxDF=0.95, bigrams=True)


class FeatureEstimator(_FeatureParams, Estimator):
    """Fits a ``FeatureModel`` on a table of rows."""

    def __init__(self, **values):
        super().__init__()
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        p = {k.name: v for k, v in self.extractParamMap().items()}
        if not p["textCol"] and not p["numericCols"]:
            raise ValueError("no features selected")
        vocabulary, idf, numeric = [], [], {}
        if p["textCol"]:
            texts = long_form.tokenized(dataset, p["textCol"])
            chosen, _, _ = long_form.fitted(texts, dataset.count(), p["maxFeatures"], p["maxDF"], p["bigrams"])
            vocabulary, idf = [t.term for t in chosen], [t.idf for t in chosen]
        if p["numericCols"]:
            numeric = long_form.numeric_statistics(dataset, p["numericCols"])
        return self._copyValues(FeatureModel(vocabulary, idf, numeric))


class FeatureModel(_FeatureParams, Model, MLWritable, MLReadable):
    """Text block by term, then numeric block by column name, as sparse vectors."""

    def __init__(self, vocabulary: list[str] = (), idf: list[float] = (), numeric: dict[str, tuple[float, float]] | None = None):
        super().__init__()
        self.vocabulary, self.idf, self.numeric = list(vocabulary), list(idf), dict(sorted((numeric or {}).items()))

    @property
    def names(self) -> list[str]:
        """The features' names by position."""
        return [TEXT + t for t in self.vocabulary] + [META + c for c in self.numeric]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts, out = [], dataset
        if self.vocabulary:
            out = out.withColumn("_words", tokens(clean_text(F.col(self.getOrDefault("textCol")).cast("string"))))
            out = long_form.term_vectors(out, "_words", self.vocabulary, "_counts", self.getOrDefault("bigrams"))
            out = long_form.unit_vectors(out, "_counts", self.idf, "_text")
            parts.append("_text")
        if self.numeric:
            value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
            out = out.withColumn("_numbers", array_to_vector(F.array(*[F.coalesce(value(c), F.lit(m)) / F.lit(s) for c, (m, s) in self.numeric.items()])))
            parts.append("_numbers")
        if not parts:
            raise ValueError("the model has no features")
        made = VectorAssembler(inputCols=parts, outputCol=self.getOrDefault("outputCol")).transform(out)
        return made.drop("_words", "_counts", "_text", "_numbers")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_TABLE = "kind string, position int, name string, a double, b double"


def _rows_of(m: FeatureModel) -> list[tuple]:
    rows = [("term", k, t, float(w), 0.0) for k, (t, w) in enumerate(zip(m.vocabulary, m.idf, strict=True))]
    return rows + [("column", k, c, float(median), float(scale)) for k, (c, (median, scale)) in enumerate(m.numeric.items())]


def _model_of(rows: list) -> FeatureModel:
    text = [r for r in rows if r.kind == "term"]
    return FeatureModel([r.name for r in text], [r.a for r in text], {r.name: (r.a, r.b) for r in rows if r.kind == "column"})


def fitted_table(spark: SparkSession, models: dict[tuple[str | None, int | None], FeatureModel]) -> DataFrame:
    """The models of a run by protocol and held-out fold (both null: fitted on all rows), one row a feature."""
    return spark.createDataFrame([(*scope, *r) for scope, m in models.items() for r in _rows_of(m)], f"split_mode string, fold int, {_TABLE}").coalesce(1)


def fitted_models(table: DataFrame) -> dict[tuple[str | None, int | None], FeatureModel]:
    found: dict = {}
    for r in table.orderBy("split_mode", "fold", "kind", "position").collect():  # one row a feature and fold
        found.setdefault((r.split_mode, r.fold), []).append(r)
    return {scope: _model_of(rows) for scope, rows in found.items()}


def long_features(rows: DataFrame, models: dict[tuple[str | None, int | None], FeatureModel], text: str = "flow_text") -> DataFrame:
    """([split_mode, fold,] row_id, feature, value) of every model, made from the rows when it is read."""
    parts = []
    for (mode, fold), m in models.items():
        label = [] if mode is None else [F.lit(mode).alias("split_mode"), F.lit(fold).alias("fold")]
        if m.vocabulary:
            counts = long_form.term_vectors(rows.select("row_id", tokens(clean_text(F.col(text).cast("string"))).alias("w")), "w", m.vocabulary, "c")
            own = long_form.unit_vectors(counts, "c", m.idf, "v").select("row_id", F.unwrap_udt("v").alias("v"))
            cells = own.select("row_id", F.inline(F.arrays_zip("v.indices", "v.values")).alias("k", "value"))
            names = rows.sparkSession.createDataFrame([(k, TEXT + t) for k, t in enumerate(m.vocabulary)], "k int, feature string")
            parts.append(cells.join(F.broadcast(names), "k").select(*label, "row_id", "feature", "value"))  # the vocabulary
        if m.numeric:
            scaled = [F.struct(F.lit(META + c).alias("feature"), (F.coalesce(long_form.plain(c), F.lit(median)) / F.lit(s)).alias("value")) for c, (median, s) in m.numeric.items()]
            parts.append(rows.select("row_id", F.inline(F.array(*scaled))).select(*label, "row_id", "feature", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Writer(MLWriter):
    """Parameters as MLlib's metadata, fitted values as one Parquet table."""

    def __init__(self, model: FeatureModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = self.sparkSession, self.model
        DefaultParamsWriter.saveMetadata(m, path, spark)
        spark.createDataFrame(_rows_of(m), _TABLE).coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> FeatureModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.schema(_TABLE).parquet(f"{path}/data").orderBy("kind", "position").collect()  # one row a feature
        model = _model_of(rows)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
