"""Features in long form: (row_id, feature, value), and a vector form for MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log
from typing import NamedTuple

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from benchlens.functions.text import META, TEXT, clean_text, neighbours, terms, tokens
from benchlens.operators import selection
from benchlens.sources.results import write_table, written

TEXT_MODES = ("tfidf", "embedding", "none")
#: Makes a function from texts to vectors, once for each partition.
Encoder = Callable[[], Callable[[list[str]], list]]


class Term(NamedTuple):
    """A chosen term: how many rows have it, and its weight."""

    feature_id: int
    term: str
    df: int
    idf: float


def tokenized(df: DataFrame, text: str) -> DataFrame:
    """(text_key, n_rows, words) of each distinct cleaned text, and how many rows have it, as a table.

    Texts meet once, by key; every count below is a pass over their words.
    """
    cleaned = df.select(clean_text(F.col(text).cast("string")).alias("t"))
    distinct = cleaned.groupBy(F.md5("t").alias("text_key")).agg(F.count("*").alias("n_rows"), F.first("t").alias("t"))
    return written(distinct.select("text_key", "n_rows", tokens(F.col("t")).alias("words")))


def _reached(totals: DataFrame, n: int, most: float) -> tuple[int, int]:
    """How many terms with the largest totals hold the first ``n`` that ``most`` rows at most have, and the least total among them (0: all terms).

    A term of more rows has a greater total, and there are few of these: no more than twice the words of a mean row by ``most``.
    """
    n += totals.where(F.col("total") > most).count()
    least = totals.orderBy(F.desc("total")).limit(n).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    return n, least.least if least.n == n else 0


def fitted(texts: DataFrame, n_rows: int, max_features: int = 5000, max_df: float = 0.95, bigrams: bool = True) -> tuple[list[Term], list[str], DataFrame | None]:
    """The most frequent terms that few enough rows have; a bounded list of terms that holds them; and its counts in each text.

    ``texts`` is ``tokenized``.  Terms are chosen by corpus count, then alphabet, and numbered by alphabet.
    A pair of words is no more frequent than either of them, so only pairs of words that reach the last
    place among the words are counted; rows are counted only for the terms that may be chosen, from
    (text_key, n_rows, counts), which are None where there are no terms.  No task holds the terms of texts.
    """
    most = max_df * n_rows
    totals = written(texts.select("n_rows", F.explode("words").alias("term")).groupBy("term").agg(F.sum("n_rows").alias("total")))
    places, least = _reached(totals, max_features, most)
    if bigrams:
        # read with the size of its files: sent to the pairs where it is small
        known = written(totals.where(F.col("total") >= least).select("term"))
        both = texts.select("n_rows", F.inline(F.arrays_zip(*[x.alias(k) for k, x in zip("ab", neighbours(F.col("words")), strict=True)])).alias("a", "b"))
        for k in "ab":
            both = both.join(known.withColumnRenamed("term", k), k, "left_semi")
        pairs = both.groupBy("a", "b").agg(F.sum("n_rows").alias("total")).select(F.concat_ws(" ", "a", "b").alias("term"), "total").where(F.col("total") >= least)
        totals = written(totals.where(F.col("total") >= least).unionByName(pairs))
        places, _ = _reached(totals, max_features, most)
    able = totals.orderBy(F.desc("total"), "term").limit(places).collect()  # max_features, and those of too many rows
    if not able:
        return [], [], None
    names = [r.term for r in able]
    counts = written(term_vectors(texts, "words", names, "counts", bigrams).select("text_key", "n_rows", "counts"))
    rows = counts.select("n_rows", F.explode(F.unwrap_udt("counts")["indices"]).alias("k")).groupBy("k").agg(F.sum("n_rows").alias("df"))
    rows_of = {r.k: r.df for r in rows.collect()}  # a row for each of these terms
    chosen = [(t, rows_of[k]) for k, t in enumerate(names) if rows_of[k] <= most][:max_features]
    return [Term(k, t, df, log((1.0 + n_rows) / (1.0 + df)) + 1.0) for k, (t, df) in enumerate(sorted(chosen))], names, counts


def vocabulary(texts: DataFrame, n_rows: int, max_features: int = 5000, max_df: float = 0.95, bigrams: bool = True) -> DataFrame:
    """(feature_id, term, df, idf) of the terms that ``fitted`` chooses."""
    return texts.sparkSession.createDataFrame(fitted(texts, n_rows, max_features, max_df, bigrams)[0], "feature_id int, term string, df long, idf double")


def term_vectors(df: DataFrame, words: str, known: list[str], to: str, bigrams: bool = True) -> DataFrame:
    """``df`` with a sparse vector ``to`` of the counts of known terms, made inside the row, in the JVM."""
    counter = CountVectorizerModel.from_vocabulary(known, inputCol="_terms", outputCol=to, minTF=1.0)
    return counter.transform(df.withColumn("_terms", terms(F.col(words), bigrams))).drop("_terms")


def unit_vectors(df: DataFrame, counts: str, idf: list[float], to: str) -> DataFrame:
    """``df`` with vectors ``to``: counts by weight, of length one."""
    times_idf = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=counts, outputCol="_weighted")
    return Normalizer(p=2.0, inputCol="_weighted", outputCol=to).transform(times_idf.transform(df)).drop("_weighted")


def tfidf(df: DataFrame, text: str, max_features: int = 5000, max_df: float = 0.95, bigrams: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """(text_key, term, feature_id, weight) with unit rows; ``text_key`` is the md5 of the cleaned text.

    Fitted on all rows of ``df``, or on ``fit_on``.  The vocabulary has at most ``max_features`` rows,
    so it is broadcast.
    """
    texts = tokenized(df, text)
    base, n_rows = (texts, df.count()) if fit_on is None else (tokenized(fit_on, text), fit_on.count())
    chosen, names, counts = fitted(base, n_rows, max_features, max_df, bigrams)
    if not chosen:
        return texts.select("text_key", F.lit("").alias("term"), F.lit(0).alias("feature_id"), F.lit(0.0).alias("weight")).limit(0)
    if fit_on is not None:
        names = [t.term for t in chosen]
        counts = term_vectors(texts, "words", names, "counts", bigrams)
    idf_of = {t.term: t.idf for t in chosen}
    unit = unit_vectors(counts, "counts", [idf_of.get(t, 0.0) for t in names], "v").select("text_key", F.unwrap_udt("v").alias("v"))
    cells = unit.select("text_key", F.inline(F.arrays_zip("v.indices", "v.values")).alias("k", "weight")).where("weight > 0")
    at = {t: k for k, t in enumerate(names)}
    numbered = df.sparkSession.createDataFrame([(at[t.term], t.feature_id, t.term) for t in chosen], "k int, feature_id int, term string")
    return cells.join(F.broadcast(numbered), "k").select("text_key", "term", "feature_id", "weight")


def tfidf_features(df: DataFrame, text: str, weights: DataFrame | None = None, **options) -> DataFrame:
    """(row_id, feature, value) of every row, from its text's weights (made here unless given)."""
    weights = tfidf(df, text, **options) if weights is None else weights
    keyed = df.select("row_id", F.md5(clean_text(F.col(text).cast("string"))).alias("text_key"))
    return keyed.join(weights, "text_key").select("row_id", F.concat(F.lit(TEXT), "term").alias("feature"), F.col("weight").alias("value"))


def with_text_key(df: DataFrame, cleaned: str) -> DataFrame:
    """``df`` with ``text_key``, the md5 of a text that is cleaned already, in place of that."""
    return df.withColumn("text_key", F.md5(F.coalesce(cleaned, F.lit("")))).drop(cleaned)


def tokenized_clean(df: DataFrame, cleaned: str) -> DataFrame:
    """``tokenized`` of short texts that are cleaned already: rows are counted by text, nothing is sorted."""
    distinct = df.groupBy(F.coalesce(cleaned, F.lit("")).alias("t")).agg(F.count("*").alias("n_rows"))
    return written(distinct.select(F.md5("t").alias("text_key"), "n_rows", tokens(F.col("t")).alias("words")))


def text_weights(texts: DataFrame, vocabulary: list[str], idf: list[float], bigrams: bool = True) -> DataFrame:
    """(text_key, indices, values) of each distinct text of ``tokenized``, unit weights by term's number, as a table.

    Weights are made once for each text, however many rows have it; the size of the table's files tells a
    join whether it may be sent to the rows.
    """
    counts = term_vectors(texts, "words", vocabulary, "counts", bigrams)
    unit = unit_vectors(counts, "counts", idf, "v").select("text_key", F.unwrap_udt("v").alias("v"))
    return written(unit.select("text_key", "v.indices", "v.values"))


def row_vectors(df: DataFrame, weights: DataFrame | None, n_terms: int, stats: dict[str, tuple[float, float]], columns: list[str]) -> DataFrame:
    """``df`` with sparse ``features`` (terms, then metafeatures by name) in place of ``text_key`` and ``columns``, as a table.

    Rows meet the weights of their text; nothing is grouped by row.  Metafeatures are imputed and scaled by ``stats``.
    """
    kept, names = [c for c in df.columns if c not in {*columns, "text_key"}], sorted(stats)
    if weights is None and not names:
        raise ValueError("no features selected")
    at, value = (F.array().cast("array<int>"), F.array().cast("array<double>"))
    if weights is not None:
        df = df.join(weights.withColumnsRenamed({"indices": "_at", "values": "_value"}), "text_key", "left")
        at, value = F.coalesce("_at", at), F.coalesce("_value", value)
    if names:
        at = F.concat(at, F.array(*[F.lit(n_terms + k) for k in range(len(names))]))
        value = F.concat(value, F.array(*[F.coalesce(plain(c), F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in names]))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n_terms + len(names)).alias("size"), at.alias("indices"), value.alias("values"))
    _, path = write_table(df.select(*kept, stored.alias("features")))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def embedding_features(df: DataFrame, vectors: DataFrame, key: str, vector_key: str, vector: str) -> DataFrame:
    """(row_id, feature, value) from a table of precomputed embeddings, one position each."""
    joined = df.select("row_id", F.col(key).alias("k")).join(vectors.select(F.col(vector_key).alias("k"), F.col(vector).alias("v")), "k")
    return joined.select("row_id", F.posexplode("v").alias("i", "x")).select("row_id", F.concat(F.lit(f"{TEXT}emb_"), F.col("i").cast("string")).alias("feature"), F.col("x").cast("double").alias("value"))


def encode_texts(df: DataFrame, text: str, encoder: Encoder) -> DataFrame:
    """(text, vector) of the distinct texts by a user's encoder, loaded once for each partition."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for f in frames:
            yield pd.DataFrame({"text": f["text"], "vector": [[float(x) for x in v] for v in encode(f["text"].tolist())]})

    distinct = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    return distinct.mapInPandas(rows, "text string, vector array<double>")


def numeric_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and population deviation after imputation, for columns with any value.

    Medians come from narrowing intervals, so no task holds a column.  Columns without a value are
    dropped, with their names.
    """
    if not columns:
        raise ValueError("no numeric columns")
    clean = written(df.select(*[plain(c) for c in columns]))
    medians = selection.medians(clean, columns)
    held = [c for c in columns if medians[c] is not None]
    if not held:
        return {}
    stds = clean.agg(*[F.stddev_pop(F.coalesce(c, F.lit(medians[c]))).alias(c) for c in held]).first().asDict()
    return {c: (medians[c], stds[c] if stds[c] else 1.0) for c in held}


def plain(column: str):
    """A number of ``column``, null where there is none."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x).alias(column)


def scale_numeric(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with nulls imputed by the median and columns divided by their deviation (constant ones by 1)."""
    stats = numeric_statistics(df if fit_on is None else fit_on, columns)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *[(F.coalesce(plain(c), F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in stats.items()])


def numeric_features(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(row_id, feature, value) of scaled metafeatures."""
    scaled = scale_numeric(df.select("row_id", *columns), columns, fit_on)
    names = [c for c in scaled.columns if c != "row_id"]
    if not names:
        return df.select("row_id", F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(META + c).alias("feature"), F.col(c).alias("value")) for c in names]))
    return scaled.select("row_id", pairs.alias("p")).select("row_id", "p.feature", "p.value")


def numeric_vectors(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``features`` in place of scaled metafeatures, and their names by position: made inside the row, without a shuffle."""
    scaled = scale_numeric(df, columns, fit_on)
    kept = [c for c in df.columns if c not in columns]
    names = sorted(c for c in scaled.columns if c not in kept)
    if not names:
        raise ValueError("no metafeature has a value")
    return scaled.select(*kept, array_to_vector(F.array(*names)).alias("features")), [META + c for c in names]


def build_features(df: DataFrame, text_mode: str, metafeatures: list[str] | None, text: str = "flow_text", vectors: DataFrame | None = None, vector_key: str = "vec_id", fit_on: DataFrame | None = None, key: str = "flow_id", vector: str = "embedding", **options) -> DataFrame:
    """Text features and metafeatures together, as the configuration asks; fitted on all rows or ``fit_on``."""
    if text_mode not in TEXT_MODES:
        raise ValueError(f"text_mode {text_mode!r}: one of {TEXT_MODES}")
    parts = []
    if text_mode == "tfidf":
        parts.append(tfidf_features(df, text, fit_on=fit_on, **options))
    elif text_mode == "embedding":
        if vectors is None:
            raise ValueError("text_mode embedding needs vectors")
        parts.append(embedding_features(df, vectors, key, vector_key, vector))
    if metafeatures:
        parts.append(numeric_features(df, metafeatures, fit_on))
    if not parts:
        raise ValueError("no features selected")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_dictionary(features: DataFrame) -> DataFrame:
    """(feature_id, feature): text features first, then metafeatures, each by name."""
    names = features.select("feature").distinct()
    # as many rows as there are features (bounded by the vocabulary): one window numbers them
    return names.select((F.row_number().over(W.orderBy(F.col("feature").startswith(META), "feature")) - 1).alias("feature_id"), "feature")


def to_vectors(features: DataFrame, dictionary: DataFrame, size: int) -> DataFrame:
    """(row_id, features) as sparse MLlib vectors.

    The vectors' parts are written as a table, whose columns are vectors when they are read as such.
    """
    joined = features.join(F.broadcast(dictionary), "feature").where("value <> 0")
    pairs = F.sort_array(F.collect_list(F.struct("feature_id", "value")))
    part = lambda name, kind: F.transform("pairs", lambda p: p[name].cast(kind)).alias(name)
    rows = joined.groupBy("row_id").agg(pairs.alias("pairs")).select("row_id", part("feature_id", "int"), part("value", "double"))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("feature_id").alias("indices"), F.col("value").alias("values"))
    _, path = write_table(rows.select("row_id", stored.alias("features")))
    schema = T.StructType([features.schema["row_id"], T.StructField("features", VectorUDT())])
    return features.sparkSession.read.schema(schema).parquet(path)
