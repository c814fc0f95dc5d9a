"""Column functions: text cleaning, tokens, feature names, labels and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words of a pipeline description.
SEPARATORS = ".()=,:"
#: Unicode's white space but the blank.
WHITE = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
META, TEXT, EMBEDDING = "meta::", "text::", "text::emb_"


def clean_text(text: Column) -> Column:
    """Separators become spaces, runs of any white space one space; trimmed and lower case; null is empty."""
    blanks = SEPARATORS + WHITE
    spaced = F.translate(F.coalesce(text, F.lit("")), blanks, " " * len(blanks))
    return F.lower(F.trim(F.regexp_replace(spaced, "  +", " ")))


def with_clean_text(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    return df.withColumn(to or f"{column}_clean", clean_text(F.col(column).cast("string")))


def tokens(text: Column) -> Column:
    """Runs of two and more letters, digits or underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def neighbours(words: Column) -> tuple[Column, Column]:
    """Left and right words of all pairs of neighbours."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n)


def terms(words: Column, bigrams: bool = True) -> Column:
    """The words, followed by all pairs of neighbours; ``words`` is evaluated once."""
    if not bigrams:
        return words
    both = lambda w: F.concat(w, F.zip_with(*neighbours(w), lambda a, b: F.concat_ws(" ", a, b)))
    return F.get(F.transform(F.array(words), both), F.lit(0))


def is_readable(feature: Column) -> Column:
    """Task metafeatures and text tokens can be read by people, embedding dimensions cannot."""
    return F.coalesce(feature.startswith(META) | (feature.startswith(TEXT) & ~feature.startswith(EMBEDDING)), F.lit(False))


def display_name(feature: Column) -> Column:
    """A feature's name without its namespace."""
    return F.regexp_replace(feature, f"^(?:{META}|{TEXT})", "")


def number(value: Column) -> Column:
    """A plain numeric literal as double; anything else (also NaN) is null.  Infinity stays a number."""
    text = F.trim(value.cast("string"))
    plain = text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    infinite = text.rlike(r"(?i)^[+-]?inf(?:inity)?$")
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(plain, text.try_cast("double")).when(infinite, sign * F.lit(float("inf")))


def mean_std(mean: Column, std: Column, decimals: int = 3) -> Column:
    return F.format_string(f"%.{decimals}f ± %.{decimals}f", mean, std)


# Display labels of configurations and models; the first hit wins.
REPRESENTATIONS = (("tfidf", "TF-IDF"), ("minilm", "MiniLM"), ("embedding", "Embedding"), ("meta", "Metafeatures"))
MODELS = (("random_forest", "Random forest"), ("extra_trees", "Extra trees"), ("hist_gbrt", "Gradient boosting"), ("ridge", "Ridge"))


def label(name: Column, known: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first key that a name holds; other names stay."""
    out = None
    for key, text in known:
        hit = F.lower(name).contains(key)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(name)


def representation_label(name: Column) -> Column:
    return label(name, REPRESENTATIONS)


def model_label(name: Column) -> Column:
    return label(name, MODELS)


def fingerprint(df: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """One row with the digest of a text column, whatever the order of its rows.

    Cleaned texts are hashed, counted, and digested by hash prefix, then over prefixes, so that no
    task holds more than one prefix's distinct hashes.
    """
    width = max(1, (buckets - 1).bit_length() // 4)
    hashed = df.select(F.md5(clean_text(F.col(column).cast("string"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    parts = hashed.groupBy(F.substring("h", 1, width).alias("prefix")).agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ",")).alias("part"))
    return parts.agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "prefix", "part"))), ",")).alias("fingerprint"))


def cache_key(prefix: str, payload: dict) -> str:
    """A name that every parameter of a computation decides."""
    text = json.dumps(payload, sort_keys=True, default=str, separators=(",", ":"))
    return f"{prefix}-{hashlib.md5(text.encode()).hexdigest()}"
