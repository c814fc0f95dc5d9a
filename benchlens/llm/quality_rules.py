"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source, then a joined filter.

Each document that passes two fixed base rules is measured.  A sketch counts the measures of a group in
log-linear buckets (values below 128 each have their own, beyond that 64 to a doubling, so a quantile
is read to 1/64 of itself).  Counts add up: sketches of partitions, of sources and of languages merge in any
order to the same sketch.  A group's cutoffs are fences around its middle quantiles; they are joined back
to the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benchlens.llm.common import free_name, releasing, written
from benchlens.llm.periodic_runs import numbered

# Fixed values of the base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

KEYS = ("lang", "source")
#: Groups with fewer measured documents use their language's sketch, and languages with fewer the whole corpus's.
LEAST_DOCUMENTS = 100
#: Fences lie so many quartile ranges (a measure's ``least range`` at least) beyond the quartiles.
FENCE = 3
#: Measure: (SQL, whether small values fail too, least range).  All are whole numbers.
MEASURES: dict[str, tuple[str, bool, int]] = {
    "word_length": ("word_chars * 100 div nullif(n_words, 0)", True, 100),
    "symbols": ("n_symbols * 10000 div nullif(n_words, 0)", False, 200),
    "duplicate_lines": ("n_dup_lines * 10000 div nullif(n_lines, 0)", False, 1500),
    "repeated_words": ("n_repeat_words * 10000 div nullif(n_words, 0)", False, 500),
    "capitals": ("n_capitals * 10000 div nullif(word_chars, 0)", False, 500),
    "marks": ("n_marks * 10000 div nullif(n_words, 0)", False, 1000),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
#: Groups up to which cutoffs are broadcast (some 100 bytes each); beyond, documents meet them by salted keys.
BROADCAST_GROUPS, SALTS = 100_000, 64

_SPACE, _CONTINUED, _CAPITALS = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)), bytes(range(0x41, 0x5B))


def _without(data: bytes, gone: bytes) -> int:
    return len(data.translate(None, gone))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of so many words that come twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code, width = ids, 1
    while 2 * width <= window:  # windows of 1, 2, 4 ... words as numbers
        code, width = np.unique(code[:-width] * np.int64(len(ids)) + code[width:], return_inverse=True)[1], 2 * width
    if width < window:
        code = code[:n] * np.int64(len(ids)) + code[window - width : window - width + n]
    _, code, count = np.unique(code[:n], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[code] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counted(data: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one text in UTF-8."""
    found = data.split()  # at ASCII white space
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(found),
        _without(data, _SPACE + _CONTINUED),
        len(data) - _without(data, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(numbered(found)) if len(found) > WINDOW else 0,
        len(lines),
        len(data) - _without(data, _CAPITALS),
        len(data) - _without(data, b"!?"),
    )


def _count_rows(batches: Iterator[pa.RecordBatch], kept: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for batch in releasing(batches):
        rows = [counted(x.as_py() or b"") for x in batch.column(len(kept))]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(kept))], pa.StructArray.from_arrays(columns, names=list(COUNTS))], names=[*kept, name])


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, name: str = "counts") -> DataFrame:
    """``keep`` (all columns by default) and a struct ``name`` of the ``COUNTS`` of each whole text (null: none)."""
    kept = list(docs.columns if keep is None else keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").cast("binary").alias("__text"))
    struct = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    schema = rows.select(*kept, F.lit(None).cast(struct).alias(name)).schema
    return rows.mapInArrow(lambda batches: _count_rows(batches, kept, name), schema)


def base_failed(counts: str = "counts") -> Column:
    """Under ten words, or over a fifth of them in repeated windows."""
    return (F.col(f"{counts}.n_words") < LEAST_WORDS) | (100 * F.col(f"{counts}.n_repeat_words") > MOST_REPEATED_PERCENT * F.col(f"{counts}.n_words"))


def sketch(rows: DataFrame, keys: tuple[str, ...] = KEYS, counts: str = "counts") -> DataFrame:
    """(keys, measure, bucket, n): log-linear counts of all documents that pass the base rules."""
    values = rows.where(~base_failed(counts)).select(*keys, F.col(f"{counts}.*"))
    values = values.select(*keys, *[F.expr(sql).alias(m) for m, (sql, _, _) in MEASURES.items()])
    long = values.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select(*keys, "x.*")
    bucket = F.expr("case when v < 128 then v else shiftleft(shiftright(v, length(bin(v)) - 7), length(bin(v)) - 7) end")
    return long.groupBy(*keys, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The sketch of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, measure, total, low, high): the buckets that hold the first and the third quartile.

    A window holds the buckets of one group and measure: some thousand at most, whatever its documents.
    """
    group = W.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(1).alias("low"), at(3).alias("high"))


def cutoffs(sketches: DataFrame, keys: tuple[str, ...] = KEYS, least_documents: int = LEAST_DOCUMENTS, fence: int = FENCE) -> DataFrame:
    """One row for each group: keys, and for each measure its least and most allowed value.

    The sketch behind them is that of the longest prefix of the keys with documents enough.
    """
    least_range = F.create_map(*[F.lit(x) for m, (_, _, least) in MEASURES.items() for x in (m, least)])
    two_sided = F.col("measure").isin([m for m, (_, both, _) in MEASURES.items() if both])
    reach = fence * F.greatest(F.col("high") - F.col("low"), least_range[F.col("measure")].cast("bigint"))
    found = sketches.select(*keys, "measure").distinct()
    depths = range(len(keys), -1, -1)
    for k in depths:
        level = quartiles(merge(sketches, keys[:k]), keys[:k])
        if k:
            level = level.where(F.col("total") >= least_documents)
        level = level.select(*[F.col(c).alias(f"__{c}") for c in keys[:k]], F.col("measure").alias("__m"), F.struct("low", "high").alias(f"__level{k}"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys[:k]], F.col("measure") == F.col("__m"))
        found = found.join(level, same, "left").drop("__m", *[f"__{c}" for c in keys[:k]])
    found = found.select(*keys, "measure", F.coalesce(*[F.col(f"__level{k}") for k in depths]).alias("q")).select(*keys, "measure", "q.*")
    bounds = F.struct(F.when(two_sided, F.col("low") - reach).alias("least"), (F.col("high") + reach).alias("most"))
    return found.groupBy(*keys).pivot("measure", list(MEASURES)).agg(F.first(bounds))


def judged(rows: DataFrame, bounds: DataFrame, keys: tuple[str, ...] = KEYS, counts: str = "counts", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` with ``base_failed``, ``failed`` (names of the adaptive rules it breaks) and ``kept``.

    Cutoffs are broadcast where their number of groups, which is asked, allows it; beyond, a group's
    documents are dealt over ``SALTS`` keys, each of which has the group's cutoffs.
    """
    other = bounds.select(*[F.col(c).alias(f"__{c}") for c in keys], F.struct(*MEASURES).alias("__bounds"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    if bounds.limit(broadcast_groups + 1).count() <= broadcast_groups:
        joined = rows.join(F.broadcast(other), reduce(lambda x, y: x & y, same), "left")
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.lit(SALTS)).cast("int"))
        other = other.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(other, reduce(lambda x, y: x & y, same, F.col("__salt") == F.col("__s")), "left").drop("__salt", "__s")
    joined = joined.withColumn("base_failed", base_failed(counts))
    out = []
    for m, (sql, _, _) in MEASURES.items():
        v = F.expr(re.sub(rf"\b({'|'.join(COUNTS)})\b", rf"`{counts}`.\1", sql))
        broken = (v > F.col(f"__bounds.{m}.most")) | F.coalesce(v < F.col(f"__bounds.{m}.least"), F.lit(False))
        out.append(F.when(~F.col("base_failed") & broken, F.lit(m)))
    failed = F.concat_ws(",", *out)
    done = joined.withColumn("failed", failed).drop("__bounds", *[f"__{c}" for c in keys])
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document: key, counts, ``base_failed``, ``kept`` and ``failed``.

    Null and empty texts have no words and fail the base rules; very long texts are counted whole; repeated
    rows are judged each; null languages and sources are groups of their own; ties share a bucket and so a
    verdict; an empty table gives no rows.  Columns beside key, text, lang and source are not read.
    """
    rows = written(measured(docs.select(key, *KEYS, "text"), keep=(key, *KEYS)))
    bounds = written(cutoffs(written(sketch(rows))))
    done = judged(rows, bounds)
    return done.select(key, *[F.col(f"counts.{c}") for c in COUNTS[:5]], "base_failed", "kept", "failed", *[F.col(f"counts.{c}") for c in COUNTS[5:]])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass base rules and adaptive cutoffs, with all their columns, whatever the names."""
    name = free_name(docs, "counts")
    lang, source = free_name(docs, "__lang"), free_name(docs, "__source")
    rows = written(measured(docs.withColumn(lang, F.col("lang").cast("string")).withColumn(source, F.col("source").cast("string")), name=name))
    keys = (lang, source)
    bounds = written(cutoffs(written(sketch(rows, keys, name)), keys))
    flags = rows.select(F.struct(*docs.columns).alias("row"), lang, source, name)
    return judged(flags, bounds, keys, name).where("kept").select("row.*")


__all__ = ["cutoffs", "judge", "judged", "kept_documents", "measured", "merge", "quartiles", "repeated_words", "sketch"]
