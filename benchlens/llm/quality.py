"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent semantic space.

The terms of a text are hashed words, byte-class trigrams (which see case, digits, punctuation and
markup) and one term for how often words come again within a few places.  Term weights and a truncated SVD are fitted on a bounded sample of labelled rows; the
sample's latent vectors are broadcast.  Every document is then compared with all of them by exact
cosine products, a block of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlens.llm.common import releasing, slices, utf8, words

#: Labelled rows of each class that the model may hold (the documented bound of the fit).
SAMPLE_PER_CLASS = 1024
RANK = 64
NEIGHBOURS = 31
WORD_TERMS = SHAPE_TERMS = 4096
#: Least shares of words that equal one of the few words before them, by repetition term.
REPEATED, LAGS = (0.0, 0.02, 0.1, 0.25, 0.5), 4
TERMS = WORD_TERMS + SHAPE_TERMS + len(REPEATED)
#: Similarities are raised to this power in a vote.
SHARPNESS = 4
_DOCS_AT_ONCE = 128


def _classes() -> np.ndarray:
    """Each byte's class, 0 to 15: letters by case, digits, spaces, line ends, bytes from 0x80, punctuation."""
    c = np.zeros(256, np.int64)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 1, 2, 3
    c[0x80:] = 4
    c[ord(" ")], c[ord("\n")] = 5, 6
    for k, chars in enumerate((".", ",;:", "!", "?", "*#$%&", "|", "<>/\\", "'\"`", "()[]{}")):
        for x in chars:
            c[ord(x)] = 7 + k
    return c


_CLASS = _classes()


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts x terms) of hashed words and byte-class trigrams of whole texts."""
    n = len(offsets) - 1
    hashes, _, _, row = words(raw, offsets)
    out = np.zeros((n, TERMS), np.float32)
    out[:, :WORD_TERMS] = np.bincount(row * WORD_TERMS + (hashes % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, -1)
    if len(raw) > 2:
        c = _CLASS[raw]
        code = (c[:-2] << 8) | (c[1:-1] << 4) | c[2:]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        own = owner[:-2] == owner[2:]
        out[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount(owner[:-2][own] * SHAPE_TERMS + code[own], minlength=n * SHAPE_TERMS).reshape(n, -1)
    size = np.bincount(row, minlength=n)
    again = np.zeros(n)
    for lag in range(1, LAGS + 1):
        same = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
        again = np.maximum(again, np.bincount(row[lag:][same], minlength=n))
    spoken = np.flatnonzero(size > LAGS)
    out[spoken, WORD_TERMS + SHAPE_TERMS + np.searchsorted(REPEATED, again[spoken] / size[spoken], "right") - 1] = 1
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = utf8(column)
    for a, b in slices(offsets):
        for c in range(a, b, _DOCS_AT_ONCE):
            d = min(b, c + _DOCS_AT_ONCE)
            yield raw[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term weights; words, shapes and repetition each have length 1, or 0 if there is none."""
    x = np.log1p(counts) * idf
    for part in (x[:, :WORD_TERMS], x[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS], x[:, WORD_TERMS + SHAPE_TERMS :]):
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-12)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = [], []
        for raw, offsets in _pieces(batch.column(1)):
            for row in term_counts(raw, offsets):
                at = np.flatnonzero(row)
                terms.append(at.astype(np.uint16).tobytes())
                counts.append(row[at].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["label", "terms", "counts"])


def _fit(rows: list, rank: int) -> dict:
    """Term weights, projection and unit vectors of the sample, by a randomised SVD with a fixed seed."""
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.terms, np.uint16)] = np.frombuffer(r.counts, np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = _weighted(x, idf)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, len(rows)))).astype(np.float32)
    for _ in range(4):
        left, _ = np.linalg.qr(x @ basis)
        basis, _ = np.linalg.qr(x.T @ left)
    _, _, small = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ small.T)[:, :rank].astype(np.float32)
    return {"idf": idf, "projection": projection, "vectors": _unit(x @ projection), "labels": np.array([r.label for r in rows], np.float32)}


def vote(vectors: np.ndarray, model: dict, neighbours: int) -> np.ndarray:
    """Scores by the nearest labelled vectors; all that tie with the last of them vote too."""
    prior = float(model["labels"].mean())
    similar = np.maximum(vectors @ model["vectors"].T, 0)
    k = min(neighbours, similar.shape[1])
    least = np.partition(similar, similar.shape[1] - k, axis=1)[:, -k][:, None]
    weight = np.where(similar >= least, similar, 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 0, (weight @ model["labels"]) / np.where(total > 0, total, 1), prior)


def _score(batches: Iterator[pa.RecordBatch], model: dict | None, text: int, names: list[str], neighbours: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [np.zeros(0)]
        for raw, offsets in _pieces(batch.column(text)):
            if model is None:
                scores.append(np.full(len(offsets) - 1, 0.5))
            else:
                scores.append(vote(_unit(_weighted(term_counts(raw, offsets), model["idf"]) @ model["projection"]), model, neighbours))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(np.concatenate(scores), 0, 1))], names=names)


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3 (null: not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, rank: int = RANK) -> dict | None:
    """The model, from ``per_class`` rows at most of each label, chosen by a hash of their ids.

    Null ids and labels teach nothing; several labels of one document count as their majority (a draw
    as 1); of several texts of one id the one with the least hash teaches.  None where no labelled document is there.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out()).join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # whatever the order of the rows
    rows = one.orderBy("doc_id").select("label", "text").mapInArrow(_term_rows, "label int, terms binary, counts binary").collect()
    return _fit(rows, rank) if rows else None


def score(docs: DataFrame, model: dict | None, neighbours: int = NEIGHBOURS, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1; one of that name is replaced), from the text alone.

    A text without any term (null, empty) gets the labels' mean in the sample.  Without a model
    all scores are 0.5.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class, rank and the number of terms
    at, names = docs.columns.index("text"), [*docs.columns, name]
    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(lambda batches: releasing(_score(batches, held.value, at, names, neighbours)), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Texts without any term (null, empty) get the labels' mean in the sample; very long texts are scored
    whole.  Of several texts of one id all are scored and the one with the least hash may teach.  Neighbours that tie with the last one vote too.  Repeated rows are scored each; null ids are
    not held out.  Without labels all scores are 0.5; an empty table gives no rows.  Columns beside
    doc_id and text, whatever their names, are not read.
    """
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


__all__ = ["classify", "fit", "held_out", "score", "vote"]
