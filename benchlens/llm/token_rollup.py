"""Token counts as delta-maintained rollups.

Changes are signed rows: an insert adds a document's count, a delete takes it away, a revision does
both.  A batch of changes is summed by source, language and tokenizer version and committed under its
id; the sums are additive, so totals are the sum over committed batches.  A commit is idempotent: a
batch is written beside and gets its name whole, a second commit of its id changes nothing, and what a
failed attempt left goes.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.llm.common import shared_dir, slices, utf8, written
from benchlens.sources.results import publish

FOLDER = "/opt/tokenizers"
#: Tokenizer versions: rank files of public byte-level encodings.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
KEYS = ["source", "lang", "version"]
CHANGES = "source string, lang string, version string, docs long, tokens long"
# Fixed value: the public word pattern of these encodings.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=8)
def encoding(version: str, folder: str = FOLDER):
    import tiktoken

    with open(f"{folder}/{version}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tidy(text: str) -> str:
    """Runs of spaces and tabs become one space; lines lose trailing space."""
    return re.sub(r"[ \t]+(?=\n|\Z)", "", re.sub(r"[ \t]{2,}|\t", " ", text))


def _count(batches: Iterator[pa.RecordBatch], text: int, versions: tuple[str, ...], folder: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    made = [encoding(v, folder) for v in versions]
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        for a, b in slices(offsets):
            part = batch.slice(a, b - a)
            texts = [t or "" for t in part.column(text).to_pylist()]
            new = [tidy(t) for t in texts]
            changed = [i for i, (t, n) in enumerate(zip(texts, new, strict=True)) if t != n]
            columns = []
            for e in made:
                counts = [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
                revised = counts.copy()
                for i, x in zip(changed, e.encode_ordinary_batch([new[i] for i in changed], num_threads=1), strict=True):
                    revised[i] = len(x)
                columns += [pa.array(counts, pa.int64()), pa.array(revised, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(part.columns) if k != text], *columns], names=names)


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, lang, digest) with ``n_<version>`` tokens and ``r_<version>`` after tidying."""
    text = F.col("text").cast("string")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    names = ["doc_id", "source", "lang", "digest", *[f"{k}_{v}" for v in versions for k in "nr"]]
    schema = "doc_id long, source string, lang string, digest string" + "".join(f", {n} long" for n in names[4:])
    return bare.mapInArrow(lambda batches: _count(batches, 4, versions, folder, names), schema)


def change(rows: DataFrame, version: str, tokens: Column, sign: int, docs: int = 1) -> DataFrame:
    """Signed rows of CHANGES: sign * tokens, and sign * docs documents."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign * docs).cast("long").alias("docs"), (sign * tokens).cast("long").alias("tokens"))


def revision(rows: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Revised counts: the old one leaves, the new one comes; unchanged rows give nothing."""
    rows = rows.where(~old.eqNullSafe(new))
    return change(rows, version, old, -1).unionByName(change(rows, version, new, 1))


class Rollup:
    """Totals in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def is_committed(self, batch: str) -> bool:
        fs, mark = self._files(f"{self.path}/batch-{batch}/_SUCCESS")
        return fs.exists(mark)

    def _publish(self, beside: str, at: str, mark: str) -> bool:
        """Name a finished folder; what has the name without its mark is left of a failure and goes first."""
        fs, path = self._files(at)
        if fs.exists(path) and not fs.exists(self._files(f"{at}/{mark}")[1]):
            fs.delete(path, True)
        return publish(self.spark, beside, at)

    def committed(self) -> list[str]:
        fs, top = self._files(self.path)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n for n in names if n.startswith("batch-") and fs.exists(self._files(f"{self.path}/{n}/_SUCCESS")[1]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sum and store a batch of CHANGES; False where its id is committed already.

        The sums are written beside and published by a rename that refuses an existing batch: of several
        writers of one id one commits, and no committed total is ever replaced.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id {batch!r}")
        if self.is_committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        beside = f"{self.path}/.making-{uuid.uuid4().hex}"
        sums.write.parquet(beside)
        return self._publish(beside, f"{self.path}/batch-{batch}", "_SUCCESS")

    def _base(self) -> tuple[str | None, set[str]]:
        """The folder of the latest complete base, and the batches that it holds (a row a commit)."""
        fs, top = self._files(self.path)
        names = sorted((s.getPath().getName() for s in fs.listStatus(top)), reverse=True) if fs.exists(top) else []
        for name in names:
            if name.startswith("base-") and fs.exists(self._files(f"{self.path}/{name}/ids/_SUCCESS")[1]):
                return name, {r.id for r in self.spark.read.schema("id string").parquet(f"{self.path}/{name}/ids").collect()}
        return None, set()

    def _sums(self, names: list[str]) -> DataFrame:
        base, held = self._base()
        paths = [f"{self.path}/{n}" for n in names if n not in held] + ([f"{self.path}/{base}/sums"] if base else [])
        rows = self.spark.read.schema(CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> None:
        """Sum all committed batches into a base, so that totals read it and later batches alone.

        Batches are listed once, so one that is committed meanwhile is in neither list nor sums and counts as
        a later one.  A base is published whole, so one that failed counts for nothing; the batches' marks
        stay, so a replay of theirs still changes nothing.
        """
        base, names = self._base()[0], self.committed()
        beside = f"{self.path}/.making-{uuid.uuid4().hex}"
        self._sums(names).write.parquet(f"{beside}/sums")
        self.spark.createDataFrame([(n,) for n in names], "id string").coalesce(1).write.parquet(f"{beside}/ids")
        self._publish(beside, f"{self.path}/base-{int(base[5:]) + 1 if base else 1:08d}", "ids/_SUCCESS")

    def totals(self) -> DataFrame:
        """Additive totals by KEYS over all committed batches; groups without documents and tokens go."""
        return self._sums(self.committed()).select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def roll_up(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = FOLDER) -> DataFrame:
    """Totals of a corpus through four batches and a replay: inserts for each tokenizer version,
    revised counts after tidying white space, and deletes of exact copies.

    Of documents with equal texts that with the least id stays (of rows with this same id, all).
    Null text counts as a document of no tokens and is nobody's copy; rows without id are never
    deleted; null sources and languages are groups of their own.  An empty text has no tokens; a very
    long one is counted whole; repeated rows count each.  An empty table gives no totals.  Columns
    beside doc_id, source, lang and text, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = written(counted(docs, versions, folder))
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup")
    inserts = {v: change(rows, v, F.col(f"n_{v}"), 1) for v in versions}
    for v, batch in inserts.items():
        rollup.commit(f"insert-{v}", batch)
    revised = [revision(rows, v, F.col(f"n_{v}"), F.col(f"r_{v}")) for v in versions]
    rollup.commit("tidy", _union(revised))
    first = written(rows.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1"))
    copies = rows.join(first, "digest").where("doc_id <> kept")
    rollup.commit("copies", _union([change(copies, v, F.col(f"r_{v}"), -1) for v in versions]))
    rollup.commit(f"insert-{versions[0]}", inserts[versions[0]])  # a replay, which changes nothing
    return rollup.totals()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
