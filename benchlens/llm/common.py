"""Small helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task turns into NumPy arrays at once (a longer text is taken alone).
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only where the session names none and runs in one process (tests, a local shell) is a temporary
    one set; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="benchlens-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return f"{root.rstrip('/')}/benchlens-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate Parquet tables of one operator; each can be removed once its successors are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self, *names: str) -> None:
        """Only tables that no frame still to be computed reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (a, b) of at most ``most`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def releasing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what a batch no longer needs goes back to the system, as workers stay alive.

    Spark keeps Python workers between stages, and an allocator would keep their freed memory too.
    """
    for batch in rows:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the public splitmix64 steps) on uint64 arrays."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A word is a run of digits, ASCII letters (lower-cased) and bytes from 0x80 on.
_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE)
IS_WORD = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)
_BYTE_KEY = np.where(IS_WORD, mix(_LOWER.astype(np.uint64)), 0).astype(np.uint64)
_PLACE_KEY = mix(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first bytes, byte lengths and texts (row numbers) of all words, in order.

    Words never reach over the border of two texts.  The hash sums a key of each byte times a key
    of its place, so equal words, and for all practical purposes only these, hash alike.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = IS_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = offsets[1:-1]
    border = border[border < len(raw)]
    first[border] = inside[border]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    span = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, span)
    keys = _PLACE_KEY[place] if place.max() < 256 else mix((place + 1000).astype(np.uint64)) | np.uint64(1)
    keys *= _BYTE_KEY[raw[starts[0] :]]
    hashes = mix(np.add.reduceat(keys, starts - starts[0]))
    lengths = np.add.reduceat(inside[starts[0] :], starts - starts[0], dtype=np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    return hashes, starts, lengths, row
