"""Shuffled shards by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows are numbered 0..N-1 in a fixed order that does not depend on partitions: by a hash bucket, then
by id, checksum and size.  A mixed-radix Feistel network permutes a domain of a * b >= N numbers with
a = ceil(sqrt N); numbers that leave 0..N-1 walk on along their cycle.  Place p of the shuffle lies in
shard ``p mod shards``, slot ``p div shards``, so shard counts differ by one at most and slots have
no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from benchlens.llm.common import written

SHARDS = 24
ROUNDS = 8
SEED = 20260101
#: Buckets of the numbering; each is sorted on its own, and only their counts meet in one place.
BUCKETS = 4096
#: Steps along a cycle.  At most ceil(sqrt N) numbers lie outside, so for N <= 576 this is a proven
#: bound; for larger N a longer walk has a chance below N**-11, and would fail loudly, not wrongly.
WALK = 24


def feistel(number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of ``number`` (0..n-1) in a keyed permutation of 0..n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def step(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        return F.when(
            k % 2 == 0, F.struct(F.pmod(left + F.pmod(F.xxhash64(right, k, F.lit(seed)), F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, k, F.lit(seed)), F.lit(b)), F.lit(b)).alias("r")))

    def once(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), F.call_function("div", x, F.lit(a)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] + s["r"] * a)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"), lambda x, k: F.when(k == 1, once(number.cast("long"))).when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk is longer than its bound")).cast("long"))


def numbered(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``row_number`` 0..N-1 in an order that only the values of ``keys`` decide."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    # at most ``buckets`` rows: one window and a broadcast of a proven size
    offsets = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("offset"))
    inside = F.row_number().over(W.partitionBy("bucket").orderBy(*keys)) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(offsets), "bucket").withColumn("row_number", F.col("offset") + F.col("inside")).drop("bucket", "inside", "offset")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row's size, checksum, shard and slot under the law ``rows``.

    Null text has size 8 and the checksum of no bytes; very long texts are measured whole.  Null ids come first in their bucket.  Rows with
    equal id, checksum and size are interchangeable: each gets its own slot, and the result as a whole
    is the same on any partitioning.  An empty table gives no rows; further columns are not read.
    """
    text = F.col("text").cast("string")
    bare = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    bare = written(bare)  # a few bytes a row: texts are read once
    n = bare.count()
    place = numbered(bare, ["doc_id", "text_crc32", "size"]).withColumn("place", feistel(F.col("row_number"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {int(shards)}").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
