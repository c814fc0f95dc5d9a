import math
import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm import sharding as S

SCHEMA = "doc_id long, text string, size string, shard int"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 23, 24, 25, 100, 577, 5000])
def test_feistel_permutes(spark, n):
    got = [r.p for r in spark.range(n).select(S.feistel(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert sum(abs(a - i) for i, a in enumerate(got)) > n * n / 6  # far from the identity
        assert got != [r.p for r in spark.range(n).select(S.feistel(F.col("id"), n, seed=1).alias("p")).collect()]


def rows(spark, docs, parts):
    return [tuple(r) for r in S.shard(spark.createDataFrame(docs, SCHEMA).repartition(parts)).collect()]


def test_laws(spark):
    rng = random.Random(2)
    texts = [None, "", "é", "a" * 100_000, "same", "same"]
    docs = [(i % 900 if i % 7 else None, rng.choice(texts), "clash", 5) for i in range(1001)]
    got = rows(spark, docs, 3)
    assert Counter(g[:3] for g in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in docs)
    per = Counter(g[4] for g in got)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in range(24):
        assert sorted(g[5] for g in got if g[4] == s) == list(range(per[s]))
    assert {g[3] for g in got} == {"rows"} and {g[6] for g in got} == {None}
    assert Counter(got) == Counter(rows(spark, docs[::-1], 6))


def test_empty_and_native(spark):
    assert rows(spark, [], 1) == []
    got = S.shard(spark.createDataFrame([(1, "a", "x", 1)], SCHEMA))
    assert [f.dataType for f in got.schema][1:3] == [T.LongType(), T.LongType()]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def plain_place(number, n):
    """The permutation by plain code: the public XXH64 of (half, round, seed), chained from seed 42."""
    a = max(1, math.isqrt(n - 1) + 1)
    b = max(1, -(-n // a))

    def f(half, k):
        h = xxhash.xxh64_intdigest(struct.pack("<q", half), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", k), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", S.SEED), h)
        return h - (1 << 64) if h >> 63 else h

    while True:
        left, right = number % a, number // a
        for k in range(S.ROUNDS):
            if k % 2:
                right = (right + f(left, k)) % b
            else:
                left = (left + f(right, k)) % a
        number = left + right * a
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 30, 577, 3000])
def test_feistel_against_plain_code(spark, n):
    got = [r.p for r in spark.range(n).orderBy("id").select("id", S.feistel(F.col("id"), n).alias("p")).collect()]
    assert got == [plain_place(i, n) for i in range(n)]
