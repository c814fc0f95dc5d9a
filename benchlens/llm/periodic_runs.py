"""Periodic runs of words, found by uniting suffix classes in the order of falling LCP.

The suffixes of a document's words are sorted by prefix doubling.  Neighbours in that order are the
edges of a path whose weights are their longest common prefixes; Kruskal takes them heaviest first.
Each class of the union-find holds its positions in order.  When two classes unite at a prefix of l
words, positions i < j that only now become neighbours in position have exactly l words in common: with
p = j - i <= l the stretch from i over p + l words has period p, and no smaller one (else i + q would
lie between them).  The seed that cannot grow to the left is the run; every run has exactly one.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlens.llm.common import releasing

#: A run has this many words at least, and this many periods.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text after which a batch of results is handed back.
_BATCH_BYTES = 1 << 22


def numbered(found: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    number = {w: k for k, w in enumerate(dict.fromkeys(found))}
    return np.fromiter(map(number.__getitem__, found), np.int64, len(found))


def repeated_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that share their first words with another one, in suffix order, and each one's LCP with the next.

    "First words" are the largest power of two that is at most ``least``; no pair with ``least`` words in
    common is left out.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = sorted_ids[1:] != sorted_ids[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    active = order[~(new & np.append(new[1:], True))]
    levels, k, pool = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1, None
    while True:
        if pool is None and (2 * k > least or not len(active)):
            pool = active
        if not len(active):
            break
        # a suffix is its first k words, then the k after them; one that ends sooner comes first
        after = active + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, active = key[by], active[by]
        base = rank[active]
        at = np.arange(len(active))
        new, group = np.ones(len(active), bool), np.ones(len(active), bool)
        new[1:], group[1:] = key[1:] != key[:-1], base[1:] != base[:-1]
        rank[active] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.astype(levels[0].dtype))
        active = active[~(new & np.append(new[1:], True))]
        k *= 2
    order = pool[np.argsort(rank[pool])]
    i, j, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(len(order) - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)])
        step = same.astype(np.int64) << level
        i, j, common = i + step, j + step, common + step
    return order, common


def find_runs(ids: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words and periods (two at least), in order."""
    if least_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    # a run of period p has a prefix of max(least_length - p, (least_exponent - 1) * p) words in common with its next period
    needed = min(max(least_length - p, (least_exponent - 1) * p) for p in range(1, least_length + 2))
    if len(ids) <= needed:
        return []
    order, common = repeated_suffixes(ids, needed)
    edges = np.flatnonzero(common >= needed)
    if not len(edges):
        return []
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent = list(range(len(order)))
    held = [[p] for p in order.tolist()]
    times, seeds = least_exponent - 1, []
    for e, l in zip(edges.tolist(), common[edges].tolist(), strict=True):
        a, b = e, e + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(held[a]) < len(held[b]):
            a, b = b, a
        big, small = held[a], held[b]
        parent[b], held[b] = a, None
        before, last = -1, len(small) - 1
        for k, x in enumerate(small):
            at = bisect(big, x)
            if at and big[at - 1] > before and times * (x - big[at - 1]) <= l:
                seeds.append((big[at - 1], x, l))
            if at < len(big) and times * (big[at] - x) <= l and (k == last or big[at] < small[k + 1]):
                seeds.append((x, big[at], l))
            before = x
        if len(small) * 16 < len(big):
            for x in small:
                insort(big, x)
        else:
            big += small
            big.sort()  # two sorted stretches: linear
    if not seeds:
        return []
    i, j, l = np.array(seeds, np.int64).T
    whole = (l + j - i >= least_length) & ((i == 0) | (ids[i - 1] != ids[j - 1]))
    i, p, l = i[whole], (j - i)[whole], (l + j - i)[whole]
    by = np.lexsort((p, i))
    return list(zip(i[by].tolist(), l[by].tolist(), p[by].tolist(), strict=True))


def _later(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _rows(batches: Iterator[pa.RecordBatch], text: int, keep: list[int], schema: pa.Schema, least_length: int, least_exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, n_words, runs, collapsed, size = 0, [], [], [], 0
        for row, value in enumerate(batch.column(text)):
            data = value.as_py() or b""
            found = data.split()  # at ASCII white space
            spans = find_runs(numbered(found), least_length, least_exponent)
            n_words.append(len(found))
            runs.append([{"start": s, "length": m, "period": p} for s, m, p in spans])
            if spans:
                later = _later(spans, len(found)).tolist()
                found = [w for w, gone in zip(found, later, strict=True) if not gone]
            collapsed.append(b" ".join(found))
            size += len(data)
            if size >= _BATCH_BYTES or row == batch.num_rows - 1:
                columns = [batch.column(c).slice(done, row + 1 - done) for c in keep]
                columns += [pa.array(n_words, pa.int64()), pa.array(runs, schema.field(len(keep) + 1).type), pa.array(collapsed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                done, n_words, runs, collapsed, size = row + 1, [], [], [], 0


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period, in order) and ``collapsed`` in place of the text.

    Words are runs of anything but ASCII white space.  ``collapsed`` leaves out each word that a run holds
    after its first period and joins the rest by one space.  Null and empty texts have no words, no runs and
    an empty ``collapsed``; very long texts are searched whole; repeated rows are searched each; an empty table
    stays empty.  Other columns stay as they are, save those of the three names, which are replaced.
    """
    new = {"n_words", "runs", "collapsed"}
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").cast("binary").alias("__text"))
    pairs = narrow.select(*kept, F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit(b"").alias("collapsed"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in releasing(batches):
            fields = [batch.schema.field(c) for c in range(len(kept))]
            schema = pa.schema([*fields, ("n_words", pa.int64()), ("runs", run), ("collapsed", pa.binary())])
            yield from _rows([batch], len(kept), list(range(len(kept))), schema, least_length, least_exponent)

    return narrow.mapInArrow(rows, pairs.schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every tenth document, by the CRC-32 of its id, with its words repeated periodically from some word on.

    With h that checksum, g = floor(h / 10) and n words, the words from a = g mod n on repeat the first
    p = 1 + floor((n - a) / (3 + g mod 8)) of them.  Null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    n, g = F.size("__w").cast("bigint"), F.floor(h / 10).cast("bigint")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
    chosen = docs.withColumn("__w", F.when(F.pmod(h, F.lit(10)) == 0, found)).withColumn("__a", F.when(F.size("__w") > 0, a)).withColumn("__p", F.when(F.size("__w") > 0, p))
    place = lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__w", (F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p"))).cast("int")))
    repeated = F.array_join(F.transform("__w", place), " ")
    return chosen.withColumn(text, F.when(F.col("__p").isNotNull(), repeated).otherwise(F.col(text))).drop("__w", "__a", "__p")


def digest(found: DataFrame) -> DataFrame:
    """One row for each document: its number of runs, the one of greatest exponent, and checksums of all runs and of the rest.

    Exponents are compared exactly, as products; ties go to the smallest start, then period.
    """
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.expr("slice(runs, 2, greatest(size(runs) - 1, 0))"), F.get("runs", F.lit(0)), lambda x, y: F.when(better(y, x), y).otherwise(x))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


__all__ = ["digest", "find_runs", "numbered", "periodic_runs", "repeated_suffixes", "with_planted_runs"]
