"""Benchmark decontamination with one FM-index per training shard.

A task cuts its documents into shards of bounded size.  Words become symbols of the benchmark's
vocabulary; a word that no benchmark item has becomes a separator, since no window can hold it, and
so does each border of two documents.  Each shard gets a suffix array (prefix doubling), its
Burrows-Wheeler transform in a wavelet matrix, and every s-th suffix position.  Windows with two
neighbouring words that are never neighbours in the shard are left out; all others are searched
backward at once by wavelet ranks; occurrences are located by walking to a sampled position;
overlapping occurrences merge into removal spans.

No row is shuffled: the index of a shard lives in the task that reads the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.common import Tables, free_name, mix, releasing, slices, utf8, words, written

WINDOW = 10
#: Bytes of a training shard, whose documents share one index (a longer document is a shard alone).
SHARD_BYTES = 1 << 20
#: Bytes of benchmark words (8 each) in one broadcast; more go in further passes over the documents.
BLOCK_BYTES = 32 << 20
#: First words of the windows in one row of the packed benchmark.
SEGMENT = 1 << 14
#: Places of the bitmap in which a shard marks its pairs of neighbouring words.
PAIR_SLOTS = 1 << 21
#: Passes that run in one task chain before the result is written to the shared folder.
CHAIN = 3
#: Windows that are searched at once.
SEARCH_BLOCK = 1 << 16


class FMIndex:
    """Backward search and location over an integer text with symbols 1..sigma-1 (0 ends it)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        order = self._suffix_array(text)
        self.n, self.sigma, self.sample = n, sigma, sample
        bwt = text[order - 1]
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.levels = []
        self.zeros = []
        rest = bwt
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (rest >> bit) & 1
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ranks[1:])
            self.levels.append((bit, ranks))
            self.zeros.append(n - int(ranks[-1]))
            rest = np.concatenate([rest[one == 0], rest[one == 1]])
        kept = order % sample == 0
        self.sampled = kept
        self.sample_rank = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.sample_rank[1:])
        self.positions = order[kept]

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64)
        width = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.zeros(n, np.int64)
            fresh[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            width *= 2
            if fresh.sum() == n - 1 or width >= n:
                return order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, high = np.zeros_like(at), at.copy()
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> bit) & 1).astype(bool)
            low1, high1 = ones[low], ones[high]
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place of the transform, and its rank there."""
        symbol, place, start = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            one = ones[place + 1] > ones[place]
            symbol |= one.astype(np.int64) << bit
            place = np.where(one, zeros + ones[place], place - ones[place])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return symbol, place - start

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all windows; ``windows`` is padded at its left side."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for step in range(windows.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = windows[live, windows.shape[1] - 1 - step]
            base = self.first[symbol]
            low[live], high[live] = base + self.rank(symbol, low[live]), base + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        rows, out = rows.copy(), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        steps = 0
        while len(live):
            hit = self.sampled[rows[live]]
            done = live[hit]
            out[done] = self.positions[self.sample_rank[rows[done]]] + steps
            live = live[~hit]
            symbol, before = self.access(rows[live])
            rows[live] = self.first[symbol] + before
            steps += 1
        return out % self.n


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (item id, text) -> (item id, 8 bytes for each of up to SEGMENT + window - 1 words).

    Neighbouring segments share ``window - 1`` words, so that each window lies in one segment whole.
    """
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        rows, parts = [], []
        for a, b in slices(offsets):
            hashes, _, _, row = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                own = hashes[bounds[k] : bounds[k + 1]]
                for at in range(0, max(1, len(own) - window + 1), SEGMENT):
                    rows.append(a + k)
                    parts.append(own[at : at + SEGMENT + window - 1].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.binary())], names=["i", "words"])


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bitmap place of each pair of neighbouring symbols."""
    return ((left.astype(np.int64) * 0x9E3779B1 + right.astype(np.int64) * 0x85EBCA77) >> 7 & (PAIR_SLOTS - 1)).astype(np.int32)


def _windows(segments: Iterator[tuple[str, bytes]], window: int) -> dict:
    """Distinct windows of a block as places in its packed symbols, and which items have each."""
    number: dict[str, int] = {}
    owners, parts = [], []
    for item, data in segments:
        owners.append(number.setdefault(item, len(number)))
        parts.append(np.frombuffer(data, np.uint64))
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
    sizes = np.array([len(p) for p in parts], np.int64)
    del parts
    vocabulary, symbols = np.unique(flat, return_inverse=True)
    symbols = (symbols + 2).astype(np.int32)  # 0 ends a text, 1 separates
    count = np.maximum(sizes - window + 1, np.minimum(sizes, 1))
    length = np.repeat(np.minimum(sizes, window), count)
    first = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = length.astype(np.uint64)
    for k in range(window):
        word = mix(flat[np.minimum(first + k, max(0, len(flat) - 1))] + np.uint64(k + 1))
        key = np.where(k < length, mix(key ^ word), key)
    del flat
    _, kept, same = np.unique(key, return_index=True, return_inverse=True)
    del key
    pairs = np.unique(same * max(1, len(number)) + np.repeat(np.array(owners, np.int64), count))
    return {
        "vocabulary": vocabulary,
        "symbols": symbols,
        "slots": _slots(symbols[:-1], symbols[1:]),
        "first": first[kept].astype(np.int32),
        "lengths": length[kept].astype(np.int32),
        "window": window,
        "owner_at": np.searchsorted(pairs // max(1, len(number)), np.arange(len(kept) + 1)).astype(np.int32),
        "owner": (pairs % max(1, len(number))).astype(np.int32),
        "names": list(number),
    }


def _possible(block: dict, text: np.ndarray) -> np.ndarray:
    """The windows whose neighbouring words all are neighbours somewhere in the shard; the rest cannot occur."""
    bitmap = np.zeros(PAIR_SLOTS, bool)
    both = (text[:-1] > 1) & (text[1:] > 1)
    bitmap[_slots(text[:-1][both], text[1:][both])] = True
    missing = np.zeros(len(block["symbols"]) + 1, np.int32)
    np.cumsum(~bitmap[block["slots"]], out=missing[1 : len(block["slots"]) + 1])
    first, length = block["first"], block["lengths"]
    word = np.zeros(len(block["vocabulary"]) + 2, bool)
    word[text] = True
    return np.flatnonzero((missing[first + length - 1] == missing[first]) & word[block["symbols"][first]])


def _occurrences(raw: np.ndarray, offsets: np.ndarray, block: dict) -> tuple[np.ndarray, ...]:
    """Of one shard: (row, first word, words, window) of every occurrence, then what ``words`` gives."""
    hashes, starts, sizes, row = words(raw, offsets)
    none = np.zeros(0, np.int64)
    found = (none, none, none)
    vocabulary, lengths = block["vocabulary"], block["lengths"]
    if len(hashes) and len(lengths):
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[place] == hashes
        # A run of known words of one text that is shorter than the shortest window can hold none.
        edge = np.ones(len(hashes) + 1, bool)
        edge[1:-1] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
        bounds = np.flatnonzero(edge)
        size = np.diff(bounds)
        keep = known & np.repeat(size >= lengths.min(), size)
        kept = np.flatnonzero(keep)
        if len(kept):
            gap = np.zeros(len(kept), np.int64)
            gap[1:] = (np.diff(kept) > 1) | (row[kept[1:]] != row[kept[:-1]])
            at = np.arange(len(kept)) + np.cumsum(gap)
            text = np.ones(at[-1] + 1, np.int64)
            text[at] = place[kept] + 2
            origin = np.full(len(text), -1, np.int64)
            origin[at] = kept
            index = FMIndex(text, len(vocabulary) + 2)
            hits = [(none, none)]
            likely, width = _possible(block, text), block["window"]
            for a in range(0, len(likely), SEARCH_BLOCK):
                own = likely[a : a + SEARCH_BLOCK]
                size = lengths[own].astype(np.int64)
                at = block["first"][own][:, None] + size[:, None] - width + np.arange(width)  # right-aligned
                low, high = index.search(block["symbols"][np.maximum(at, 0)].astype(np.int64), size)
                n = np.maximum(high - low, 0)
                which = np.repeat(np.arange(len(n)), n)
                suffix = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                hits.append((origin[index.locate(suffix)], own[which]))
            first = np.concatenate([h[0] for h in hits])
            window = np.concatenate([h[1] for h in hits])
            found = (first, lengths[window].astype(np.int64), window)
    return (*found, starts, sizes, row)


_SPAN = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("first_byte", T.LongType()), T.StructField("n_bytes", T.LongType())]))


def _scan(batches: Iterator[pa.RecordBatch], block: dict, text: int, names: list[str], earlier: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column(text))
        counts, spans, items = [], [], []
        for a, b in slices(offsets, SHARD_BYTES):
            shard, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            first, size, window, starts, sizes, row = _occurrences(shard, at, block)
            per_row = np.bincount(row, minlength=b - a)
            begins = np.concatenate([[0], np.cumsum(per_row)])
            counts += per_row.tolist()
            own = {}
            for r, f, s, w in zip(row[first].tolist(), first.tolist(), size.tolist(), window.tolist(), strict=True):
                own.setdefault(r, []).append((f, s, w))
            for r in range(b - a):
                spans.append(_merge([(f, f + s) for f, s, _ in own.get(r, ())], starts, sizes, int(begins[r]), int(at[r])))
                items.append(sorted({block["names"][i] for _, _, w in own.get(r, ()) for i in block["owner"][block["owner_at"][w] : block["owner_at"][w + 1]].tolist()}))
        columns = list(batch.columns)
        if earlier:  # add what former passes found
            past_spans, past_items = columns[-2].to_pylist(), columns[-1].to_pylist()
            columns = columns[:-3]
            spans = [_union(x, y) for x, y in zip(past_spans, spans, strict=True)]
            items = [sorted({*x, *y}) for x, y in zip(past_items, items, strict=True)]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "n_words", "first_byte", "n_bytes")]))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=names)


def _merge(spans: list[tuple[int, int]], starts: np.ndarray, sizes: np.ndarray, base: int, byte: int) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first_word": a - base, "n_words": b - a, "first_byte": int(starts[a]) - byte, "n_bytes": int(starts[b - 1] + sizes[b - 1] - starts[a])} for a, b in out]


def _union(x: list[dict], y: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*x, *y], key=lambda s: s["first_word"]):
        if out and s["first_word"] <= out[-1]["first_word"] + out[-1]["n_words"]:
            last = out[-1]
            end = max(last["first_byte"] + last["n_bytes"], s["first_byte"] + s["n_bytes"])
            last["n_words"] = max(last["first_word"] + last["n_words"], s["first_word"] + s["n_words"]) - last["first_word"]
            last["n_bytes"] = end - last["first_byte"]
        else:
            out.append(dict(s))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged, in words and UTF-8 bytes) and ``item_ids`` added.

    Null text has no words, no spans and no items; neither has an empty document.  Null or empty
    items have no window; items with equal ids count once; null ids read ``null``.  Rows are handled
    one by one, so repeated rows give equal results.  A very long document is a shard of its own, a
    very long item many segments.  Empty documents give no rows, an empty benchmark no hits.  Columns
    of ``docs`` with one of the added names are replaced.

    The benchmark's words are packed by Spark; ``block_bytes`` of them at most (or one segment) are
    broadcast at once, further blocks are further passes over the documents, and no block is left out.
    """
    spark = docs.sparkSession
    added = ("n_words", "spans", "item_ids")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t"))
    tables = Tables(spark)
    packed = tables.write("segments", items.distinct().mapInArrow(lambda batches: releasing(_segments(batches, window)), "i string, words binary").distinct())
    total = packed.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    out, at, past = docs, docs.columns.index(text), []
    for k in range(n_blocks):
        own = packed if n_blocks == 1 else packed.where(F.pmod(F.xxhash64("i", "words"), F.lit(n_blocks)) == k)
        block = spark.sparkContext.broadcast(_windows(own.toLocalIterator(), window))
        past.append(block)
        names = [f.name for f in schema]
        scan = lambda batches, block=block, earlier=k > 0: _scan(batches, block.value, at, names, earlier)
        if cut and k == n_blocks - 1:
            out = out.mapInArrow(lambda batches, scan=scan: releasing(_cut(scan(batches), at, len(names) - 2)), schema)
        else:
            out = out.mapInArrow(lambda batches, scan=scan: releasing(scan(batches)), schema)
        if k % CHAIN == CHAIN - 1 and k < n_blocks - 1:
            out = written(out)
            while past:  # their passes are over
                past.pop().destroy()
    tables.remove("segments")  # all blocks are broadcast
    return out


def _cut(batches: Iterator[pa.RecordBatch], at: int, spans: int) -> Iterator[pa.RecordBatch]:
    """Texts without their spans."""
    for batch in batches:
        texts, cuts = batch.column(at), batch.column(spans)
        if len(cuts.values if not cuts.offset else cuts.flatten()):
            parts = []
            for a in range(0, batch.num_rows, 500):
                new, own = texts.slice(a, 500), cuts.slice(a, 500)
                if len(own.flatten()):
                    new = pa.array([_without(t, c) for t, c in zip(new.to_pylist(), own.to_pylist(), strict=True)], texts.type)
                parts.append(new)
            texts = pa.concat_arrays(parts)
        columns = list(batch.columns)
        columns[at] = texts
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _without(text: str | None, spans: list[dict]) -> str | None:
    if text is None or not spans:
        return text
    raw, parts, end = text.encode(), [], 0
    for s in spans:
        parts.append(raw[end : s["first_byte"]])
        end = s["first_byte"] + s["n_bytes"]
    return b"".join([*parts, raw[end:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the spans that ``find_contamination`` finds cut out of the texts; all else stays.

    Documents without a span keep their text untouched; null stays null.  Columns of ``docs``, those
    with the names that ``find_contamination`` adds too, are returned as they were.  The last pass
    over the benchmark cuts too.
    """
    added = ("n_words", "spans", "item_ids")
    held = {c: free_name(docs, f"{c}_kept") for c in docs.columns if c.lower() in added}
    cut = find_contamination(docs.withColumnsRenamed(held), benchmark, held.get(text, text), window, block_bytes, cut=True)
    return cut.drop(*added).withColumnsRenamed({new: old for old, new in held.items()})


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the query, derived from ``find_contamination``."""
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (s, x) -> s + x.n_words)").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


__all__ = ["FMIndex", "digest", "find_contamination", "remove_contamination"]
