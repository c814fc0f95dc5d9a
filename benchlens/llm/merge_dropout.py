"""SentencePiece BPE with seeded merge-dropout, and its lossless inverse.

Symbols of a text merge by an agenda: the candidate of the best piece goes first, the leftmost one
among equals.  A candidate is one pair of symbols at one place of one text; a hash keyed by seed,
document and place decides once whether it is skipped.  The same seed gives the same segmentation on
any partitioning, another seed another one, and dropout 0 gives the model's own encoding.

No piece of the vocabulary spans a change from other characters to a space, so each run of spaces
with the characters after it has an agenda of its own.  NumPy works through the agendas of many
short units at once; a unit of over ``SHORT`` symbols has a heap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.common import mix, releasing, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
SHORT = 48
_SLICE = 1 << 19
_SPACE, _MARK = 0x20, 0x2581
_NONE = np.uint64(np.iinfo(np.uint64).max)


class Vocabulary:
    """Pieces of a SentencePiece BPE model, and which pairs of them merge into which piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.byte_ids = np.array([i for i in range(n) if byte[i]], np.int64)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        ids = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        self.decoded = [bytes([i - int(self.byte_ids[0])]) if byte[i] else b"" if special[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in ids):
            raise ValueError("a piece spans the border of two units")
        self.single = np.arange(0x10000, dtype=np.int64) * -1 - 1  # unknown characters: -1 - code point
        self.rare = {}
        for p, i in ids.items():
            if len(p) == 1:
                if ord(p) < 0x10000:
                    self.single[ord(p)] = i
                else:
                    self.rare[ord(p)] = i
        self.single[_SPACE] = self.single[_MARK]
        self.single[_MARK] = -1 - _MARK  # a literal mark is no space: it goes by its bytes
        low = self.single[:128] < 0
        self.single[:128][low] = self.byte_ids[:128][low]
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        pairs = {}
        for rank, i in enumerate(order):
            p = pieces[i]
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (rank, i)
        self.pairs = pairs
        self._table(pairs)

    def _table(self, pairs: dict) -> None:
        """An open hash table over pairs, so that many are looked up at once."""
        self.bits = max(10, (4 * len(pairs)).bit_length())
        keys, value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        rest, packed = np.array(list(pairs), np.int64), np.array([r << 20 | i for r, i in pairs.values()], np.int64)
        at = self._place(rest)
        while len(rest):
            free = keys[at] < 0
            keys[at[free]], value[at[free]] = rest[free], packed[free]
            left = keys[at] != rest
            rest, packed, at = rest[left], packed[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.keys, self.value = keys, value

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | piece of each pair, or -1."""
        key = np.where((a < 0) | (b < 0), -2, a << 20 | b)
        at = self._place(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.value[at], -1)
        live = np.flatnonzero((seen != key) & (seen >= 0))
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[live]]
            hit = seen == key[live]
            out[live[hit]] = self.value[at[live[hit]]]
            live = live[~hit & (seen >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _skipped(key: np.ndarray, left: np.ndarray, right: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether each candidate is skipped; ``left`` and ``right`` are the places of its two symbols."""
    place = (left.astype(np.uint64) << np.uint64(32)) ^ (right.astype(np.uint64) << np.uint64(16)) ^ piece.astype(np.uint64)
    return (mix(key ^ mix(place)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def _heap(symbols: list[int], place: int, key: np.uint64, v: Vocabulary, dropout: float) -> list[int]:
    """The agenda of one unit, as a heap."""
    n = len(symbols)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
    agenda: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if i < 0 or j >= n or symbols[i] < 0 or symbols[j] < 0:
            return
        found = v.pairs.get(symbols[i] << 20 | symbols[j])
        if found is None:
            return
        rank, piece = found
        one = lambda x: np.array([x], np.int64)
        if not (dropout and _skipped(np.array([key]), one(place + i), one(place + j), one(piece), dropout)[0]):
            heapq.heappush(agenda, (rank, i, j, end[j], symbols[i], symbols[j], piece))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, j, stop, a, b, piece = heapq.heappop(agenda)
        if after[i] != j or symbols[i] != a or symbols[j] != b or end[j] != stop or end[i] != j:
            continue
        symbols[i], end[i], after[i] = piece, stop, after[j]
        symbols[j] = -1
        end[j] = -1
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def _short(symbols: np.ndarray, first: np.ndarray, keys: np.ndarray, v: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """The agendas of units of equal length (units x symbols) -> the symbols left, unit by unit, and their numbers.

    ``first`` is the place of each unit's first symbol.  Symbols stay in their columns and are linked
    to the next one left, so a merge touches its neighbours alone.
    """
    units, width = symbols.shape
    if width < 2:
        return symbols.ravel(), np.full(units, width)

    def offers(a, b, left, right, key):
        found = v.merge(a, b)
        on = found >= 0
        if dropout:
            on[on] = ~_skipped(key[on], left[on], right[on], found[on] & 0xFFFFF, dropout)
        return np.where(on, found.astype(np.uint64), _NONE)

    # A candidate's key is rank << 20 | piece, so the least key is the best piece; argmin takes the leftmost.
    rank = np.full((units, width), _NONE)
    places = first[:, None] + np.arange(width)
    rank[:, :-1] = offers(symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), places[:, :-1].ravel(), places[:, 1:].ravel(), np.repeat(keys, width - 1)).reshape(units, -1)
    flat = symbols.ravel()
    after, before = (np.tile(np.arange(k, width + k, dtype=np.int16), units) for k in (1, -1))
    left = np.ones(units * width, bool)
    live = np.arange(units)
    while len(live):
        best = rank.argmin(1)
        least = rank[np.arange(len(live)), best]
        row = np.flatnonzero(least != _NONE)
        if len(row) < 0.7 * len(live):  # most agendas are empty: go on with the others
            live, rank, best, least = live[row], rank[row], best[row], least[row]
            row = np.arange(len(live))
        if not len(row):
            break
        unit, i = live[row], best[row]
        base = unit * width
        at = base + i
        gone = after[at].astype(np.int64)
        left[base + gone] = False
        rank[row, gone] = rank[row, i] = _NONE
        flat[at] = (least[row] & np.uint64(0xFFFFF)).astype(np.int64)
        right = after[base + gone].astype(np.int64)
        after[at] = right
        has = np.flatnonzero(right < width)
        before[base[has] + right[has]] = i[has]
        prior = before[at].astype(np.int64)
        had = np.flatnonzero(prior >= 0)
        # the pairs of the new symbol with the one after it and the one before it
        own = np.concatenate([has, had])
        one, two = np.concatenate([i[has], prior[had]]), np.concatenate([right[has], i[had]])
        start, place = base[own], first[unit[own]]
        rank[row[own], one] = offers(flat[start + one], flat[start + two], place + one, place + two, keys[unit[own]])
    return flat[left], left.reshape(units, width).sum(1)


def encode(texts: list[str], keys: np.ndarray, v: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in one array, and where each text begins (n + 1)."""
    points = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    if not len(points):
        return np.zeros(0, np.int32), begin
    symbols = np.where(points < 0x10000, v.single[np.minimum(points, 0xFFFF)], -1 - points)
    for p in np.flatnonzero(points >= 0x10000).tolist():
        symbols[p] = v.rare.get(int(points[p]), symbols[p])
    space, mark = points == _SPACE, points == _MARK
    first = np.ones(len(points), bool)
    first[1:] = (space[1:] & ~space[:-1]) | mark[1:] | mark[:-1]
    first[begin[:-1][sizes > 0]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(points)))
    owner = np.searchsorted(begin, starts, "right") - 1
    local = starts - begin[owner]
    counts = lengths.copy()
    parts = []
    for n in np.unique(lengths).tolist():
        units = np.flatnonzero(lengths == n)
        if n > SHORT:
            for u in units.tolist():
                ids = _heap(symbols[starts[u] : starts[u] + n].tolist(), int(local[u]), keys[owner[u]], v, dropout)
                counts[u] = len(ids)
                parts.append((np.array([u]), np.array(ids, np.int64)))
            continue
        got, counts[units] = _short(symbols[starts[units][:, None] + np.arange(n)], local[units], keys[owner[units]], v, dropout)
        parts.append((units, got))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], np.int64)
    for units, got in parts:
        own = counts[units]
        out[np.repeat(at[units] - np.cumsum(own) + own, own) + np.arange(len(got))] = got
    text_at = np.concatenate([at[np.searchsorted(starts, begin[:-1])], at[-1:]])
    unknown = out < 0
    if unknown.any():  # by their UTF-8 bytes
        chars = [chr(-1 - x).encode("utf-8", "surrogatepass") for x in out[unknown].tolist()]
        size = np.ones(len(out), np.int64)
        size[unknown] = [len(c) for c in chars]
        wide = np.repeat(out, size)
        wide[wide < 0] = v.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        text_at = np.concatenate([[0], np.cumsum(size)])[text_at]
        out = wide
    return out.astype(np.int32), text_at


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text that was encoded; the space before its first word is dropped."""
    raw = b"".join(map(v.decoded.__getitem__, ids))
    return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


def _document_keys(ids: list, seed: int) -> np.ndarray:
    base = [int.from_bytes(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest(), "little") for i in ids]
    return np.array(base, np.uint64)


def _encoded(batch: pa.RecordBatch, doc_id: int, text: int, path: str, dropout: float, seed: int) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    v = vocabulary(path)
    _, offsets = utf8(batch.column(text))
    for a, b in slices(offsets, _SLICE):
        texts = [t or "" for t in batch.column(text).slice(a, b - a).to_pylist()]
        keys = _document_keys(batch.column(doc_id).slice(a, b - a).to_pylist(), seed)
        yield a, b, texts, *encode(texts, keys, v, dropout)


def encode_documents(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """``docs`` with ``piece_ids``; a column of that name is replaced.

    Null text has null ids, empty text none.  Documents of equal id and text get equal ids; a null id
    is an id like others.  Texts of any length are encoded whole.  Characters outside the vocabulary,
    and the mark that stands for a space in pieces, go by their bytes, so decoding gives every text
    back.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "piece_ids"])
    at, text, names = docs.columns.index("doc_id"), docs.columns.index("text"), [*docs.columns, "piece_ids"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, ids, begin in _encoded(batch, at, text, model, dropout, seed):
                part = batch.slice(a, b - a)
                null = part.column(text).is_null().to_numpy(zero_copy_only=False)
                column = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=names)

    return docs.mapInArrow(lambda batches: releasing(rows(batches)), T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from ``piece_ids``; null ids give null text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [None if i is None else decode(i, v) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    bare = encoded.select("doc_id", "piece_ids")
    return bare.mapInArrow(rows, T.StructType([bare.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """One row for each document: its pieces' number and digest, and whether they decode to its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for a, b, texts, ids, begin in _encoded(batch, 0, 1, model, dropout, seed):
                parts = [ids[begin[i] : begin[i + 1]] for i in range(b - a)]
                same = [decode(p.tolist(), v) == t for p, t in zip(parts, texts, strict=True)]
                digests = [hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), pa.array(digests), pa.array(same)], names=["doc_id", "n_pieces", "ids_sha256", "lossless"])

    bare = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(lambda batches: releasing(rows(batches)), T.StructType([bare.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]))
