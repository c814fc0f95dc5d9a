"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures, bands, exact verification.

A document is the multiset of its five-word shingles.  Weights are discretised at the integers and
grouped in dyadic levels (0,1], (1,2], (2,4], (4,8], ...; each (shingle, level) owns a Poisson process
over time whose rate is the level's width, spread over all signature components.  A point also
carries its place inside the level, drawn as if the level were halved again and again, and counts
only for weights that reach it.  Points come in rising time, so a process stops as soon as it passes
the time by which all components of its document are filled: a signature costs about
``m * (ln m + 4)`` points, whatever the length of the text.  Two components agree with exactly the
probability of the multiset Jaccard similarity.

Equal multisets become one numbered node first.  Nodes that share a band are candidates; each band
bucket is checked against one pivot, and buckets that still hold several components are checked in
full, in blocks of bounded size.  Every link is confirmed on the multisets themselves.  Only whole
texts of candidates move, and only numbers beside them; shingles are built where they are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.common import Tables, free_name, mix, releasing, slices, utf8, words, written

SHINGLE = 5
SIMILARITY = 0.8
COMPONENTS, ROWS = 96, 4
BANDS = COMPONENTS // ROWS
#: Members of a bucket that one block holds from each of its two chunks.
CHUNK = 512
#: Shingles that a block compares at once.
MOST_TOKENS = 1 << 20
#: Pairs of a block that are compared one by one; larger blocks are compared as matrices.
SMALL = 64
#: Values of a hash that narrow the texts down before the exact join; their broadcast is bounded.
SLOTS = 1 << 19
_WORD_KEYS = mix(np.arange(77, 77 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_TOKEN = np.uint64((1 << 48) - 1)
_MOST_ROWS = (1 << 16) - 1


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit shingles of all texts, each in its text's row number times 2**48, sorted.

    A text of one to four words has one shingle of all its words.
    """
    hashes, _, _, row = words(raw, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    total = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : k + len(total)] * _WORD_KEYS[k]
    own = row[: len(total)] == row[SHINGLE - 1 : SHINGLE - 1 + len(total)]
    keys, rows = total[own], row[: len(total)][own]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])
        more = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            more[has] += hashes[begin[short[has]] + k] * _WORD_KEYS[k]
        keys, rows = np.concatenate([keys, more + counts[short].astype(np.uint64)]), np.concatenate([rows, short])
    packed = (rows.astype(np.uint64) << np.uint64(48)) | (mix(keys) & _TOKEN)
    packed.sort()
    return packed, np.searchsorted(packed, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))


def counted(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a new element begins, and how often each occurs."""
    begin = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(packed)))


def signatures(packed: np.ndarray, bounds: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (texts x m) of 24-bit point identities; texts without shingles get 0."""
    n = len(bounds) - 1
    total = np.diff(bounds).astype(np.float64)
    begin, weight = counted(packed)
    element, doc = packed[begin] & _TOKEN, (packed[begin] >> np.uint64(48)).astype(np.int64)
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    limit = np.log(m) + 2  # fills seven signatures of eight; the others are drawn again, further
    open_docs = total > 0
    while open_docs.any():
        until = np.where(open_docs, limit / np.maximum(total, 1), -1.0)
        level = 0
        live = np.flatnonzero(open_docs[doc])
        while len(live):  # processes of one level, for all elements that reach into it
            width = 1.0 if level == 0 else float(1 << (level - 1))
            floor = 0 if level == 0 else 1 << (level - 1)
            e, d, w = element[live], doc[live], weight[live]
            end = until[d] * (width * m)
            seed = mix(e + np.uint64(level << 56))
            time = np.zeros(len(live))
            point = 0
            while len(seed):
                point += 1
                draw = mix(seed ^ mix(np.array([point], np.uint64)))
                time -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                on = time <= end
                seed, d, w, end, time, draw = seed[on], d[on], w[on], end[on], time[on], draw[on]
                more = mix(draw)
                place = (more >> np.uint64(40)).astype(np.float64) * 2.0**-24 * width
                counts = floor + 1 + place.astype(np.int64) <= w
                component = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                stamp = ((time / (width * m)).view(np.uint64) & ~np.uint64(0xFFFFFF)) | (draw & np.uint64(0xFFFFFF))
                np.minimum.at(best, (d * m + component)[counts], stamp[counts])
            level += 1
            live = live[weight[live] > (1 << (level - 1))]
        filled = (best.reshape(n, m) != np.iinfo(np.uint64).max).all(1)
        open_docs &= ~filled
        limit *= 2
    return (best.reshape(n, m) & np.uint64(0xFFFFFF)) * (total > 0)[:, None]


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = signature.shape
    keys = np.zeros((n, m // rows), np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x100000001B3) + signature[:, k::rows][:, : m // rows])
    return mix(keys + np.arange(m // rows, dtype=np.uint64)).view(np.int64)


def _tokens(packed: np.ndarray) -> np.ndarray:
    """Sorted set tokens of one text: the k-th copy of a shingle is an element of its own."""
    begin, count = counted(packed)
    copy = np.arange(len(packed)) - np.repeat(begin, count)
    out = mix((packed & _TOKEN) + (copy.astype(np.uint64) << np.uint64(48)))
    out.sort()
    return out


def _node_keys(packed: np.ndarray, bounds: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes for each text; equal multisets have equal keys, and wordless texts equal bytes."""
    n = len(bounds) - 1
    one, two = mix(packed & _TOKEN), mix(packed & _TOKEN ^ np.uint64(0x5DEECE66D5DEECE6))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (one, two)]
    keys = np.stack([mix(s[bounds[1:]] - s[bounds[:-1]]) for s in sums], 1)
    data = [keys[i].tobytes() for i in range(n)]
    for i in np.flatnonzero(bounds[1:] == bounds[:-1]).tolist():
        data[i] = hashlib.blake2b(raw[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
    return data


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = utf8(column)
    for a, b in slices(offsets):
        for c in range(a, b, _MOST_ROWS):
            d = min(b, c + _MOST_ROWS)
            yield c, d, raw[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in _pieces(batch.column(1)):
            packed, bounds = shingles(raw, offsets)
            nodes = _node_keys(packed, bounds, raw, offsets)
            keys = band_keys(signatures(packed, bounds))
            size = np.where(np.diff(bounds) > 0, BANDS, 0)
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[np.diff(bounds) > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(nodes, pa.binary()), bands], names=["id", "node", "bands"])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and tokens of each text whose node key is the expected one (columns node, text last)."""
    wanted = batch.column(batch.num_columns - 2).to_pylist()
    for a, _, raw, offsets in _pieces(batch.column(batch.num_columns - 1)):
        packed, bounds = shingles(raw, offsets)
        for i, node in enumerate(_node_keys(packed, bounds, raw, offsets)):
            if node == wanted[a + i]:  # an id may come with several texts
                yield a + i, _tokens(packed[bounds[i] : bounds[i + 1]])


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    common = overlap(x, y)
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def _group_links(numbers: list[int], tokens: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect a group: of its first row to all others, then of what is left to all rows."""
    linked = np.array([True] + [_similar(tokens[0], t, similarity) for t in tokens[1:]])
    links = [(numbers[0], numbers[i]) for i in np.flatnonzero(linked).tolist() if i]
    outer = np.flatnonzero(~linked)
    if len(outer) and len(tokens) > 2:
        comps = np.where(linked, numbers[0], numbers).tolist()
        links += [(numbers[i], numbers[j]) for i, j in _block_links(comps, tokens, outer, np.arange(1, len(tokens)), similarity)]
    return links


def _stars(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, chunk, n, node, text), the pivot's own first in each chunk -> links (a, b)."""
    held: dict[int, np.ndarray] = {}
    at = None

    def done() -> pa.RecordBatch:
        links = _group_links(list(held), list(held.values()), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        pivots, chunks, numbers = (batch.column(k).to_numpy() for k in range(3))
        for i, tokens in _texts(batch):
            here = (int(pivots[i]), int(chunks[i]))
            if at != here:
                if len(held) > 1:
                    yield done()
                held, at = {}, here
                if numbers[i] != pivots[i]:
                    raise ValueError("the documents changed between two reads: a pivot's text is not there")
            held[int(numbers[i])] = tokens
    if len(held) > 1:
        yield done()


def _block_links(comps: list[int], tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a block between rows of different components, as many as connect them."""
    sizes = np.array([len(t) for t in tokens])
    if sizes[left].sum() + sizes[right].sum() > MOST_TOKENS and max(len(left), len(right)) > 1:  # long texts: in parts
        if len(left) < len(right):
            left, right = right, left
        half = len(left) // 2
        return _block_links(comps, tokens, left[:half], right, similarity) + _block_links(comps, tokens, left[half:], right, similarity)
    if len(left) * len(right) <= SMALL:
        similar = np.array([[comps[i] != comps[j] and _similar(tokens[i], tokens[j], similarity) for j in right] for i in left])
        return _connecting(comps, similar, left, right)
    rows = np.union1d(left, right)
    flat = np.concatenate([tokens[i] for i in rows])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    _, column = np.unique(place[shared], return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    owner = np.repeat(rows, sizes[rows])[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    place_left, place_right = np.full(len(tokens), -1), np.full(len(tokens), -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(0, width, 4096):
        on = (column >= c) & (column < c + 4096)
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        l, r = on & (place_left[owner] >= 0), on & (place_right[owner] >= 0)
        x[place_left[owner[l]], column[l] - c] = 1
        y[place_right[owner[r]], column[r] - c] = 1
        common += x @ y.T
    similar = common >= similarity * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-6
    number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    label = np.array([number[c] for c in comps])
    similar &= label[left][:, None] != label[right][None, :]
    return _connecting(comps, similar, left, right)


def _connecting(comps: list[int], similar: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the similar pairs, as many as connect their components."""
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in np.argwhere(similar).tolist():
        a, b = find(comps[left[i]]), find(comps[right[j]])
        if a != b:
            root[b] = a
            out.append((int(left[i]), int(right[j])))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, c1, c2, chunk, n, component, node, text), sorted by block -> links (a, b)."""
    held: dict[int, tuple] = {}
    at = None

    def done() -> pa.RecordBatch:
        rows = list(held.values())
        comps = [h[1] for h in rows]
        links = []
        if len(set(comps)) > 1:
            chunk = np.array([h[2] for h in rows])
            left, right = np.flatnonzero(chunk == at[1]), np.flatnonzero(chunk == at[2])
            links = _block_links(comps, [h[3] for h in rows], left, right, similarity)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in links], pa.int64()), pa.array([rows[j][0] for _, j in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        keys, first, second, chunk, numbers, comps = (batch.column(k).to_numpy() for k in range(6))
        for i, tokens in _texts(batch):
            here = (int(keys[i]), int(first[i]), int(second[i]))
            if at != here:
                if len(held) > 1:
                    yield done()
                held, at = {}, here
            held[int(numbers[i])] = (int(numbers[i]), int(comps[i]), int(chunk[i]), tokens)
    if len(held) > 1:
        yield done()


def components(edges: DataFrame) -> DataFrame:
    """(n, component) for every number in ``edges`` (a, b); the component is its least number.

    Each round hooks numbers to their least neighbour and contracts the edges; edges and map are
    written to the shared folder, and only counts come to the driver.
    """
    tables, k = Tables(edges.sparkSession), 0
    edges = tables.write("edges0", edges.where("a <> b").distinct())
    ends = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct()
    found = tables.write("found0", ends.withColumn("component", F.col("n")))
    while not edges.isEmpty():
        k += 1
        both = edges.union(edges.select("b", "a"))
        hook = tables.write(f"hook{k}", both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")))
        found = tables.write(f"found{k}", found.join(hook, found.component == hook.v, "left").select("n", F.coalesce("p", "component").alias("component")))
        moved = edges.join(hook, edges.a == hook.v).select(F.col("p").alias("a"), "b")
        moved = moved.join(hook, moved.b == hook.v).select("a", F.col("p").alias("b"))
        kept = hook.select(F.col("p").alias("q")).join(hook, F.col("q") == F.col("v")).select(F.col("q").alias("a"), F.col("p").alias("b"))
        edges = tables.write(f"edges{k}", moved.union(kept).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        tables.remove(f"edges{k - 1}", f"found{k - 1}", f"hook{k}")
    return found


def _usable(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bare = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return bare.where("id is not null and text is not null")


def _with_text(usable: DataFrame, rows: DataFrame, nodes: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``rows`` (n, ...) with the node key and the text of each number; texts move once, by document id."""
    rows = tables.write(name, rows.join(nodes.select("n", "id", "node"), "n"))
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")
    # SLOTS numbers at most are broadcast: most texts that no candidate needs stay where they are.
    slots = F.broadcast(tables.write(f"{name}_slots", rows.select(slot).distinct()))
    return usable.withColumn("slot", slot).join(slots, "slot", "left_semi").select("id", "text").join(rows, "id")


def _classes(docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """(id, node, class_id, first_node) of each row with id and text; the class's first row has ids and keys equal."""
    usable, tables = _usable(docs, doc_id, text), Tables(docs.sparkSession)
    signed = tables.write("signed", usable.mapInArrow(lambda batches: releasing(_sign(batches)), "id long, node binary, bands array<long>"))
    nodes = signed.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    nodes = tables.write("nodes", nodes.withColumn("n", F.monotonically_increasing_id()))  # numbers count once written
    ids = signed.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    if not ids.isEmpty():  # each text of a repeated id once
        usable = usable.dropDuplicates(["id", "text"])
    members = _members(nodes, tables)
    links, large = _star_links(usable, members, nodes, tables, similarity)
    links = tables.write("links", links)
    found = components(links)
    if not large.isEmpty():
        rest = tables.write("rest", _rest(usable, members.join(large.select("pivot"), "pivot"), found, nodes, tables, similarity))
        if not rest.isEmpty():
            found = components(links.union(rest))
    linked = found.join(nodes.select("n", "id", "node"), "n")
    first = linked.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first"))
    first = tables.write("first", first.select("component", F.col("first.id").alias("class_id"), F.col("first.node").alias("first_node")))
    moved = tables.write("moved", linked.join(first, "component").select("node", "class_id", "first_node"))
    alone = nodes.select("node", "id").join(moved.select("node"), "node", "left_anti").select("node", F.col("id").alias("class_id"), F.col("node").alias("first_node"))
    by_node = tables.write("by_node", moved.union(alone))
    tables.remove("nodes", "members", "links", "rest", "first", "moved", "roles", "roles_slots", "blocks", "blocks_slots")
    return signed.select("id", "node").join(by_node, "node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row (doc_id, class_id) for every row of ``docs``; the class is its least document id.

    Documents are in one class when links of multiset similarity ``similarity`` or more connect them.
    Texts of under five words are one shingle; texts without any word (empty ones too) are alike
    only if their bytes are equal.  Null text is never a duplicate: its class is its own id.  A null
    id gets a null class and stands for no other document.  Repeated rows are returned each, and
    every text of a repeated id is classed by itself.  Very long texts are signed and compared
    whole, one at a time.  An empty table gives no rows.  Other columns, whatever their names, are
    not read.
    """
    classes = _classes(docs, doc_id, text, similarity)
    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_id).cast("long").alias("class_id"), F.col(text).isNull().alias("none"))
    alone = bare.where("doc_id is null or none").drop("none")
    return classes.select(F.col("id").alias("doc_id"), "class_id").unionByName(alone)


def _keyed(batches: Iterator[pa.RecordBatch], text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows with the node key of their text as a last column."""
    for batch in batches:
        keys: list[bytes] = []
        for _, _, raw, offsets in _pieces(batch.column(text)):
            packed, bounds = shingles(raw, offsets)
            keys += _node_keys(packed, bounds, raw, offsets)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=names)


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: of those with its least id, that of the least node key.

    Rows without id or text all stay.  A repeated id stands for each of its texts: one whose class
    has another first row goes, the others stay, and of equal rows of one text one stays.  Columns
    beside ``doc_id`` and ``text``, whatever their names, stay as they are; an empty table stays empty.
    """
    rows = written(_classes(docs, "doc_id", "text", similarity).select("id", "node", (F.col("id") == F.col("class_id")).alias("least"), (F.col("node") == F.col("first_node")).alias("first")))
    repeated = written(rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    gone = rows.where("not (least and first)").select("id").union(repeated).distinct().withColumnRenamed("id", "doc_id")
    slot, name = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SLOTS)), free_name(docs, "slot")
    gone = written(gone)
    # SLOTS numbers at most are broadcast; only documents whose number is among them are joined by id.
    hit = free_name(docs, "hit")
    numbers = written(gone.select(slot.alias(name)).distinct()).withColumn(hit, F.lit(True))
    marked = docs.withColumn(name, slot).join(F.broadcast(numbers), name, "left").drop(name)
    loose = F.col("doc_id").isNull() | F.col("text").isNull() | F.col(hit).isNull()
    clear = marked.where(loose).drop(hit)
    kept = clear.unionByName(marked.where(~loose).drop(hit).join(gone, "doc_id", "left_anti").select(*docs.columns))
    if repeated.isEmpty():
        return kept
    doubtful = docs.where("doc_id is not null and text is not null").join(repeated.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(*docs.columns)
    node = free_name(docs, "node")
    names = [*docs.columns, node]
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())])
    at = docs.columns.index("text")
    doubtful = doubtful.mapInArrow(lambda batches: releasing(_keyed(batches, at, names)), schema)
    firsts = rows.where("least and first").select(F.col("id").alias("doc_id"), F.col("node").alias(node)).distinct()
    once = doubtful.join(firsts, ["doc_id", node], "left_semi").dropDuplicates(["doc_id", node])
    return kept.unionByName(once.select(*docs.columns))


def _members(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(key, n, pivot, size) of the band buckets with several members; of buckets with equal members, one.

    The pivot is the bucket's least number, so that the buckets of one group share few pivots.
    """
    bands = nodes.select("n", F.explode("bands").alias("key"))
    shared = tables.write("shared", bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    every = tables.write("every", bands.join(shared.select("key"), "key"))
    one, two = F.xxhash64("n"), F.xxhash64("n", F.lit(1))
    buckets = every.groupBy("key").agg(F.min("n").alias("pivot"), F.count("*").alias("size"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))
    buckets = tables.write("buckets", buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.min("pivot").alias("pivot")).select("key", "pivot", "size"))
    members = tables.write("members", every.join(buckets, "key").select("key", "n", "pivot", "size"))
    tables.remove("shared", "every", "buckets")
    return members


def _star_links(usable: DataFrame, members: DataFrame, nodes: DataFrame, tables: Tables, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links among a pivot and all members of its buckets, and the pivots with several chunks.

    A pivot's members are dealt out to chunks of about CHUNK, and the pivot's text goes to each.  In
    a chunk, what is not linked to the pivot is compared with all of the chunk, so that only pivots
    with several chunks leave pairs open.
    """
    pairs = tables.write("pairs", members.where("n <> pivot").select("n", "pivot").distinct())
    chunks = tables.write("chunks", pairs.groupBy("pivot").agg(F.count("*").alias("c")).select("pivot", F.ceil(F.col("c") / CHUNK).alias("chunks")))
    large = tables.write("large", chunks.where("chunks > 1"))
    own = pairs.join(large, "pivot", "left").select("n", "pivot", F.pmod(F.xxhash64("n"), F.coalesce("chunks", F.lit(1))).alias("first"))
    roles = own.withColumn("last", F.col("first")).union(chunks.select(F.col("pivot").alias("n"), "pivot", F.lit(0).cast("long"), F.col("chunks") - 1))
    rows = _with_text(usable, roles, nodes, tables, "roles")
    rows = rows.select("pivot", F.explode(F.sequence("first", "last")).alias("chunk"), "n", "node", "text")
    rows = rows.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "n")
    return rows.mapInArrow(lambda batches: releasing(_stars(batches, similarity)), "a long, b long"), large


def _rest(usable: DataFrame, members: DataFrame, found: DataFrame, nodes: DataFrame, tables: Tables, similarity: float) -> DataFrame:
    """Links inside buckets whose members still lie in several components, from all their pairs."""
    own = members.join(found, "n", "left").select("key", "n", "pivot", F.coalesce("component", "n").alias("component"))
    own = tables.write("own", own)
    # The pivot's component is not compared with itself, so a large one is read once for each outer chunk.
    core = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("n") == F.col("pivot"), F.col("component"))).alias("core")).where("lo < hi").select("key", "core")
    own = tables.write("open", own.join(core, "key").select("key", "n", "component", (F.col("component") == F.col("core")).alias("inner")))
    counts = own.groupBy("key").agg(F.count(F.when(~F.col("inner"), 1)).alias("outer"), F.count(F.when(F.col("inner"), 1)).alias("core"))
    own = own.join(counts, "key")
    outer, core = (F.ceil(F.col(c) / CHUNK).cast("int") for c in ("outer", "core"))
    whole = F.col("outer") + F.col("core") <= CHUNK  # one block holds the bucket
    chunk = F.when(whole, 0).when(F.col("inner"), outer + F.pmod(F.xxhash64("n"), core)).otherwise(F.pmod(F.xxhash64("n"), outer)).cast("int")
    last = F.when(whole, 0).when(F.col("inner"), outer - 1).otherwise(outer + core - 1)
    own = own.select("key", chunk.alias("chunk"), "n", "component", last.alias("last"))
    rows = _with_text(usable, own, nodes, tables, "blocks").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.select("key", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "n", "component", "node", "text")
    rows = rows.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
    return rows.mapInArrow(lambda batches: releasing(_blocks(batches, similarity)), "a long, b long")
