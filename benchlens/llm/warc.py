"""WARC archives: records are written and read with Spark, and assembled to one row per capture.

Writing: each page becomes a response (or revisit), a request and a metadata record.  They are text
(the payload is UTF-8), so Spark's text sink with the record separator as its line separator writes
true WARC files, gzip-compressed, into a folder that all executors share.

Reading: files are parsed in a stream by their Content-Length fields.  Records of a transaction are
joined through WARC-Concurrent-To, in whichever direction an archive states it, and revisits find
the response they refer to by a join on its record id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from benchlens.llm.common import Tables, written

#: Payloads below this many bytes are always stored in full.
DEDUP_BYTES = 100
#: Payload bytes of an archive file, at most (or one record): a reader holds one file at a time.
FILE_BYTES = 32 << 20
#: Payloads are filed by size, so that a file's number of records bounds its bytes.
SIZE_CLASSES = (8 << 10, 128 << 10, 2 << 20)
#: Rows of a repeated record id are numbered in so many parts.
PARTS = 64
_END = "\r\n\r\n"
#: Fields that a record may have several times; their values are kept side by side.
_REPEATED = ("warc-concurrent-to",)
_BATCH_BYTES = 4 << 20


def _urn(*parts: Column | str) -> Column:
    """A record id in UUID form, decided by the given values."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, content_type: str, block: Column, *headers: Column) -> Column:
    """A record without the four bytes that end it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit("WARC-Date: 2026-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def _records(page: DataFrame) -> DataFrame:
    """The three records of each page (page_id, url, html, n, digest; of_page and of_url if it revisits)."""
    again = F.col("of_page").isNotNull()
    own = _urn("response", F.col("page_id"), F.col("url"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    path_part = F.regexp_extract("url", r"^\w+://[^/]*(/.*)?$", 1)
    request = F.concat(F.lit("GET "), F.when(path_part == "", "/").otherwise(path_part), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^\w+://([^/?#]*)", 1), F.lit(_END))
    refers = F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn("response", F.col("of_page"), F.col("of_url"), F.col("digest"))))
    with_own = F.concat(F.lit("WARC-Concurrent-To: "), own)
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    records = F.array(
        _record(F.when(again, "revisit").otherwise("response"), own, F.col("url"), "application/http; msgtype=response", F.when(again, head).otherwise(F.concat(head, "html")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), refers),
        _record("request", _urn("request", F.col("page_id"), F.col("url"), F.col("digest")), F.col("url"), "application/http; msgtype=request", request, with_own),
        _record("metadata", _urn("metadata", F.col("page_id"), F.col("url"), F.col("digest")), F.col("url"), "application/warc-fields", fields, with_own),
    )
    return page.select(F.explode(records).alias("value"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Write all pages (page_id, url, html) as WARC files into the new folder ``path``.

    Of the rows with equal payloads of DEDUP_BYTES or more, those with the least page id are responses
    and the others revisit it.  Repeated rows of one page id and payload count as captures of their own
    with the same role.  A row without page id is a response and no revisit refers to it, unless all of
    its equals lack an id too.  Null html is an empty payload; null urls are empty; a very long payload
    has a file of its own; an empty table writes no record.  Further columns are not read.

    Roles are found on narrow rows.  Each size class that occurs is written by itself, so payloads are
    moved once at most (to meet their role by page id) and files are bounded.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7f]+", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    tables = Tables(pages.sparkSession)
    narrow = tables.write("narrow", page.where((F.col("n") >= DEDUP_BYTES) & F.col("page_id").isNotNull()).select("page_id", "url", "digest"))
    groups = narrow.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("page_id", "url")).alias("of")).where("copies > 1")
    groups = tables.write("groups", groups.select("digest", F.col("of.page_id").alias("of_page"), F.col("of.url").alias("of_url")))
    roles = tables.write("roles", narrow.select("page_id", "digest").distinct().join(groups, "digest").where("page_id <> of_page"))
    size_class = F.lit(len(SIZE_CLASSES))
    for k in reversed(range(len(SIZE_CLASSES))):
        size_class = F.when(F.col("n") <= SIZE_CLASSES[k], k).otherwise(size_class)
    for k in sorted(r.k for r in page.select(size_class.alias("k")).distinct().collect()) or [0]:  # four classes at most
        own = _records(page.where(size_class == k).join(roles, ["page_id", "digest"], "left"))
        most = 3 * (FILE_BYTES // SIZE_CLASSES[k] if k < len(SIZE_CLASSES) else 1)
        own.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size={k}")
    tables.remove("narrow", "groups", "roles")


RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "payload_digest")]
    + [T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("block_bytes", T.LongType()), T.StructField("payload", T.BinaryType())]
)


def _stream(content: bytes) -> Iterator[bytes]:
    """The bytes of a file in parts, decompressed; any number of gzip members may follow each other."""
    view = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        for a in range(0, len(view), 1 << 20):
            yield bytes(view[a : a + (1 << 20)])
        return
    unzip, rest = zlib.decompressobj(31), view
    while True:
        part = unzip.decompress(rest, 1 << 20)
        if part:
            yield part
        if unzip.eof:
            rest = unzip.unused_data
            if not rest:
                return
            unzip = zlib.decompressobj(31)
        else:
            rest = unzip.unconsumed_tail
            if not rest and not part:
                return


def _lines(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            key, text = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
            out[key] = f"{out[key]} {text}" if key in _REPEATED and key in out else text
    return out


def parse(content: bytes) -> Iterator[tuple]:
    """All records of a WARC file, as rows of RECORD; a file cut short raises ValueError."""
    held, parts = bytearray(), _stream(content)

    def more(until: int) -> bool:
        while len(held) < until:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                if held.strip():
                    raise ValueError("WARC file ends inside a record's head")
                return
        if not (head := bytes(held[:end])).startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        named = _lines(head)
        n = int(named.get("content-length", "0"))
        if not more(end + 4 + n):
            raise ValueError("WARC file ends inside a record")
        block = bytes(held[end + 4 : end + 4 + n])
        more(end + 8 + n)
        del held[: end + 8 + n]
        while held[:2] == b"\r\n":
            del held[:2]
        fields, payload, kind = {}, block, named.get("content-type", "")
        if kind.startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
            fields = _lines(first)
        elif kind.startswith("application/warc-fields"):
            fields, payload = _lines(block), b""
        yield (named.get("warc-record-id"), named.get("warc-type"), named.get("warc-concurrent-to"), named.get("warc-refers-to"), named.get("warc-target-uri"), named.get("warc-date"), kind, named.get("warc-payload-digest"), list(fields.items()), n, payload)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for record in parse(content.as_py()):
                held.append(record)
                size += record[-2] + 500
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of all WARC files in a folder, plain or gzip-compressed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(_read, RECORD)


def _numbered(records: DataFrame) -> DataFrame:
    """``records`` with ``at``, which numbers the rows of each type and record id from 0.

    Only where some id is repeated are rows numbered: within PARTS parts of each id, whose counts give
    each part its offset, so that no task holds all rows of an id.
    """
    by = ["record_type", "record_id"]
    if records.where("record_id is not null").groupBy(*by).agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return records.select("*", F.lit(0).cast("long").alias("at"))
    rows = written(records.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.pmod("at", F.lit(PARTS)))
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("c"))
    before = counts.select(*by, "part", (F.sum("c").over(W.partitionBy(*by).orderBy("part")) - F.col("c")).alias("before"))  # PARTS rows an id
    place = F.row_number().over(W.partitionBy(*by, "part").orderBy("at")) - 1
    rows = rows.withColumn("at", place.cast("long"))
    same = [rows[c].eqNullSafe(before[c]) for c in (*by, "part")]
    return rows.join(before, same).select(*[rows[c] for c in records.columns], (rows["at"] + before["before"]).alias("at"))


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: its ``response`` (or revisit), ``request`` and ``metadata`` records.

    A record belongs to the response that a concurrent-to id of its names, or that names it, directly
    or through one further record; of several, the least id counts.  Records repeated under one id are
    paired one by one.  Requests and metadata without any response are left out; a response without
    them has nulls there.  Null ids belong to nothing.  An empty table gives no rows.  Further columns
    of ``records`` stay inside the nested rows.
    """
    hub = F.col("record_type").isin("response", "revisit")
    columns = F.struct(*records.columns)
    links = records.where("record_id is not null and concurrent_to is not null").select(hub.alias("hub"), "record_id", F.explode(F.split("concurrent_to", r"\s+")).alias("other")).where("other <> ''")
    hubs = records.where(hub).select(F.col("record_id").alias("h")).distinct()
    hops = links.where("not hub").select(F.col("record_id").alias("start"), F.col("other").alias("to")).union(links.where("hub").select(F.col("other").alias("start"), F.col("record_id").alias("to")))
    hops = written(hops.where("start <> to").distinct())
    near = hops.join(hubs, F.col("to") == F.col("h")).select("start", F.col("h").alias("key"))
    near = near.groupBy("start").agg(F.min("key").alias("key")).withColumnRenamed("start", "record_id")
    near = written(near)
    rows = _numbered(records.where("record_id is not null")).select("record_type", "record_id", columns.alias("record"), "at")
    others = written(rows.where(~hub).join(near, "record_id", "left"))
    loose = others.where("key is null").select("record_id").distinct()
    if not loose.isEmpty():  # through one further record, which names it or which it names
        either = links.select("record_id", "other")
        either = either.union(either.select("other", "record_id")).distinct().join(loose, "record_id")
        far = either.join(near.withColumnsRenamed({"record_id": "other", "key": "far"}), "other").groupBy("record_id").agg(F.min("far").alias("far"))
        others = others.join(far, "record_id", "left").withColumn("key", F.coalesce("key", "far"))
    every = rows.where(hub).select("record_type", "record_id", "record", "at", F.col("record_id").alias("key")).unionByName(others.where("key is not null").select("record_type", "record_id", "record", "at", "key"))
    kinds = (("response", ("response", "revisit")), ("request", ("request",)), ("metadata", ("metadata",)))
    nested = every.groupBy("key", "at").agg(*[F.min_by("record", F.when(F.col("record_type").isin(*names), F.col("record_id"))).alias(name) for name, names in kinds])
    return nested.where("response is not null").select(F.col("key").alias("capture_id"), "response", "request", "metadata")


def captures(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back and return one digest row for each page."""
    tables = Tables(pages.sparkSession)
    path = f"{tables.root}/warc"
    write_pages(pages, path)
    records = read_records(pages.sparkSession, path)
    records = records.select("record_id", "record_type", "concurrent_to", "refers_to", F.element_at("fields", "pageid").alias("page_id"), F.element_at("fields", "content-length").cast("long").alias("stated"), "payload_digest", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha256"))
    records = tables.write("records", records)  # a few hundred bytes a record: payloads are read once and not shuffled
    found = tables.write("found", assemble(records).select("response", F.expr("try_cast(nullif(metadata.page_id, '') as long)").alias("page_id")))
    revisit = F.col("response.record_type") == "revisit"
    stored = found.where(~revisit).select(F.col("response.record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("response.n").alias("payload_bytes"), F.col("response.sha256").alias("payload_digest"))
    # A revisit's payload is that of the response it refers to, as read back; only where an archive
    # lacks that response are size and digest those that the revisit states.
    joined = found.where(revisit).join(tables.write("stored", stored.dropDuplicates(["target"])), F.col("response.refers_to") == F.col("target"), "left")
    stated = F.regexp_replace("response.payload_digest", "^sha256:", "")
    joined = joined.select("page_id", F.coalesce("payload_bytes", "response.stated").alias("payload_bytes"), F.coalesce("payload_digest", stated).alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    whole = found.where(~revisit).select("page_id", F.col("response.n").alias("payload_bytes"), F.col("response.sha256").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(joined)
