import gzip
import hashlib

import pytest

from benchlens.llm import warc as X

LONG = "<p>été \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 200
PAGES = [
    (5, "http://a.example/x?y#z", LONG, "c"),
    (3, "http://b.example", LONG, "c"),
    (9, "http://b.example/q r\n", LONG, "c"),
    (1, "http://c.example/", "short", "c"),
    (2, "http://c.example/", "short", "c"),
    (4, None, None, "c"),
    (6, "http://d.example/", "", "c"),
    (7, "http://d.example/", "y" * 100_000, "c"),
    (8, "http://d.example/", "z" * 99, "c"),
    (10, "http://d.example/", "z" * 99, "c"),
    (11, "http://e.example/", "é" * 50, "c"),
    (12, "http://e.example/", "é" * 50, "c"),
]


def brute(pages):
    out = []
    for p, _, html, _ in pages:
        raw = (html or "").encode()
        least = min(q for q, _, h, _ in pages if (h or "").encode() == raw and q is not None)
        again = len(raw) >= 100 and p != least
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out)


def test_round_trip(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(4)
    assert sorted(map(tuple, X.captures(frame).collect())) == brute(PAGES)


def test_repeated_and_null_rows(spark):
    pages = [(1, "u", "a" * 150, ""), (1, "u", "a" * 150, ""), (2, "v", "a" * 150, ""), (None, "w", "a" * 150, "")]
    got = X.captures(spark.createDataFrame(pages, "page_id long, url string, html string, digest string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None)]
    assert X.captures(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def record(kind, rid, block=b"", **more):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Record_ID": rid, **more}.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_assembly_in_every_direction(spark, tmp_path):
    http = {"Content_Type": "application/http"}
    first = [record("warcinfo", "<i>"), record("request", "<q1>", b"GET /\r\n\r\n", **http), record("response", "<r1>", b"HTTP/1.1 200\r\nA: b\r\n\r\nbody", WARC_Concurrent_To="<q1>", **http), record("metadata", "<m1>", b"k: v\r\n", WARC_Concurrent_To="<q1>", Content_Type="application/warc-fields")]
    second = [record("response", "<r2>", b"HTTP/1.1 200\r\n\r\n", **http), record("request", "<q2>", b"", WARC_Concurrent_To="<r2>"), record("metadata", "<m2>", b"", WARC_Concurrent_To="<q2>"), record("metadata", "<m3>", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))
    (tmp_path / "b.warc").write_bytes(b"".join(second))
    (tmp_path / "c.warc").write_bytes(b"")
    records = X.read_records(spark, str(tmp_path))
    assert records.count() == 8
    got = {r.capture_id: (r.response.record_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id, bytes(r.response.payload)) for r in X.assemble(records).collect()}
    assert got == {"<r1>": ("<r1>", "<q1>", "<m1>", b"body"), "<r2>": ("<r2>", "<q2>", "<m2>", b"")}


def test_damage():
    with pytest.raises(ValueError):
        list(X.parse(record("response", "<a>", b"12345")[:-6]))
    with pytest.raises(ValueError):
        list(X.parse(b"junk\r\n\r\n"))
