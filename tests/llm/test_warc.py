"""Archives: exact round trip of payloads and revisits."""
import hashlib

from pyspark.sql import functions as F

from evq.functions.lineage import folder
from evq.llm import warc
from evq.llm.queries import op1

TRICKY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\nWARC/1.1" + "x" * 90


def plain(rows):
    """{(id, html): (bytes, digest, type, refers_to)}."""
    out, first = [], {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        revisit = to is not None and i != to
        out.append((i is None, i or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_query(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted(((r.page_id is None, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op1(spark, sf).collect()), key=str)
    assert got == plain(pages)


def test_edges_and_round_trip(spark):
    rows = [(3, TRICKY), (1, TRICKY), (2, None), (4, ""), (5, "short"), (6, "short"), (None, TRICKY), (7, "é" * 60), (8, "é" * 60), (8, "é" * 60), (9, "\r\n\r\n" * 40), (10, "z" * 700000)]
    pages = spark.createDataFrame([(i, None if i == 5 else f"http://x/{i}\r\nevil", h, "e") for i, h in rows], "page_id long, url string, html string, `Digest` string").repartition(3)
    got = [(r.id == "", int(r.id or 0), r.payload_bytes, r.digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in warc.archive(pages).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert warc.archive(pages.limit(0)).count() == 0


def test_record_stream():
    """Content is taken by length, whatever it holds and however the stream is cut."""
    def record(body):
        return b"WARC/1.1\r\nContent-Length: %d\r\nA: b\r\n\r\n%s\r\n\r\n" % (len(body), body)

    bodies = [b"", b"\r\n\r\n", TRICKY.encode(), b"x" * 5000]
    data = b"".join(map(record, bodies))
    for step in (1, 7, 100, len(data)):
        assert [b for _, b in warc.records(data[i:i + step] for i in range(0, len(data), step))] == bodies


def test_archive_holds_each_payload_once(spark):
    pages = spark.createDataFrame([(i, "u", "same payload " * 20) for i in range(50)], "page_id long, url string, html string")
    path = folder(spark, "warc-test")
    warc.write(pages, path)
    raw = spark.read.format("binaryFile").load(path).filter(F.col("path").contains("part-")).collect()
    text = b"".join(b"".join(warc._unzipped(bytes(r.content))) for r in raw)
    assert text.count(b"same payload " * 20) == 1 and text.count(b"WARC-Type: revisit") == 49 and text.count(b"WARC-Refers-To-Page-ID: 0\r\n") == 49
