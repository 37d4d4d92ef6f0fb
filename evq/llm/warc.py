"""WARC archives with revisit resolution.

Headers only are shuffled by payload digest: one grouped aggregation finds the original of every
repeated payload, a join gives the others their revisit target. Archives are then written with fresh
headers: an original carries its payload, a revisit carries none and refers to its original.

Files are gzip-compressed WARC 1.1 streams written by Spark's text sink (records end with the blank
lines the format asks for) and read as binary files, record by record along Content-Length, so a
payload may contain anything, the marks of a record too. A record is held in memory, a file is not.

Payloads under MIN_BYTES are never deduplicated. A null page is an empty payload. Rows with a null
id are written with an empty id and are never an original; rows with the same id and payload are one
original and the rest of its rows are responses of the same id. Null urls are written empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.functions.lineage import folder
from evq.llm.common import staged

MIN_BYTES = 100
CRLF = "\r\n"
PIECE = 1 << 18
#: Uncompressed bytes of payload in one archive file, about.
FILE_ROWS = 2000


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, url, digest, bytes, original) per row; original is the smallest id with that payload, null where the payload is alone or short."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    heads = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    first = heads.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return heads.join(first, "digest", "left")


def _uri(page_id: Column) -> Column:
    """A name-based record id: the digest of the page id in the layout of a UUID."""
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write deduplicated archives: one record per row."""
    originals = staged(headers(pages, id_col, url_col, html_col, min_bytes).filter(F.col("original").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("original"))))
                       .select("id", "digest", "original").distinct(), "revisits")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(originals.select("id", "digest", "original"), (rows["id"].eqNullSafe(originals["id"])) & (rows["digest"] == originals["digest"]), "left").select(rows["*"], "original")
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = lambda c: F.regexp_replace(c, "[\r\n]", "")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", _uri(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", clean(F.col("url"))), line("WARC-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _uri(F.col("original"))),
                                 line("WARC-Refers-To-Page-ID", F.col("original").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF), body)
    rows.select(head.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).mode("errorifexists").text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record of an uncompressed WARC byte stream."""
    chunks, held = iter(chunks), bytearray()
    at = 0

    def need(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            if at > PIECE:
                del held[:at]
                at = 0
            held += more
        return True

    while need(8):
        end = held.find(b"\r\n\r\n", at)
        while end < 0:
            if not need(len(held) - at + 1):
                raise ValueError("record header is cut off")
            end = held.find(b"\r\n\r\n", at)
        lines = bytes(held[at:end]).decode("utf-8", "surrogatepass").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size, at = int(fields["Content-Length"]), end + 4
        if not need(size + 4):
            raise ValueError("record content is cut off")
        yield fields, bytes(held[at:at + size])
        at += size + 4


def _unzipped(data: bytes) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or more members."""
    d, view = zlib.decompressobj(31), memoryview(data)
    for i in range(0, len(view), PIECE):
        piece = bytes(view[i:i + PIECE])
        while piece:
            yield d.decompress(piece)
            piece = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, digest, refers_to, bytes, intact) of every record of the archives below path.

    `bytes` and `intact` come from the content of a response; they are null for a revisit.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("bytes", pa.int64()), ("intact", pa.bool_())])
        for b in parts:
            for k in range(b.num_rows):
                rows = []
                for f, body in records(_unzipped(b.column(0)[k].as_buffer())):
                    told, whole = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "response"
                    rows.append((f["WARC-Page-ID"], f["WARC-Target-URI"], f["WARC-Type"], told, f.get("WARC-Refers-To-Page-ID"), len(body) if whole else None,
                                 hashlib.sha256(body).hexdigest() == told if whole else None))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "id string, url string, record_type string, digest string, refers_to string, bytes long, intact boolean")


def resolved(archived: DataFrame) -> DataFrame:
    """Records with the payload size of their original; a revisit without its original or a damaged response keeps a null size."""
    originals = archived.filter("record_type = 'response' and intact").join(
        archived.filter("record_type = 'revisit'").select(F.col("refers_to").alias("id"), "digest").distinct(), ["id", "digest"], "left_semi").groupBy(F.col("id").alias("refers_to"), "digest").agg(
            F.first("bytes").alias("original_bytes"))
    joined = archived.join(originals, ["refers_to", "digest"], "left")
    return joined.select("id", "url", "record_type", "digest", "refers_to", F.coalesce(F.when(F.col("intact"), F.col("bytes")), F.col("original_bytes")).alias("payload_bytes"))


def archive(pages: DataFrame, **names) -> DataFrame:
    """Write archives of all pages to the shared folder, read them back and resolve the revisits."""
    path = folder(pages.sparkSession, "warc")
    write(pages, path, **names)
    return resolved(staged(read(pages.sparkSession, path), "records"))
