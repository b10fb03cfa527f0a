"""WARC archives: segmented writing, and reading with segment reassembly.

Writing: one record per page. A response's block is an HTTP message in chunked
transfer framing; a block over ``segment_bytes`` is cut into a first segment
and ``continuation`` records that name it in ``WARC-Segment-Origin-ID``, the
last with ``WARC-Segment-Total-Length``. Spark's text writer commits the
archives (gzip, at most ``records_per_file`` records each) in the shared folder.

Reading: each archive is parsed as a stream by Content-Length. Whole records
are decoded in place; only segments shuffle, by origin identifier, are sorted
by segment number in a streaming pass (memory: one record), checked against
the total length, and their chunked framing is decoded.

Edge cases: a null html is an empty payload; a null url has no target URI; a
null page_id is smaller than any other. Repeated rows are records of their own,
and all rows that share the largest page_id of an equal payload are responses.
A broken record (missing segment, wrong length or framing) keeps its row with a
null payload and the reason in ``error``. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import emit, key_extreme, salted, scratch_path, table

DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("refers_to", pa.int64()),
    ("digest", pa.string()), ("full_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])
RECORD_DDL = ("record_id string, record_type string, page_id long, url string, segment int, origin string, total long, "
              "refers_to long, digest string, full_bytes long, payload binary, error string")


def plan_records(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Pages with payload_bytes, digest (SHA-1, hex) and, for a revisit, refers_to.

    Equal payloads are found by digest and length on slim rows, salted by page,
    and only the groups of two or more return to the pages; while that table is
    under Spark's broadcast threshold, no html shuffles.
    """
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    full = salted(full.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))}), F.col("page_id"))
    groups = key_extreme(full.where(F.col("payload_bytes") >= revisit_bytes), ["digest", "payload_bytes"], "page_id", F.col("page_id")).where("_n > 1")
    joined = full.join(table(groups, "warc-groups"), ["digest", "payload_bytes", "_salt"], "left")
    older = F.col("_n").isNotNull() & F.col("_extreme").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_extreme"))
    return joined.select("page_id", "url", "html", "payload_bytes", "digest", F.when(older, F.col("_extreme")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16384, chunk_bytes: int = 8192,
                   revisit_bytes: int = 1000, records_per_file: int = 8192) -> None:
    """Writes the archives of ``pages`` (page_id, url, html) under ``path``."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (r for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in page_records(*row, segment_bytes, chunk_bytes))
        yield from emit(((r,) for r in made), pa.schema([("value", pa.binary())]), lambda r: len(r[0]))

    rows = plan_records(pages, revisit_bytes).select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    (rows.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), chunk_bytes) if (c := payload[i : i + chunk_bytes])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """Decodes chunked framing; ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def page_records(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None,
                 segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the CRLF CRLF that ends each."""
    context = TaskContext.get()
    page_records.made += 1
    name = f"{page_id}/{context.partitionId() if context else 0}/{page_records.made}"

    def identifier(segment: int) -> str:
        return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{name}/{segment}'.encode()).digest())}>"

    common = [("WARC-Date", DATE)]
    if url is not None:
        common.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        common.append(("Page-ID", str(page_id)))
    payload_digest = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", identifier(1)), *common, payload_digest,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers_to))], block)
        return
    block = HTTP_HEAD + chunked(html, chunk_bytes)
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        more = [("WARC-Segment-Number", str(n))] if len(cuts) > 1 else []
        more += [("WARC-Segment-Origin-ID", identifier(1))] if n > 1 else [payload_digest]
        more += [("WARC-Segment-Total-Length", str(len(block)))] if n == len(cuts) > 1 else []
        yield _record([("WARC-Type", "continuation" if n > 1 else "response"), ("WARC-Record-ID", identifier(n)), *common, *more], block[at : at + segment_bytes])


page_records.made = 0


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def parse(stream) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (lower-case names) and block of each record; None for a block cut short."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            yield {"error": "no WARC version line"}, None
            return
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield fields | {"error": "no content length"}, None
            return
        block = stream.read(int(length))
        yield fields, block if len(block) == int(length) else None


def _row(fields: dict[str, str], block: bytes | None) -> tuple:
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    kind, segment = fields.get("warc-type"), number("warc-segment-number")
    digest = fields.get("warc-payload-digest", "")
    error = fields.get("error") or (None if block is not None else "record is cut short")
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    full = int(m[1]) if kind == "revisit" and block and (m := re.search(rb"(?im)^content-length: *(\d+)\r?$", block)) else None
    row = (fields.get("warc-record-id"), kind, number("page-id"), fields.get("warc-target-uri"), segment, fields.get("warc-segment-origin-id"),
           number("warc-segment-total-length"), number("refers-to-page-id"), digest, full, block, error)
    return row if segment is not None else _decoded(row)


def _decoded(row: tuple) -> tuple:
    """Takes the payload out of a whole record's HTTP message."""
    *head, block, error = row
    if block is None or error or head[1] == "revisit":
        return *head, None, error
    http, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = dechunk(body) if re.search(rb"(?im)^transfer-encoding: *chunked\r?$", http) else body
    except ValueError as e:
        return *head, None, str(e)
    return *head, payload, None


def _parsed(segments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    raw = content.as_buffer()
                    stream = io.BufferedReader(pa.BufferReader(raw)) if bytes(raw[:2]) != b"\x1f\x8b" else gzip.GzipFile(fileobj=pa.BufferReader(raw))
                    for fields, block in parse(stream):
                        if ("warc-segment-number" in fields) == segments:
                            yield _row(fields, block)

        yield from emit(rows(), RECORD, lambda r: len(r[10] or b""))

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reassembles runs of equal ``origin``, sorted by segment."""
    def rows():
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][5] != row[5]:
                    yield _whole(held)
                    held = []
                held.append(row)
        if held:
            yield _whole(held)

    yield from emit(rows(), RECORD, lambda r: len(r[10] or b""))


def _whole(parts: list[tuple]) -> tuple:
    first, total = parts[0], parts[-1][6]
    error = next((p[11] for p in parts if p[11]), None)
    if [p[4] for p in parts] != list(range(1, len(parts) + 1)):
        error = error or "a segment is missing or repeated"
    block = b"".join(p[10] or b"" for p in parts)
    if total is None or len(block) != total:
        error = error or f"total length is {total}, the segments have {len(block)}"
    return _decoded((*first[:10], None if error else block, error))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``, segments joined: record_id, record_type,
    page_id, url, refers_to, digest, full_bytes (both of the full payload), payload, error."""
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_parsed(False), RECORD_DDL)
    parts = files.mapInArrow(_parsed(True), RECORD_DDL).withColumn("origin", F.coalesce("origin", "record_id"))
    joined = parts.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_joined, RECORD_DDL)
    rows = whole.unionByName(joined)
    return rows.withColumns({"digest": F.coalesce(F.sha1("payload"), "digest"), "full_bytes": F.coalesce(F.octet_length("payload").cast("long"), "full_bytes")}).drop("segment", "origin", "total")


def op1(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "error")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d,
             max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM m
"""
