"""WARC archives: records as plain ``.warc.gz`` files, and assembly of request, response and metadata into captures.

Writing. Every page gives three records that name each other: a request and a metadata record with
``WARC-Concurrent-To`` set to the id of the response (or revisit) record. Record text is built by built-in functions and
written by Spark's text writer with the record separator as line separator, so files appear through the commit protocol
of the output folder and any file system will do. A file holds at most RECORDS_PER_FILE pages.

Reading. Files are read whole, parsed by Content-Length in a Python worker, one record at a time. Assembly groups records
by the id that they are concurrent to. A capture's row nests its response with the payload, and its first request and
metadata record with their blocks; the aggregates are of bounded size, so a capture with very many metadata records
stays one row. ``side_records`` lists all of them, a row each. Where only digests are asked for, no content travels.

Files are one gzip stream each, not one member a record: Spark has no sink for raw bytes that commits like its text
writer, so readers decompress a file from its start.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, scratch, written

RECORDS_PER_FILE = 2000
EOL = "\r\n"
RECORD_SCHEMA = "record_id string, concurrent_to string, warc_type string, page_id long, target_uri string, refers_to_page long, payload_bytes long, payload_digest string, payload binary, block binary"


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def responses(pages: DataFrame) -> DataFrame:
    """Add _hash, record_type and refers_to: of pages with equal payloads the largest page_id is the response.

    Pages that repeat the largest id with the same payload are responses too. A null id is smaller than any other. The
    table of largest ids covers payloads that occur more than once; it is broadcast where it is counted to be small, else
    joined with salt, as one payload may be very common.
    """
    hashed = pages.withColumn("_hash", F.sha1(payload_of(F.col("html")).cast("binary")))
    most = hashed.groupBy("_hash").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = lookup(hashed, written(most, "warc-last"), ["_hash"], F.coalesce("page_id", F.lit(-1).cast("long")))
    later = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return joined.withColumns({"record_type": F.when(later, "revisit").otherwise("response"), "refers_to": F.when(later, F.col("_last"))}).drop("_last")


def _b32(hex_digest: Column) -> Column:
    """Base32 of a 160-bit digest given in hex: 32 groups of 5 bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, i * 5 + 1, 5), 16, 2), 20, "0") for i in range(8)])
    return F.concat(*[F.substring(alphabet, (F.conv(F.substring(bits, i * 5 + 1, 5), 2, 10).cast("int") + 1), F.lit(1)) for i in range(32)])


def _clean(value: Column) -> Column:
    """A header value: control characters become %20, so that a header is one line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1F\x7F]", "%20")


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1")]
    for name, value in headers:
        parts.append(F.concat(F.lit(f"{EOL}{name}: "), F.lit(value) if isinstance(value, str) else value))
    return F.concat(*parts, F.lit(f"{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL * 2), block)


def record_texts(pages: DataFrame) -> DataFrame:
    """pages with record_type and refers_to -> one text column ``value``: three records of a page after each other."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    tag = F.substring(F.sha1(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.col("_hash")).cast("binary")), 1, 16)
    name = F.concat(F.lit("urn:x-page:"), page, F.lit(":"), tag)
    uri = _clean(F.col("url"))
    body = payload_of(F.col("html"))
    size = F.octet_length(body).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), size, F.lit(EOL * 2))
    date = "2024-01-01T00:00:00Z"
    revisit = F.col("record_type") == "revisit"
    digest = F.concat(F.lit("sha1:"), _b32(F.col("_hash")))
    common = [("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(">"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("X-Payload-Length", size), ("Content-Type", "application/http;msgtype=response")]
    response = _record([("WARC-Type", "response"), *common], F.concat(http, body))
    target = F.concat(F.lit("<urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))
    again = _record([("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", target), *common], http)
    to = F.concat(F.lit("<"), name, F.lit(">"))
    host = F.regexp_extract(uri, r"^[a-zA-Z]+://([^/?#]*)", 1)
    path = F.regexp_replace(uri, r"^[a-zA-Z]+://[^/?#]*", "")
    ask = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL * 2))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(":request>"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", to), ("Content-Type", "application/http;msgtype=request")], ask)
    fields = F.concat(F.lit("payload-length: "), size, F.lit(EOL))
    meta = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(":metadata>"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", to), ("Content-Type", "application/warc-fields")], fields)
    # the writer ends the last record of each row
    return pages.select(F.concat_ws(EOL * 2, request, F.when(revisit, again).otherwise(response), meta).alias("value"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as .warc records in gzip files under path; null urls and texts are empty."""
    texts = record_texts(responses(pages))
    texts.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; raises ValueError on a damaged record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC header ends early")
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC block ends early")
        yield headers, block


_PAGE = re.compile(r"<urn:x-page:(-?\d+)")


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = headers.get("warc-type", "")
    name = headers.get("warc-record-id", "")
    page = _PAGE.match(name)
    refers = _PAGE.match(headers.get("warc-refers-to", ""))
    size = digest = body = None
    if kind in ("response", "resource"):
        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        said = headers.get("warc-payload-digest")
        if said and said.startswith("sha1:") and said != f"sha1:{digest}":
            raise ValueError(f"{name}: the payload does not match its digest")
    elif kind == "revisit":
        size = int(headers["x-payload-length"]) if "x-payload-length" in headers else None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    side = block if payloads and body is None else None
    return (name, headers.get("warc-concurrent-to"), kind, int(page[1]) if page else None, headers.get("warc-target-uri"), int(refers[1]) if refers else None, size, digest, body if payloads else None, side)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the .warc or gzipped files under path; payloads=False leaves the columns payload and block null.

    Payload: the entity of a response, and a resource record as a whole. Block: that of every other record. A revisit has the digest and, where its writer noted it, the length of the payload that it refers to.
    """
    schema = RECORD_SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                stream = io.BytesIO(raw)
                opened = gzip.GzipFile(fileobj=stream) if raw[:2] == b"\x1f\x8b" else stream
                rows: list[tuple] = []
                held = 0
                for headers, block in parse_warc(io.BufferedReader(opened, 1 << 20) if opened is not stream else stream):
                    rows.append(_row(headers, block, payloads))
                    held += len(block) if payloads else 200
                    if held > 4_000_000:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, schema)


MAIN = ("response", "revisit", "resource")


def _capture() -> Column:
    return F.when(F.col("warc_type").isin(*MAIN), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the record that others are concurrent to, with its request and metadata.

    response holds the payload where it was read, request and metadata their blocks. A capture whose id occurs several
    times (repeated rows of a page) is one row with ``copies``; of several requests or metadata records the one with the
    smallest id is nested, their numbers are given, and ``side_records`` lists them all. Requests and metadata records
    whose capture is missing make a row with a null response.
    """
    main = F.col("warc_type").isin(*MAIN)
    side = F.struct("record_id", "target_uri", "block")
    return records.groupBy(_capture().alias("capture_id")).agg(
        F.min(F.when(main, F.struct("record_id", "warc_type", "page_id", "target_uri", "refers_to_page", "payload_bytes", "payload_digest", "payload"))).alias("response"),
        F.min(F.when(F.col("warc_type") == "request", side)).alias("request"),
        F.min(F.when(F.col("warc_type") == "metadata", side)).alias("metadata"),
        F.sum(main.cast("int")).alias("copies"),
        F.sum((F.col("warc_type") == "request").cast("int")).alias("requests"),
        F.sum((F.col("warc_type") == "metadata").cast("int")).alias("metadatas"),
    )


def side_records(records: DataFrame) -> DataFrame:
    """capture_id, record_id, warc_type, target_uri, block of every record that is no capture of its own; no shuffle."""
    return records.where(~F.col("warc_type").isin(*MAIN)).select(_capture().alias("capture_id"), "record_id", "warc_type", "target_uri", "block")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages, read them back, assemble captures: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null texts are empty payloads. Repeated rows give a row each. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    captures = assemble(read_warc(spark, path, payloads=False)).where(F.col("response").isNotNull())
    rows = captures.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return rows.select(F.col("response.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"), F.col("response.refers_to_page").alias("refers_to"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))


#: The rows of archive_round_trip in DuckDB: what an archive must give back.
WARC_SQL = r"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
most AS (SELECT h, max(page_id) AS last FROM hashed GROUP BY h HAVING count(*) > 1),
bits AS (
  SELECT page_id, strlen(body) AS n, last,
         array_to_string(list_transform(range(0, 8), lambda i: lpad(bin(CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)), 20, '0')), '') AS b
  FROM hashed LEFT JOIN most USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(i * 5 + j + 1 AS BIGINT), 1) AS BIGINT) * (16 >> CAST(j AS BIGINT)))) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN last IS NOT NULL AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to, true AS has_request, true AS has_metadata
FROM bits
"""
