"""WARC archives: records written by Spark's text sink, read back and assembled into captures.

Every page is written as three records: a response (or a revisit, where an equal payload is stored elsewhere), a request and a
metadata record that name the first through WARC-Concurrent-To. The reader parses whole archives by Content-Length and
assembles the transaction by joins on those identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, staged

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(column):
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 40 bits at a time."""
    digits = F.sha1(F.encode(column, "UTF-8"))
    parts = [F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    return F.concat(*(F.substring(F.lit(ALPHABET), (F.shiftright(p, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for p in parts for j in range(8)))


def _record(kind, ident, uri, concurrent, extra, content_type, block):
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), ident, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri]
    if concurrent is not None:
        head += [F.lit("\r\nWARC-Concurrent-To: "), concurrent]
    return F.concat(*head, *extra, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip", pages_per_file: int = 1000, bytes_per_file: int = 1 << 28) -> None:
    """Archive every row of `pages` (page_id, url, html) under `path`, as gzipped WARC files of at most `pages_per_file` pages and
    `bytes_per_file` bytes before compression; a page beyond that has a file of its own.

    Pages of up to bytes_per_file / pages_per_file bytes fill files by number. Larger ones go by size class: class c holds sizes up to
    2^c times that and so many times fewer pages a file, dealt by their number in the source's partition, so no sizes are summed up.

    Of pages with equal payloads of at least `least_bytes` bytes the one with the largest page_id is a response, the others are
    revisits of it; of rows that share that page_id, one. Null html is an empty payload; null urls are empty; white space and control characters of urls are percent-encoded.
    """
    page = pages.select(
        F.col("page_id").cast("long"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("row", F.monotonically_increasing_id())
    # An upper bound of a transaction's bytes: headers beside the url take less than 2048.
    size, small = F.octet_length("html").cast("long") + 4 * F.octet_length("uri") + 2048, max(2048, bytes_per_file // pages_per_file)
    large = not page.where(size > small).isEmpty()
    page = page.withColumn("digest", base32_sha1(F.col("html"))).withColumn("ident", F.format_string("<urn:capture:%s:%d>", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "row"))
    kept = page.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "ident")).alias("last"), F.count("*").alias("k")).where("k > 1").select("digest", "last")
    page = page.join(kept, "digest", "left")
    again = F.coalesce((F.octet_length("html") >= least_bytes) & (F.col("ident") != F.col("last.ident")), F.lit(False))
    # Rows without a repeated payload have no `last`.
    again = again & F.col("last").isNotNull()
    digest = [F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest")]
    refers = F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), F.col("last.ident"))).otherwise("")
    http = F.concat(F.lit(HTTP), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    own = _record(F.when(again, F.lit("revisit")).otherwise("response"), F.col("ident"), F.col("uri"), None, [*digest, refers], "application/http; msgtype=response", F.when(again, http).otherwise(F.concat(http, F.col("html"))))
    of = lambda what: F.concat(F.expr("substring(ident, 1, length(ident) - 1)"), F.lit(f":{what}>"))
    request = _record(F.lit("request"), of("request"), F.col("uri"), F.col("ident"), [], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record(F.lit("metadata"), of("metadata"), F.col("uri"), F.col("ident"), [], "application/warc-fields", F.concat(F.lit("payloadBytes: "), F.octet_length("html").cast("string"), F.lit("\r\n")))
    level = F.ceil(F.log2(size / small)).cast("int")
    pages_each = F.greatest(F.lit(1), F.floor(F.lit(bytes_per_file) / (small * F.pow(F.lit(2.0), level)))).cast("long")
    number = F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / pages_each)
    archive = F.concat_ws("-", level, F.shiftright("row", 33), number)
    value, limit = F.concat_ws("\r\n\r\n", own, request, metadata).alias("value"), max(1, min(pages_per_file, bytes_per_file // small))

    def write(rows: DataFrame, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).option("maxRecordsPerFile", limit).option("lineSep", "\r\n\r\n").option("compression", compression).text(path)

    write(page.where(size <= small).select(value))
    if large:
        write(page.where(size > small).select(value, archive.alias("archive")), "archive")


def parse_archive(content: bytes):
    """(headers, block) of each record of one archive, plain or in any number of gzip members, unpacked as it is read."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, found, value = line.decode("utf-8", "replace").partition(": ")
            if found:
                headers[name] = value
        yield headers, stream.read(int(headers.get("Content-Length", 0)))


FIELDS = {"kind": "WARC-Type", "id": "WARC-Record-ID", "concurrent_to": "WARC-Concurrent-To", "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI", "date": "WARC-Date", "declared": "WARC-Payload-Digest"}
RECORDS = ", ".join(f"{k} string" for k in FIELDS) + ", http string, fields string, payload binary, payload_bytes long, payload_digest string"


def _records(payloads: bool):
    def run(batches):
        for pdf in batches:
            for content in pdf.content:
                rows = []
                for headers, block in parse_archive(content):
                    row = {k: headers.get(h) for k, h in FIELDS.items()} | dict.fromkeys(("http", "fields", "payload", "payload_bytes", "payload_digest"))
                    if row["kind"] in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        row["http"] = http.decode("utf-8", "replace")
                        if row["kind"] == "response":
                            row |= {"payload": payload if payloads else None, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
                    elif row["kind"] == "metadata":
                        row["fields"] = block.decode("utf-8", "replace")
                    else:
                        row["http"] = block.decode("utf-8", "replace")
                    rows.append(row)
                    if len(rows) == 500:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return run


def read_captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture of the archives under `path`: id, kind, uri, date, refers_to, response, request, metadata and the
    response that a revisit refers to. Files are read whole, those of `write_warc` have at most `bytes_per_file` bytes. A capture without request or metadata
    record has null there; request and metadata records without a capture are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    records = files.mapInPandas(_records(payloads), RECORDS)
    records = staged(records, "records") if not payloads else records
    captures = records.where("kind in ('response', 'revisit')").select("id", "kind", "uri", "date", "refers_to", F.struct("http", "declared", "payload", "payload_bytes", "payload_digest").alias("response"))
    requests = records.where("kind = 'request'").select(F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("id"), "http").alias("request"))
    metadata = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("id"), "fields").alias("metadata"))
    originals = records.where("kind = 'response'").select(F.col("id").alias("refers_to"), F.struct("uri", "payload_bytes", "payload_digest").alias("original"))
    return captures.join(requests, "id", "left").join(metadata, "id", "left").join(originals, "refers_to", "left")


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write `pages`, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests are those of the payload as stored; a revisit has those of the response that it refers to. Repeated rows are
    captures of their own. Columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, least_bytes)
    c = read_captures(spark, path, payloads=False)
    page = lambda ident: F.regexp_extract(ident, r"^<urn:capture:(-?[0-9]+):", 1).try_cast("long")
    return c.select(
        page(F.col("id")).alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
        F.col("uri").alias("target_uri"),
        F.col("request").isNotNull().alias("has_request"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )
