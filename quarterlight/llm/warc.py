"""Web archives: request, response (or revisit) and metadata records of each capture, written as WARC/1.1 and read back.

Every record is a gzip member of its own, so tools can seek to it. Members are
written by Spark's text writer, whose tasks are committed whole: a lost executor
leaves no half archive, and any file system will do. A member's last byte is the
highest of its length, zero below 16 MB, and is left to the writer as its line
separator; a longer record has an empty member after it. Files are bounded by
bytes, and readers hold one record at a time beside a file's compressed bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm.common import new_path, save, small, table

END = "\r\n"
#: Captures in a file at most, payload bytes from which a capture is a large one, and bytes of a file of large ones (or one capture).
CAPTURES, LARGE, FILE_BYTES = 256, 1 << 20, 256 << 20
#: Parts that the captures of one payload are dealt over, where they are shuffled.
SALTS = 16
DATE = "2000-01-01T00:00:00Z"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 160 bits given in hex: eight digits for each ten."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _bytes(text: Column) -> Column:
    return F.octet_length(text)


def _record(kind: str, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last two line ends. A header with a null value is left out."""
    lines = [F.concat(F.lit("WARC/1.1" + END + f"WARC-Type: {kind}" + END + "WARC-Record-ID: "), ident, F.lit(END + f"WARC-Date: {DATE}" + END))]
    lines += [F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(END)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), _bytes(block).cast("string"), F.lit(END + END), block)


def numbered(pages: DataFrame) -> DataFrame:
    """_row, page_id, _url, _payload, _digest and _bytes of each row of pages, saved: a capture is known by its row, whatever its page_id."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("_url"), payload.alias("_payload"))
    return save(rows.withColumn("_digest", base32(F.sha1(F.col("_payload").cast("binary")))).withColumn("_bytes", _bytes(F.col("_payload")).cast("long")), "captures")


def with_original(rows: DataFrame, least: int = 0) -> DataFrame:
    """rows (numbered) with _original, the page_id and row of the capture with an equal payload that they revisit; null where they are that one, or have under `least` bytes.

    Of equal payloads that with the largest page_id is the original, nulls being
    the smallest, and of rows with that page_id the last. Originals are found by
    a maximum that is taken before the shuffle, from narrow columns; those of
    payloads that occur twice are broadcast if they are few, or else meet the
    rows dealt over SALTS parts, so a payload that a third of the pages share
    isn't one task's.
    """
    own = F.struct("page_id", "_row")
    twice = save(rows.filter(F.col("_bytes") >= least).groupBy("_digest", "_bytes").agg(F.max(own).alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "originals")
    few = small(twice)
    if few is not twice:
        met = rows.join(few, ["_digest", "_bytes"], "left")
    else:
        dealt = twice.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(dealt, ["_digest", "_bytes", "_salt"], "left").drop("_salt")
    return met.withColumn("_original", F.when(F.col("_last._row") != F.col("_row"), F.col("_last"))).drop("_last")


def _ident(kind: str, page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit("-"), row.cast("string"), F.lit(f":{kind}>"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's records as gzip members, without the last byte, which is zero."""

    def member(data: bytes) -> bytes:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        return press.compress(data) + press.flush()

    for batch in batches:
        out = []
        for records in zip(*(c.to_pylist() for c in batch.columns)):
            parts = []
            for record in records:
                parts.append(member(record.encode("utf-8", "surrogatepass") + b"\r\n\r\n"))
                if parts[-1][-1]:
                    parts.append(member(b""))
            out.append(b"".join(parts)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes the three records of each row of pages: page_id, url, html (null: empty), other columns aside.

    Of rows with equal payloads of `least` bytes or more, that with the largest
    page_id is a response and the others revisit it; null page_ids are the
    smallest, and of repeated ones the last row counts. Every row is a capture
    of its own. Line ends in a url become spaces. No rows give no records.
    """
    rows = with_original(numbered(pages), least)
    ident = lambda kind: _ident(kind, F.col("page_id"), F.col("_row"))
    uri, digest, main = F.col("_url"), F.concat(F.lit("sha1:"), F.col("_digest")), ident("response")
    host = F.regexp_extract("_url", r"://([^/?#]*)", 1)
    about = [("WARC-Target-URI", uri)]
    http = F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + END)
    request = _record("request", ident("request"), [*about, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END + "Host: "), host, F.lit(END + END)))
    response = _record("response", main, [*about, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("_payload")))
    revisit = _record("revisit", main, [*about, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _ident("response", F.col("_original.page_id"), F.col("_original._row"))), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    metadata = _record("metadata", ident("metadata"), [*about, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), page, F.lit(END + "payloadBytes: "), F.col("_bytes").cast("string"), F.lit(END)))
    both = F.when(F.col("_original").isNull(), response).otherwise(revisit)

    def write(part: DataFrame, captures: int) -> None:
        members = part.select(request.alias("request"), both.alias("main"), metadata.alias("metadata")).mapInArrow(_members, "value binary")
        members.select(F.col("value").cast("string").alias("value")).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", captures).text(path)

    write(rows.filter(F.col("_bytes") < LARGE), CAPTURES)
    largest = rows.filter(F.col("_bytes") >= LARGE).agg(F.max("_bytes")).first()[0]
    if largest:
        write(rows.filter(F.col("_bytes") >= LARGE), max(1, FILE_BYTES // largest))


RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("fields", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = "record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, fields string, payload_bytes long, payload binary"


def members(data: memoryview) -> Iterator[bytes]:
    """What each gzip member of a file holds, one after the other."""
    while len(data):
        press = zlib.decompressobj(31)
        found = press.decompress(data)
        if not press.eof:
            raise ValueError("a gzip member is cut off")
        data = data[len(data) - len(press.unused_data) :]
        if found:
            yield found


def _parse(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        head = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:head].decode().split(END)[1:])
        block, size = head + 4, int(headers["Content-Length"])
        body = data[block : block + size]
        at = block + size + 4
        kind, digest, payload, fields = headers["WARC-Type"], headers.get("WARC-Payload-Digest"), None, None
        if kind == "response":
            payload = body[body.index(b"\r\n\r\n") + 4 :]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
                raise ValueError(f"digest of {headers['WARC-Record-ID']}")
        elif kind == "revisit":
            digest = digest.removeprefix("sha1:")
        else:
            fields = body.decode()
        yield (headers["WARC-Record-ID"], kind, headers.get("WARC-Target-URI"), headers.get("WARC-Concurrent-To"), headers.get("WARC-Refers-To"), digest, fields, None if payload is None else len(payload), payload)


def read_records(spark: SparkSession, path: str, payload: bool = True, lot_bytes: int = 8 << 20) -> DataFrame:
    """One row for each record of the archives at path, response payloads and their SHA-1 checked against the header.

    Records leave a task in lots of about lot_bytes (a longer record alone);
    without payload its column is null.
    """

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in members(memoryview(content.as_buffer())):
                    for record in _parse(data):
                        rows.append(record if payload else (*record[:-1], None))
                        size += 500 + len(rows[-1][-1] or b"")
                        if size > lot_bytes:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture (the main record's id), main, request, metadata (null where missing).

    Records meet by the identifier that they are concurrent to, a main record by
    its own. Of repeated records of one kind for a capture, that with the
    smallest id stays. A request or metadata record without its main record
    gives a row with a null main. records may lack columns that aren't wanted,
    such as the payload.
    """
    kind = F.when(F.col("type").isin("response", "revisit"), "main").otherwise(F.col("type"))
    content = F.struct(*[c for c in RECORD.names if c in records.columns and c != "concurrent_to"])
    of = lambda k: F.min_by(F.when(kind == k, content), F.when(kind == k, F.col("record_id"))).alias(k)
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(of("main"), of("request"), of("metadata"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = assemble(read_records(spark, path, payload=False).drop("payload"))
    number = lambda field: F.regexp_extract("metadata.fields", rf"{field}: (-?\d+)", 1).try_cast("long")
    return captures.select(
        number("pageId").alias("page_id"), F.coalesce("main.payload_bytes", number("payloadBytes")).alias("payload_bytes"),
        F.col("main.digest").alias("payload_digest"), F.col("main.type").alias("record_type"),
        F.regexp_extract("main.refers_to", r"capture:(-?\d+)-", 1).try_cast("long").alias("refers_to"),
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest
  FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(8), lambda i: (
    array_to_string(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * i, 5))::INTEGER >> (15 - 5 * j)) & 31)::INTEGER, 1)), ''))), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d
"""
