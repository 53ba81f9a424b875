"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: a request, a response (or a revisit of an earlier
response with the same payload) and metadata.  Request and metadata name the
response in ``WARC-Concurrent-To``; a revisit names what it revisits in
``WARC-Refers-To``.  Archives are written by Spark's text writer, whose line
separator is the two line ends that close a record, and read as binary files, so
both work on any file system that Spark knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

CRLF = "\r\n"
#: Bytes of payload that one archive file aims at.
FILE_BYTES = 16 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(payload.cast("binary"))
    letters = []
    for at in range(0, 40, 5):  # five hexadecimal digits are four of base 32
        number = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column, url: Column, digest: Column, kind: str) -> Column:
    hexes = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), url, digest, F.lit(kind)))
    parts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, url: Column, block: Column, media: str, *more: tuple[str, Column]) -> Column:
    """The text of one record without the line ends that close it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url)]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in more]
    lines += [F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def plan_captures(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, first)`` for each page.

    ``first`` holds the smallest page_id (nulls last) with an equal payload and its
    url, where the payload has ``min_revisit_bytes`` at least, else the page's own.
    They are found from ids and digests alone, aggregated before they are shuffled.
    Null urls and payloads count as empty.
    """
    base = pages.select(
        F.col("page_id").cast("long"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    own = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url")
    least = cut(base.groupBy("payload_digest").agg(F.min(own).alias("least")))
    chosen = F.when(F.col("payload_bytes") >= min_revisit_bytes, F.col("least")).otherwise(own)
    return base.join(least, "payload_digest").withColumn("first", chosen).drop("least")


def write_archives(captures: DataFrame, path: str) -> None:
    """Write three records per capture below ``path``, in gzip files of about 16 MB of payload.

    A file is closed after as many captures as make up ``FILE_BYTES`` at their mean
    size.  Rows that repeat a page_id, url and payload are the same capture, written
    as often; a null page_id is written as an empty field.
    """
    url, page = F.col("url"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (url == F.col("first.url"))
    response_id, request_id, metadata_id = (_record_id(F.col("page_id"), url, F.col("payload_digest"), k) for k in ("response", "request", "metadata"))
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("invalid"))
    request = F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    concurrent = ("WARC-Concurrent-To", response_id)
    http = "application/http; msgtype="
    response = F.when(is_first, _record("response", response_id, url, F.concat(head, F.col("payload")), http + "response", digest)).otherwise(
        _record("revisit", response_id, url, head, http + "response", digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", _record_id(F.col("first.page_id"), F.col("first.url"), F.col("payload_digest"), "response")))
    )
    records = F.array(
        _record("request", request_id, url, request, http + "request", concurrent),
        response,
        _record("metadata", metadata_id, url, F.concat(F.lit("page_id: "), page, F.lit(CRLF)), "application/warc-fields", concurrent),
    )
    sized = captures.agg(F.avg("payload_bytes")).first()[0] or 0
    per_file = max(1, int(FILE_BYTES // (sized + 2000))) * 3
    captures.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record of an archive.

    Blocks are taken by Content-Length, so a block may hold anything.  A truncated
    last record ends the archive.
    """
    at = 0
    while (at := content.find(b"WARC/1.", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, int(fields.get("content-length", 0))
        if start + length > len(content):
            return
        yield fields, content[start : start + length]
        at = start + length


RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, url string, declared_digest string, http_bytes long, payload binary, payload_bytes long, digest string, fields string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.

    ``payload`` is the HTTP body of a response; ``digest`` is computed from it, while
    ``declared_digest`` and ``http_bytes`` are what headers say.  An archive file is
    read whole by one task, so files should stay far below memory.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"http_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                raw = content.as_py()
                for fields, block in parse_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind, body, size, digest = fields.get("warc-type"), None, None, None
                    if kind in ("response", "revisit"):
                        head, _, rest = block.partition(b"\r\n\r\n")
                        sizes = [x[15:] for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"]
                        size = int(sizes[0]) if sizes else None
                        if kind == "response":
                            body, digest = rest, base64.b32encode(hashlib.sha1(rest).digest()).decode()
                    declared = fields.get("warc-payload-digest")
                    text = block.decode("utf-8", "replace") if kind == "metadata" else None
                    rows.append((kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), declared and declared.removeprefix("sha1:"), size, body, None if body is None else len(body), digest, text))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: ``(capture_id, response, request, metadata, refers)``.

    A request or metadata record joins the response or revisit that it names in
    ``concurrent_to``; where several do, the one with the smallest record id counts.
    ``refers`` is the metadata of the capture that a revisit refers to.  Records
    that name no capture of these archives are left out; a capture without request
    or metadata has null there.  Without ``with_payload`` responses hold their digest
    and size but not the payload, which then is not shuffled.
    """
    body = ["record_type", "record_id", "url", "declared_digest", "digest", "http_bytes", "refers_to", "payload_bytes", *(["payload"] if with_payload else [])]
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct(*body).alias("response")
    )
    beside = records.where(F.col("record_type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        *[F.min(F.when(F.col("record_type") == k, F.struct("record_id", "url", "fields"))).alias(k) for k in ("request", "metadata")]
    )
    beside = cut(beside)
    named = beside.select(F.col("capture_id").alias("refers_id"), F.col("metadata").alias("refers"))
    nested = main.join(beside, "capture_id", "left")
    return nested.join(named, F.col("response.refers_to") == named["refers_id"], "left").drop("refers_id")


def page_of(metadata: Column) -> Column:
    """The page_id that a metadata record holds."""
    return F.nullif(F.regexp_extract(metadata.getField("fields"), r"page_id: (-?\d+)", 1), F.lit("")).cast("long")


def capture_digests(captures: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of nested captures."""
    r = F.col("response")
    return captures.select(
        page_of(F.col("metadata")).alias("page_id"),
        F.coalesce(r["payload_bytes"], r["http_bytes"]).alias("payload_bytes"),
        F.coalesce(r["digest"], r["declared_digest"]).alias("payload_digest"),
        r["record_type"].alias("record_type"),
        page_of(F.col("refers")).alias("refers_to"),
    )
