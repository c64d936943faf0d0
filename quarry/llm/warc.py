"""WARC archives of captured pages: writing, reading, and assembling transactions.

Each page becomes a response (or revisit), a request and a metadata record.  The two latter name
the first in ``WARC-Concurrent-To``; reading joins the three through that identifier and gives one
nested row for each capture.  The archives are read once and their records shuffled once; payloads
travel only where they are asked for.

The archives are gzip files of records that end with two line ends.  Spark's own text writer makes
them (the record separator is its line separator), so they can lie in any store and a repeated task
does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in an archive file.
RECORDS_PER_FILE = 6000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hex digits: five of them are four base32 digits."""
    digest = F.sha1(payload)
    digits = []
    for k in range(8):
        part = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)), F.lit(">"))


def records(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Text of three records for every row ``page_id, url, html``: ``capture`` (kind of the first), ``record``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest
    ``page_id`` is a response and the others revisit it; all smaller ones are responses.  Null html is an
    empty payload, a null url an empty target, a null page_id is last among equals.  Rows that repeat a
    ``page_id`` and payload: one is the response, the rest revisit it (``_n`` tells them apart).

    Payloads are compared by SHA-1, in a narrow table; only first pages of repeated payloads are joined back.
    """
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")  # noqa: E731  no header injection
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", safe(F.col("url")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), base32_sha1(html.cast("binary")).alias("digest"))
    # first pages of repeated payloads, and rows that repeat page and payload: narrow tables, usually tiny
    first, _ = common.sized(
        base.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("_digest"), "first_id"), "warc-first")
    again, n_again = common.sized(base.groupBy("page_id", "digest").count().where("count > 1").select(F.col("page_id").alias("_again"), F.col("digest").alias("_again_digest")), "warc-again")
    rows = base.join(first, F.col("digest") == F.col("_digest"), "left")
    if n_again:
        rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_again")) & (F.col("digest") == F.col("_again_digest")), "left")
        number = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) - 1
        rows = rows.where("_again_digest is null").withColumn("_n", F.lit(0)).unionByName(rows.where("_again_digest is not null").withColumn("_n", number))
    else:
        rows = rows.withColumn("_n", F.lit(0))
    leads = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("_n") == 0)
    kind = F.when(F.col("first_id").isNull() | leads, "response").otherwise("revisit")
    rows = rows.withColumn("kind", kind)
    own = _uuid(F.lit("capture"), F.col("page_id").cast("string"), F.col("digest"), F.col("_n").cast("string"))
    target = _uuid(F.lit("capture"), F.col("first_id").cast("string"), F.col("digest"), F.lit("0"))

    def record(type_: Column, id_: Column, headers: list[tuple[str, Column]], media: str, block: Column) -> Column:
        lines = [F.lit("WARC/1.1\r\nWARC-Type: "), type_, F.lit("\r\nWARC-Record-ID: "), id_, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url")]
        for name, value in headers:
            lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
        return F.concat(*lines, F.lit(f"\r\nContent-Type: {media}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)

    is_revisit = F.col("kind") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END), F.when(is_revisit, "").otherwise(F.col("html")))
    name = F.col("page_id").cast("string")
    made = F.array(
        record(F.col("kind"), own, [
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(is_revisit, target)),
            ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ], "application/http; msgtype=response", http),
        record(F.lit("request"), _uuid(F.lit("request"), name, F.col("digest"), F.col("_n").cast("string")), [("WARC-Concurrent-To", own)], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))),
        record(F.lit("metadata"), _uuid(F.lit("metadata"), name, F.col("digest"), F.col("_n").cast("string")), [("WARC-Concurrent-To", own)], "application/warc-fields", F.concat(F.coalesce(F.concat(F.lit("page-id: "), name, F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("n_bytes").cast("string"), F.lit("\r\n"))),
    )
    return rows.select(F.explode(made).alias("record"))


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the archives; files are cut after ``records_per_file`` records, so a reader's task stays small."""
    out = records(pages, min_revisit_bytes)
    out.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


_FIELD = re.compile(rb"([^:\r\n]+): *([^\r\n]*)")


def inflated(data: bytes, step: int = 1_000_000):
    """The content of a gzip file of any number of members, in parts."""
    view, at, pending, unzip = memoryview(data), 0, b"", zlib.decompressobj(31)
    while True:
        if not pending:
            if at >= len(view):
                return
            pending = view[at : at + step]
            at += step
        yield unzip.decompress(pending)
        pending = b""
        if unzip.eof:
            pending, unzip = unzip.unused_data, zlib.decompressobj(31)


def parse_archive(data: bytes):
    """Records ``(headers, block)`` of an archive, one at a time; lengths come from Content-Length alone."""
    parts, rest, at = inflated(data), bytearray(), 0

    def more() -> bool:
        nonlocal rest, at
        part = next(parts, None)
        if part is None:
            return False
        del rest[:at]
        at = 0
        rest += part
        return True

    while True:
        while (end := rest.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        headers = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(bytes(rest[at:end]))}
        begin, size = end + 4 - at, int(headers["content-length"])
        while len(rest) < at + begin + size + 4 and more():
            pass
        yield headers, bytes(rest[at + begin : at + begin + size])
        at += begin + size + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records: ``type, record_id, concurrent_to, refers_to, uri, digest, block, payload, payload_bytes, payload_digest``.

    ``payload`` is the HTTP body of a response (null if ``payloads`` is off: the bytes then stay in the task);
    ``payload_digest`` is recomputed from it (from the header for a revisit, whose body is elsewhere), as is
    ``payload_bytes``.  ``block`` is null for responses.  Blocks of any length and bytes are taken, empty ones too;
    a repeated record gives a row each; headers that are missing are null; an empty folder gives no rows.
    """
    names = "type record_id concurrent_to refers_to uri digest".split()
    schema = ", ".join(f"{n} string" for n in names) + ", block binary, payload binary, payload_bytes long, payload_digest string"

    def scan(batches):
        rows: list[tuple] = []
        size = 0

        def out():
            kinds = [pa.string()] * 6 + [pa.binary(), pa.binary(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, "block", "payload", "payload_bytes", "payload_digest"])

        for batch in batches:
            for data in batch.column("content"):
                for h, block in parse_archive(data.as_buffer()):
                    type_, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    payload = n_bytes = found = None
                    if type_ in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        if type_ == "response":
                            payload, n_bytes = body, len(body)
                            found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        else:
                            told = re.search(rb"Content-Length: (\d+)", head)
                            n_bytes, found = int(told[1]) if told else None, digest
                    rows.append((type_, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, None if type_ == "response" else block, payload if payloads else None, n_bytes, found))
                    size += len(block) if payloads or type_ != "response" else 200
                    if size > 4_000_000:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(scan, schema)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``record_id, response, request, metadata`` (structs; null where a record is missing).

    Requests and metadata meet their response or revisit through ``WARC-Concurrent-To``, in one shuffle on the
    identifier that all three share.  Of several partners of one kind the one with the smallest record id counts,
    and of captures that repeat a record id the smallest, so partners never multiply rows; partners without a
    capture and records without an id are left out.  An empty table gives an empty table.
    """
    main = F.col("type").isin("response", "revisit")
    side = lambda kind, *cols: F.min(F.when(F.col("type") == kind, F.struct("record_id", *cols))).alias(kind)
    shared = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    return (
        records.withColumn("_capture", shared).where("_capture is not null").groupBy(F.col("_capture").alias("record_id"))
        .agg(F.min(F.when(main, F.struct("type", "uri", "refers_to", "payload_bytes", "payload_digest", "payload"))).alias("response"), side("request", "uri", "block"), side("metadata", "block"))
        .where("response is not null")
    )


def originals(captures: DataFrame) -> DataFrame:
    """``record_id, original``: for each revisit the metadata record of the capture that its ``WARC-Refers-To`` names (null if that is not there).

    The captures that revisits name are few beside the revisits of a hot payload, so they are looked up once each.
    ``captures`` is read twice: hand in a stored table.
    """
    revisits = captures.where("response.type = 'revisit'").select("record_id", F.col("response.refers_to").alias("_to"))
    named = revisits.select("_to").distinct()
    found = captures.select(F.col("record_id").alias("_of"), F.col("metadata").alias("original")).join(named, F.col("_of") == F.col("_to"), "left_semi")
    found, _ = common.sized(found, "warc-originals")
    return revisits.join(found, F.col("_to") == F.col("_of"), "left").select("record_id", "original")


def new_path(spark: SparkSession) -> str:
    return f"{common.work_dir(spark)}/quarry-warc-{uuid.uuid4().hex}"
