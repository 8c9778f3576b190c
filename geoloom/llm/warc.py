"""WARC archives with revisit records.

Headers (digest, length, page, address) are grouped by payload digest to find the original of each group; every page is
then joined to its original and written as a response or, without its payload, as a revisit. Tasks gather records to
archives of a bounded size, which Spark's text sink writes, and which are read by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: So many originals that are revisited, some MB of headers, go to where the pages are.
FEW = 20_000
CRLF = "\r\n"
END = CRLF * 2
#: RFC 4648 base 32 digits (fixed).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, warc_date string, payload binary"


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base-32 SHA-1: 40 hex digits in groups of 5 (20 bits) give 4 digits each."""
    hexed = F.sha1(data)
    group = lambda i: F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
    digit = lambda v, s: F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(group(i), s) for i in range(8) for s in (15, 10, 5, 0)])


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type, refers_to, refers_url.

    A null html is an empty payload. Of the records with equal payloads of at least min_bytes bytes the one with the
    largest page_id is the response (null is below all; rows that repeat that page_id are all responses) and the others
    revisit it; smaller payloads are all responses. Other columns are left out.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    # Only headers are grouped; Spark combines them before the shuffle, so a frequent payload costs one row a task. A
    # payload that occurs once is a response without a look at any other.
    originals = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max(F.struct("page_id", "url")).alias("_original"), F.count("*").alias("_rows"))
        .where("_rows > 1").drop("_rows")
    )
    originals = written(originals, "originals")
    if originals.limit(FEW + 1).count() <= FEW:
        originals = F.broadcast(originals)  # the payloads stay where they are read; else they go to their originals by a join that Spark can split
    joined = rows.join(originals, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    response = F.col("_original").isNull() | F.col("page_id").eqNullSafe(F.col("_original.page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("_original.page_id")).alias("refers_to"),
        F.when(~response, F.col("_original.url")).alias("refers_url"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line, none for null. Line ends in a value would end the field: they are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def record_text(date: str | None = None) -> Column:
    """A WARC record of a resolved row, without the two line ends that follow every record."""
    revisit = F.col("record_type") == "revisit"
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        _field("WARC-Date", when), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _field("WARC-Payload-Length", F.col("payload_bytes")),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))), _field("WARC-Refers-To-Target-URI", F.col("refers_url")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", block), F.lit(CRLF),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.decode("payload", "UTF-8")))


def _gathered(most: int):
    """Rows (a record's text): texts of records one behind the other, of most characters or a single record each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                record = text.as_py() + END
                if held and size + len(record) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(["".join(held)], pa.string())], names=["value"])
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(held)], pa.string())], names=["value"])

    return found


def write_archives(resolved: DataFrame, path: str, date: str | None = None, most: int = 16 << 20) -> None:
    """Gzipped archives below path; each holds records of most characters in all, or a single larger one."""
    bounded_batches(resolved.sparkSession)
    archives = resolved.select(record_text(date).alias("value")).mapInArrow(_gathered(most), "value string")
    archives.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path; a revisit's payload is null, its length and digest are its original's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parsed, RECORD_SCHEMA)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = stream.read(length := int(fields["content-length"]))
        if len(block) < length:
            raise ValueError("a record ends early")
        yield fields, block


class _Inflated(io.RawIOBase):
    """A gzip file of one or many members as a stream."""

    def __init__(self, data: bytes):
        self.left, self.inflate = data, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            out = self.inflate.decompress(self.left, len(into))
            self.left = self.inflate.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)
            if not self.inflate.eof or not (self.left or self.inflate.unused_data):
                return 0
            self.left, self.inflate = self.inflate.unused_data or self.left, zlib.decompressobj(31)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("warc_date", pa.string()), ("payload", pa.binary())])
    page = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
    rows, held = [], 0
    for batch in batches:
        for content in batch.column(0):
            for fields, block in records(io.BufferedReader(_Inflated(content.as_py()), 1 << 20)):
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} doesn't fit its digest")
                size = len(payload) if payload is not None else int(fields["warc-payload-length"])
                rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, digest, page(fields.get("warc-refers-to")), fields["warc-date"], payload))
                held += len(block) + 200
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)
