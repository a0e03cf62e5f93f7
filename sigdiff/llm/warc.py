"""WARC archives with revisit records in place of repeated payloads.

Pages become response records; of the pages with equal payloads of at least MIN_BYTES bytes only the one with
the largest page_id stays a response and the others become revisit records that refer to it. Only the records' heads
(id, URL, digest, length) are shuffled by digest, with one row for each task and digest before the shuffle; a payload is moved only where the
revisits are too many to be broadcast, and then only to be held against them. Spark's text writer
writes the archives, a record a row, so they may lie in any store that Spark writes to, and a lost task is simply run again. Records are written
by classes of their size, so that a file holds about FILE_BYTES at most, or one record.

Null html is an empty payload. A null url becomes an empty target URI; white space and control characters in a URL are
written as %20. Pages with a null id are revisits if a page with an id has the same payload, else responses. Rows that repeat
both id and payload are all written, with equal record ids.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigdiff.llm.common import stored

#: Payloads shorter than this are always written in full.
MIN_BYTES = 1000
#: Bytes in an archive file before compression, about, at most; payload bytes of the first class of records, and how much larger the next class's are.
FILE_BYTES, FIRST, NEXT = 256_000_000, 1 << 15, 16
#: Revisits and digests that are broadcast, at most (some 100 bytes each); beyond it rows are shuffled.
BROADCAST_HEADS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def heads(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, payload_bytes and payload_digest (SHA-1, hex) of every page."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))


def _few(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_HEADS else rows


def resolve(found: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of found (page_id, payload_bytes, payload_digest and others) that are revisits, with refers_to, the response that each stands for."""
    large = found.where(F.col("payload_bytes") >= min_bytes)
    originals = stored(large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n"), "originals")
    return large.join(_few(originals), "payload_digest").where("NOT page_id <=> refers_to")


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _written(rows: DataFrame, date: str) -> DataFrame:
    """rows: page_id, url, payload_bytes, payload_digest, payload and refers_to (null for responses). value: a whole record, but for the two line ends after it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.concat(F.lit("Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length("payload")).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http, F.col("payload")).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str | None = None, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Responses class by class of their sizes, the revisits with the first; path must not hold archives yet."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    url, payload = F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url, payload)
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    found = stored(rows.drop("payload"), "heads")
    again = stored(resolve(found, min_bytes), "revisits")
    gone = _few(stored(again.select(F.col("page_id").alias("gone"), F.col("payload_digest").alias("gone_digest")).distinct(), "revisit-ids"))
    responses = rows.join(gone, F.col("page_id").eqNullSafe(F.col("gone")) & (F.col("payload_digest") == F.col("gone_digest")), "left_anti").withColumn("refers_to", F.lit(None).cast("long"))
    size_class = F.ceil(F.log(F.greatest(F.col("payload_bytes"), F.lit(FIRST)) / FIRST) / math.log(NEXT) - 1e-9).cast("int")
    classes = {0, *(r[0] for r in found.select(size_class).distinct().collect())}  # a handful: sizes end at 2 GB
    for k in sorted(classes):
        own = responses.where(size_class == k)
        if k == 0:
            own = own.unionByName(again.withColumn("payload", F.lit("")))
        made = _written(own, date).write.mode("append" if k else "error").option("lineSep", END).option("compression", "gzip")
        made.option("maxRecordsPerFile", max(1, file_bytes // (FIRST * NEXT**k))).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record of an archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "record_type", "url", "refers_to_record", "payload_digest", "payload_bytes", "intact"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                payload = block.partition(b"\r\n\r\n")[2]
                digest, full = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "response"
                page = fields.get("page-id")
                rows.append((fields["warc-record-id"], int(page) if page else None, fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, len(payload) if full else None, hashlib.sha1(payload).hexdigest() == digest if full else None))
                if len(rows) >= 5000:
                    yield made(rows)
                    rows = []
            yield made(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, revisits joined to the response that they refer to (resolved_page_id, and its payload_bytes)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = stored(raw.mapInArrow(_parsed, "record_id string, page_id long, record_type string, url string, refers_to_record string, payload_digest string, payload_bytes long, intact boolean"), "warc-records")
    originals = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.first("page_id").alias("resolved_page_id"), F.first("payload_bytes").alias("resolved_bytes"))
    refers = F.col("refers_to_record").isNotNull()
    resolved = found.where(refers).join(originals, "refers_to_record", "left")
    # rows that refer to nothing stay out of the shuffle, where they would all have one key
    joined = resolved.unionByName(found.where(~refers), allowMissingColumns=True)
    return joined.select("record_id", "page_id", "record_type", "url", "payload_digest", F.coalesce("payload_bytes", "resolved_bytes").alias("payload_bytes"), "resolved_page_id", "intact")
