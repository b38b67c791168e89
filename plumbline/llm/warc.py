"""WARC archives: write captures, resolve revisits by payload digest, write deduplicated archives, read them back.

Rules for edge cases: a null payload is empty; null ids sort last, so a page with an id is preferred as the original;
line breaks in a url are percent-encoded in its header, and a null url is written as ``urn:none``; repeated rows are
records of their own (the first in the archives is the original, the others revisit it); a payload of any content is read
by its length, so text that looks like a record does no harm; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.tables import shared_folder, write_table
from plumbline.llm.common import table

# Header names and values that the format fixes.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 2000
HEADS = ("path string, offset long, record_type string, record_id string, page_id string, url string, digest string, "
         "payload_bytes long, refers_to string")


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 base-32 characters: five hex digits at a time are four digits of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _write(records: DataFrame, folder: str) -> None:
    """Write records (``record_type``, ``record_id``, ``page_id``, ``url``, ``digest``, ``payload``, ``payload_bytes``,
    ``refers_to``, ``refers_to_url``) as gzipped archives; the text writer adds the two line ends behind each block."""
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP), "payload")).otherwise(F.lit(HTTP))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")), line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(~response, F.lit(PROFILE))), line("WARC-Refers-To", F.when(~response, F.col("refers_to"))),
        line("WARC-Refers-To-Target-URI", F.when(~response, F.col("refers_to_url"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    records.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(folder)


def write_captures(pages: DataFrame, folder: str) -> None:
    """Every page as a response record."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.replace(F.replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:none")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # Written once: the number only has to be different for every record.
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    _write(pages.select(F.lit("response").alias("record_type"), F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"),
                        F.col("page_id"), uri.alias("url"), base32_sha1(payload.cast("binary")).alias("digest"),
                        payload.alias("payload"), F.octet_length(payload).alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to"),
                        F.lit(None).cast("string").alias("refers_to_url")), folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record in the archives of ``folder``: its headers, its place, and its payload where asked for.

    A task reads one archive at a time (``RECORDS_PER_FILE`` bounds it) and steps from record to record by the length
    in the header.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data, at, rows = gzip.decompress(content.as_buffer()), 0, []
                while at < len(data):
                    stop = data.index(b"\r\n\r\n", at)
                    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
                    got = dict(x.split(": ", 1) for x in lines[1:])
                    begin, size = stop + 4, int(got["Content-Length"])
                    body = data.index(b"\r\n\r\n", begin) + 4
                    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((path.as_py(), at, got["WARC-Type"], got["WARC-Record-ID"], got.get("X-Page-ID"), got["WARC-Target-URI"],
                                 digest, int(got["X-Payload-Length"]), got.get("WARC-Refers-To"), *((data[body:begin + size],) if payloads else ())))
                    at = begin + size + len(END)
                names = [x.split()[0] for x in HEADS.split(", ")] + ["payload"] * payloads
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(parse, HEADS + ", payload binary" * payloads)


def resolve(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``path``, ``offset`` of every record with ``record_type`` and the original it refers to (``first``: a struct).

    Only headers travel: digests are grouped with a partial minimum in every map task, and adaptive execution splits the
    skewed side of the join that hands the original back to a digest that most records share.
    """
    page = F.col("page_id").cast("long")
    own = F.struct(page.isNull().alias("none"), page.alias("page_id"), F.col("path"), F.col("offset"), F.col("record_id"), F.col("url"))
    firsts = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min(own).alias("first"))
    joined = heads.select("path", "offset", "digest", "payload_bytes").join(firsts, "digest", "left")
    again = F.coalesce((F.col("payload_bytes") >= least_bytes) & (
        (F.col("first.path") != F.col("path")) | (F.col("first.offset") != F.col("offset"))), F.lit(False))
    return joined.select("path", "offset", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
                         F.when(again, F.col("first")).alias("first"))


def deduplicate(spark: SparkSession, captures: str, folder: str, least_bytes: int = 0) -> None:
    """Read the archives in ``captures`` and write them to ``folder`` with revisit records for repeated payloads."""
    verdicts = resolve(write_table(read_archives(spark, captures)), least_bytes)
    records = read_archives(spark, captures, True).join(verdicts, ["path", "offset"])
    _write(records.select(F.col("kind").alias("record_type"), "record_id", "page_id", "url", "digest",
                          F.col("payload").cast("string").alias("payload"), "payload_bytes",
                          F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("refers_to_url")), folder)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, deduplicate and read back: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    spark = pages.sparkSession
    base = f"{shared_folder(spark)}/plumbline/warc-{uuid.uuid4().hex}"
    write_captures(pages, f"{base}/captures")
    deduplicate(spark, f"{base}/captures", f"{base}/archives", least_bytes)
    heads = write_table(read_archives(spark, f"{base}/archives"))
    named = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("original"))
    kind = pages.schema["page_id"].dataType
    return heads.join(named, F.col("refers_to") == F.col("refers"), "left").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", F.col("original").cast(kind)).alias("refers_to"))


def op7(spark, folder):
    return round_trip(table(spark, folder, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT d.page_id, d.payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM d JOIN f ON d.h = f.h
"""
