"""Content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256 (verified by SHA-1, length
and a digest of the stored bytes on reading); exact record headers are stored
apart, one a record. Reading joins headers to payloads, puts the records
together byte for byte, and takes type, reference, length and digest from the
parsed record, not from the tables that were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_root

CRLF = "\r\n"
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Bare upper-case base32 of the SHA-1 of a binary column: eight groups of
    20 bits, four letters each."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        v = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def record_id(page):
    """A stable urn for a record: the page id in the last two groups of a UUID."""
    return F.concat(F.lit("<urn:uuid:c1ade000-0000-4000-"), F.regexp_replace(F.lpad(F.lower(F.hex(page.cast("long"))), 16, "0"), "^(.{4})", "$1-"), F.lit(">"))


def _header(page, url, sha1, n, revisit, owner):
    """Exact header bytes of a record: the WARC block and the HTTP block."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF * 2))
    body = F.length(http) + F.when(revisit, F.lit(0)).otherwise(n)
    warc = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(record_id(page), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(owner))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    )
    return F.concat(warc, F.lit(CRLF * 2), http)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of pages (page_id, url, html; other columns are
    ignored) under path: path/headers and path/payloads.

    Of records with equal payloads of at least min_bytes bytes, the one with
    the largest page_id is the response and the others revisit it; records of
    smaller payloads are all responses. The payload is html in UTF-8, empty if
    null. Rows with a null page_id are responses. Repeated rows with the
    largest page_id are responses, each of them. Null urls leave their line out;
    CR and LF are taken out of urls, as a header line can't hold them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("n"))
    fact = F.struct("sha1", "n")
    owners = facts.groupBy("address").agg(F.max("page_id").alias("owner"), F.min(fact).alias("one"), F.max(fact).alias("other"))
    owners = owners.select(F.when(F.col("one") == F.col("other"), F.col("address")).otherwise(F.raise_error(F.lit("two payloads under one digest"))).alias("address"), "owner")
    revisit = F.coalesce((F.col("n") >= min_bytes) & (F.col("page_id") != F.col("owner")), F.lit(False))
    header = _header(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n"), revisit, F.col("owner"))
    facts.join(owners, "address").select("page_id", "address", header.alias("header")).write.parquet(f"{path}/headers")
    stored = rows.select(F.sha2("payload", 256).alias("address"), "payload").groupBy("address").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records under path, put together again: page_id, url, record_type,
    refers_to, payload_bytes, payload_digest, payload (of a revisit, the
    payload it refers to) and record (the exact bytes of the WARC record).
    Fails if a stored payload doesn't hash to its address or to the digest in
    the header, or if a header's length isn't that of its block. Length and
    digest are taken from the stored bytes before they are joined, so bytes
    are shuffled only for those who select payload or record."""
    headers = spark.read.schema("page_id long, address string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    sound = payloads.select(
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))).alias("address"),
        "payload",
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    both = headers.join(sound, "address", "left")

    def field(name):
        found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    hex_id = F.regexp_replace(F.regexp_extract(field("WARC-Refers-To"), "0000-4000-([0-9a-f-]+)>", 1), "-", "")
    response = field("WARC-Type") == "response"
    block = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    size = F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))
    out = both.select(
        "page_id",
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Type") == "revisit", F.conv(hex_id, 16, -10).cast("long")).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        "payload",
        F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"),
        field("WARC-Payload-Digest").alias("said"),
        (field("Content-Length").cast("long") - F.length(F.substring_index("header", CRLF * 2, -2)) - size).alias("off"),
    )
    sure = (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("off") == 0)
    return out.withColumn("record_type", F.when(sure, F.col("record_type")).otherwise(F.raise_error(F.lit("a record does not match its header")))).drop("said", "off")


def archived(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as an archive (by default into the shared folder) and read it back."""
    spark = pages.sparkSession
    path = path or f"{scratch_root(spark)}/clade-{uuid.uuid4().hex}/archive"
    write_archive(pages, path, min_bytes)
    return read_archive(spark, path)


def export_warc(records: DataFrame, path: str) -> None:
    """Records of read_archive as plain .warc text files (payloads must be UTF-8)."""
    text = F.decode("record", "UTF-8")
    records.select(F.substr(text, F.lit(1), F.length(text) - 4).alias("value")).write.option("lineSep", CRLF * 2).text(path)
