"""Content-addressed WARC archive: payload bytes once for each strong digest, record headers apart.

write_archive() makes a record for each page and stores two tables: `headers` (the record's exact
header bytes with the SHA-256 of its payload) and `payloads` (SHA-256, bytes, once). read_archive()
joins them, takes what a record says of itself from its header bytes, checks these and the digest, and
gives the original records back; record_bytes() are the bytes of the WARC file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Stands for the fetch time, which pages do not have (fixed value).
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base32 characters: four times ten hex digits, five bits a character."""
    hexed = F.sha1(payload)
    chars = []
    for c in range(4):
        value = F.conv(F.substring(hexed, 1 + 10 * c, 10), 16, 10).cast("long")
        for k in range(8):
            at = F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1
            chars.append(F.lit(ALPHABET).substr(at, F.lit(1)))
    return F.concat(*chars)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]", "%0A")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and its size and digests. Digests come before the join, so that what needs no payload does not move it."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    return base.select("*", F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record for each row of pages (page_id, url, html), repeated rows too; other columns are left out.

    Of records with equal payloads (by SHA-256) of at least min_bytes, the one with the smallest page_id
    is the response and the others revisit it; rows that repeat that page_id are responses too. Smaller
    payloads are all responses. A null html is an empty payload. A null page_id is larger than any
    other. Columns: page_id, url, payload, payload_bytes, sha256, payload_digest, record_type, refers_to.
    """
    base = _payloads(pages)
    # one row a digest and task before the shuffle; the join back is split where a digest is frequent
    first = base.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    revisits = F.coalesce((F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return base.join(first, "sha256").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "sha256",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def headers(recs: DataFrame) -> Column:
    """The record's header bytes, up to and with the empty line."""
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write headers and payloads below path. Payloads are stored once for each SHA-256, whatever the record types."""
    recs = records(pages, min_bytes)
    recs.select("sha256", headers(recs).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # every payload has a response; equal ones are one row a task before they move
    _payloads(pages).select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _value(header: Column, name: str) -> Column:
    """The value of a header's line, which must be there."""
    return F.substring_index(F.substring_index(header, f"\r\n{name}: ", -1), "\r\n", 1)


def _page(record_id: Column) -> Column:
    """The page_id of a record's name; null for a page without one, an error for other names."""
    return F.nullif(F.substring_index(F.substring_index(record_id, "<urn:page:", -1), ">", 1), F.lit("none")).cast("bigint")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records again, rebuilt by joins: page_id, record_type, refers_to, header, payload, sha256, payload_digest.

    All but the payload and its SHA-256 are read from the header bytes. A payload whose SHA-256 is not its address
    raises an error, and so do header bytes that are not those of a record of these values and this payload.
    """
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest"))))
    # size and digest before the join: once for each payload
    checked = checked.select("sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    head = F.col("header").cast("string")
    parts = heads.select(
        "sha256",
        "header",
        _page(_value(head, "WARC-Record-ID")).alias("page_id"),
        _value(head, "WARC-Type").alias("record_type"),
        F.when(_value(head, "WARC-Type") == "revisit", _page(_value(head, "WARC-Refers-To"))).alias("refers_to"),
        _value(head, "WARC-Target-URI").alias("url"),
    )
    joined = parts.join(checked, "sha256")
    fits = F.col("record_type").isin("response", "revisit") & (headers(joined) == F.col("header"))
    record = F.struct("page_id", "record_type", "refers_to", "header", "payload", "sha256", "payload_digest")
    return joined.select(F.when(fits, record).otherwise(F.raise_error(F.lit("header does not match its record"))).alias("record")).select("record.*")


def record_bytes(recs: DataFrame) -> DataFrame:
    """page_id with the record as it stands in a WARC file; a revisit has no block."""
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return recs.select("page_id", F.concat("header", block, F.lit("\r\n\r\n").cast("binary")).alias("record"))
