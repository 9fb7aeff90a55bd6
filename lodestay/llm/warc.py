"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, which is verified when they are read; the exact header block of
every record is a row of its own with that digest. Records are put together again by joining the two. Of records
with one payload, one is the response and the others revisit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes at a time are ten hex digits and eight base32 ones."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, url: Column, copy: Column) -> Column:
    """A stable record URN; rows alike in every column differ by the number of the copy."""
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), copy.cast("string")).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks in a value become blanks."""
    clean = F.regexp_replace(value.cast("string"), "[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(_END)), F.lit(""))


def write_archive(pages: DataFrame, path: str, least_revisit: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as ``path``/payloads and ``path``/headers.

    A null html is an empty payload. Of records with equal payloads of ``least_revisit`` bytes or more, the one of
    the largest page_id (then url, then copy; null is smallest) is the response; smaller payloads are all
    responses. Rows alike in all three columns are records of their own. Further columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    check = F.struct(F.octet_length("payload").alias("bytes"), F.xxhash64("payload").alias("hash"))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(check).alias("a"), F.max(check).alias("b"))
    same = F.assert_true(F.col("a") == F.col("b"), F.lit("two payloads have one digest"))
    stored.where(same.isNull()).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    alike = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    alike = alike.groupBy("page_id", "url", "digest", "bytes", "sha1").agg(F.count("*").cast("int").alias("copies"))
    record = F.struct("page_id", "url", "copy")
    records = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("record", record)
    first = alike.groupBy("digest").agg(F.max(F.struct("page_id", "url", F.col("copies").alias("copy"))).alias("first"))
    records = records.join(first, "digest")
    response = (F.col("bytes") < least_revisit) | F.col("record").eqNullSafe(F.col("first"))
    of_first = F.col("first")
    name = lambda r: _record_id(r["page_id"], r["url"], r["copy"])
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", name(F.col("record"))),
        _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(~response, name(of_first))),
        _line("WARC-Profile", F.when(~response, F.lit(_PROFILE))),
        _line("Page-ID", F.col("page_id")),
        _line("Refers-To-Page-ID", F.when(~response, of_first["page_id"])),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(response, F.col("bytes")).otherwise(0)),
        F.lit(_END),
    )
    records.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    found = F.regexp_extract("header", f"(?:^|\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    headers = spark.read.schema("digest string, header string").parquet(f"{path}/headers")
    return headers.withColumn("record_type", _field("WARC-Type"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(digest, header, record_type, record): every record's exact bytes, headers joined with verified payloads."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    broken = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a stored payload does not match its digest"))
    payloads = payloads.where(broken.isNull())
    headers = _headers(spark, path)
    full = headers.where("record_type = 'response'").join(payloads, "digest")
    bare = headers.where("record_type = 'revisit'").withColumn("payload", F.lit(b""))
    whole = F.concat(F.encode("header", "utf-8"), F.col("payload"), F.lit(b"\r\n\r\n"))
    return full.unionByName(bare).select("digest", "header", "record_type", whole.alias("record"))


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Write the records as .warc text files: the separator of Spark's text writer is the end of a WARC record."""
    records = reconstruct(spark, path)
    body = F.substring("record", F.lit(1), F.octet_length("record") - 4).cast("string")
    records.select(body.alias("value")).write.option("lineSep", "\r\n\r\n").text(to)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the stored bytes.

    A response is put together and its payload cut out again by its Content-Length; a revisit takes length and
    digest of the response's payload.
    """
    records = reconstruct(spark, path)
    responses = records.where("record_type = 'response'")
    begin, size = F.octet_length(F.encode("header", "utf-8")) + 1, _field("Content-Length").cast("int")
    responses = responses.withColumn("payload", F.substring("record", begin, size))
    found = responses.select("digest", "header", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    facts = found.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = _headers(spark, path).where("record_type = 'revisit'").join(facts, "digest")
    wrong = F.assert_true(F.concat(F.lit("sha1:"), "payload_digest") == _field("WARC-Payload-Digest"), F.lit("a payload does not match its header"))
    rows = found.unionByName(revisits.select(*found.columns)).where(wrong.isNull())
    return rows.select(
        _field("Page-ID").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _field("Refers-To-Page-ID").cast("long").alias("refers_to")
    )
