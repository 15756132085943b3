"""A content-addressed archive of web records.

Payload bytes are stored once under their SHA-256, with the bare base32 SHA-1
that the headers name; exact record headers are stored apart, and a record is
put together again by joining its header with its payload. Digests are
verified: rows that share a digest must agree in length and in a second,
independent hash, and a payload that is read back must hash to its key.

Of records with equal payloads of at least min_bytes bytes that with the
largest page_id is the response and holds the payload; the others are revisits,
whose headers name it. Smaller payloads are all responses. Rows of one page_id
and one payload are copies of the response where it is theirs. A null payload
counts as empty, a null url as empty, and null page_ids order below all others.
An empty table gives an empty archive. Control characters and blanks of a url
are percent-encoded in its header line. A record's id names page_id, payload
digest and, where several rows have both, a running number. Pages carry no time
of capture, so every record has the date that the caller gives. Columns besides
page_id, url and the payload are not read.

Equal payloads meet as partial aggregates, a row for each distinct payload and
task, so a payload that a third of all rows share moves once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import release

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32(hexed: Column, bits: int = 160) -> Column:
    """Bare upper-case base32 of a hexadecimal digest whose bits divide by 40."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(bits // 40)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def keyed(pages: DataFrame, payload: str = "html") -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def quoted(url: Column) -> Column:
    """The url with control characters and blanks percent-encoded."""
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def header(date: str) -> Column:
    """Exact bytes before the payload: the record's header block and, for responses, the HTTP header."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    uri = lambda c, *more: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(":"), F.col("sha1"), *more, F.lit(">"))
    revisit = F.col("revisit")
    length = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("payload_bytes"))
    again = F.when(F.col("copy") > 1, F.concat(F.lit(":"), F.col("copy"))).otherwise(F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), uri("page_id", again)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), quoted(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri("holder"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http).cast("binary")


def write(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Write path/payloads (digest, sha1, payload, holder) and path/headers (page_id, digest, header)."""
    spark = pages.sparkSession
    rows = keyed(pages, payload)
    bodies = rows.groupBy("digest").agg(
        F.max("page_id").alias("holder"),
        F.first("payload").alias("payload"),
        F.min(F.octet_length("payload")).alias("least"),
        F.max(F.octet_length("payload")).alias("payload_bytes"),
        F.min(F.xxhash64("payload")).alias("low"),
        F.max(F.xxhash64("payload")).alias("high"),
    )
    same = (F.col("least") == F.col("payload_bytes")) & (F.col("low") == F.col("high"))
    bodies.select(
        "digest",
        base32(F.sha1("payload")).alias("sha1"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "holder",
        F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("different payloads share a digest")).cast("binary")).alias("payload"),
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = spark.read.parquet(f"{path}/payloads").select("digest", "sha1", "payload_bytes", "holder")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    copy = F.row_number().over(W.partitionBy("page_id", "digest").orderBy("url")).alias("copy")
    heads = rows.select("page_id", "url", "digest", copy).join(known, "digest").withColumn("revisit", revisit)
    heads.select("page_id", "digest", header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    release(spark)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each hashed again; a wrong one stops the read."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return stored.select("digest", "payload", F.when(right, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest")).cast("long")).alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archive: header fields, and record, its exact bytes (a revisit's have no payload).

    Where record and payload aren't selected, Catalyst reads the payloads only to verify them and moves none.
    """
    page = F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+):", 1)
    kind = field("WARC-Type")
    heads = spark.read.parquet(f"{path}/headers").select(
        "page_id", "digest", "header", kind.alias("record_type"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("named"), F.when(kind == "revisit", F.nullif(page, F.lit("")).cast("long")).alias("refers_to")
    )
    right = F.col("named") == F.col("payload_digest")
    end = F.lit(CRLF * 2).cast("binary")
    return heads.join(verified(spark, path), "digest").select(
        "page_id",
        "payload_bytes",
        F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest"))).alias("payload_digest"),
        "record_type",
        "refers_to",
        "payload",
        F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"),
    )


def digests(records: DataFrame) -> DataFrame:
    """The records' columns with the length and SHA-256 of each rebuilt record in place of its bytes."""
    own = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.select(*own, F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
