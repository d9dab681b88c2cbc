"""Content-addressed WARC archive.

Payload bytes are stored once, under a strong digest (SHA-256, with the SHA-1 of the WARC header beside it); the exact header of each
record is stored separately; the original records come back by joining both. Reading verifies that each payload has the digest and the
length it is stored under. Rows are cut by nothing: a group of equal payloads of any size moves only its headers.

Defined results: a null payload is empty; a null url gives an empty target URI; line ends in a url can't stand in a header, so they are
left out there, while the record's table keeps the url as it was; identifiers of any type are percent-encoded in headers; a null
identifier is written as an empty one and read as null; rows that repeat an identifier and payload are records each, all of them response if they are the ones referred to; an empty
table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, shared_dir, table

#: The digits of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 5 hex digits are 4 base32 digits."""
    return base32(F.sha1(payload))


def base32(hexed: Column) -> Column:
    part = lambda k: F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
    digit = lambda v, shift: F.substring(F.lit(BASE32), 1 + F.shiftright(v, shift).bitwiseAND(F.lit(31)), F.lit(1))
    return F.concat(*[digit(part(k), shift) for k in range(8) for shift in (15, 10, 5, 0)])


def header(page_id: Column, url: Column, n_bytes: Column, digest: Column, refers_to: Column) -> Column:
    """The record's header block, to its empty line. A revisit has no block."""
    text = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    ident = F.coalesce(F.url_encode(page_id.cast("string")), F.lit(""))
    revisit = refers_to.isNotNull()
    http = text("HTTP/1.1 200 OK", END, "Content-Type: text/html; charset=utf-8", END, "Content-Length: ", n_bytes, END, END)
    return text(
        "WARC/1.1", END, "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"), END, "WARC-Record-ID: <urn:page:", ident, ">", END,
        "WARC-Target-URI: ", F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", ""), END, "WARC-Payload-Digest: sha1:", digest, END,
        F.when(revisit, text("WARC-Refers-To: <urn:page:", F.coalesce(F.url_encode(refers_to.cast("string")), F.lit("")), ">", END,
                             "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", END)).otherwise(""),
        "Content-Type: application/http; msgtype=response", END,
        "Content-Length: ", F.when(revisit, F.length(http)).otherwise(F.length(http) + n_bytes).cast("string"), END, END, http,
    )


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Writes folder/payloads (address, sha1, n_bytes, payload; once each) and folder/records (page_id, url, address, header).

    Of records with equal payloads of at least min_bytes, that with the largest identifier is a response and the others revisit it."""
    rows = columns(pages, page_id=id_col, url=url_col, payload=payload_col)
    rows = rows.withColumn("payload", F.coalesce(F.encode(F.col("payload").cast("string"), "UTF-8"), F.lit(b"")))
    address = F.unhex(F.sha2("payload", 256)).alias("address")
    # one payload for each digest and task goes through the shuffle
    stored = rows.groupBy(address).agg(F.first("payload").alias("payload"), F.max("page_id").alias("owner"))
    stored = stored.select("address", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes"), "owner", "payload")
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")
    owners = pages.sparkSession.read.parquet(f"{folder}/payloads").select("address", "sha1", "n_bytes", "owner")
    found = rows.select("page_id", "url", address).join(owners, "address")
    same = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("n_bytes") < min_bytes)
    refers_to = F.when(~same, F.col("owner"))
    head = header(F.col("page_id"), F.col("url"), F.col("n_bytes").cast("string"), base32(F.col("sha1")), refers_to)
    found.select("page_id", "url", "address", head.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads; a payload that doesn't have its digest or length stops the read."""
    found = spark.read.parquet(f"{folder}/payloads")
    right = (F.unhex(F.sha2("payload", 256)) == F.col("address")) & (F.sha1("payload") == F.col("sha1")) & (F.length("payload") == F.col("n_bytes"))
    return found.withColumn("n_bytes", F.when(right, F.col("n_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("address"))).cast("long")))


def field(name: str) -> Column:
    got = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(got != "", got)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to: from each record's header and from the payload stored for it.

    A header whose payload digest isn't that of the stored payload stops the read."""
    records = spark.read.parquet(f"{folder}/records")
    kind = records.schema["page_id"].dataType
    ident = lambda name: F.url_decode(F.nullif(F.regexp_extract(field(name), "<urn:page:([^>]*)>", 1), F.lit(""))).cast(kind)
    payloads = verified(spark, folder).select("address", F.col("n_bytes").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    own = records.select("address", "url", "header", ident("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), ident("WARC-Refers-To").alias("refers_to"))
    told = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    digest = F.when(field("WARC-Payload-Digest") == told, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("wrong digest in the header of "), F.hex("address"))).cast("string"))
    return own.join(payloads, "address").select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url and record: the original record as bytes (header, payload, end), whether it was stored as a response or a revisit."""
    records, payloads = spark.read.parquet(f"{folder}/records"), verified(spark, folder).select("address", "payload", "n_bytes")
    return records.join(payloads, "address").select("page_id", "url", F.concat(F.encode("header", "UTF-8"), "payload", F.lit(b"\r\n\r\n")).alias("record"), "payload")


def export_files(spark: SparkSession, folder: str, path: str) -> None:
    """Plain .warc text files: each record's header, then a response's payload, then two line ends."""
    records, payloads = spark.read.parquet(f"{folder}/records"), verified(spark, folder)
    full = records.join(payloads.select("address", "payload"), "address")
    block = F.when(field("WARC-Type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    full.select(F.concat("header", block).alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(path)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archive"
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('{BASE32}', 1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM g
"""
