"""Content-addressed web archive.

An archive is a folder with two tables. ``payloads`` holds the bytes of each distinct payload once,
under its SHA-256. ``headers`` holds the exact header block of every record and the digest it points to.
Reading joins the two, checks each payload against its digest, and gives back the records as written.
``export_warc`` writes them as WARC files.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest record id is
the response and the others revisit it; rows that repeat this smallest id are all responses. Smaller
payloads are responses throughout, but are also stored once.

Cases: a null payload is an empty one; a null record id is larger than any other (if all ids of a payload
are null, all are responses); a null url leaves its header line out; line breaks and other control characters
in a url are percent-encoded; repeated rows stay separate records; other columns are ignored; empty tables
give empty archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _header(kind: str, date: str) -> Column:
    """Header block of a record, with the empty line that ends it."""
    encoded = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <urn:x-record:"), F.col("record_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), encoded),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
    ]
    if kind == "revisit":
        lines += [
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}"),
            F.concat(F.lit("WARC-Refers-To: <urn:x-record:"), F.col("first_id"), F.lit(">")),
            F.lit("Content-Length: 0"),
        ]
    else:
        lines += [
            F.lit("Content-Type: text/html; charset=utf-8"),
            F.concat(F.lit("Content-Length: "), F.col("payload_bytes")),
        ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))  # concat_ws leaves out null lines


def write_archive(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> str:
    """Archive ``record_id, url, payload`` under ``path``; only hashes and one copy a payload are shuffled."""
    base = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("payload", F.lit("")).alias("payload"),
    )
    base = base.withColumn("payload_digest", F.sha2("payload", 256)).withColumn(
        "payload_bytes", F.octet_length("payload").cast("long")
    )
    base.groupBy("payload_digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    bare = base.drop("payload")
    first = bare.groupBy("payload_digest").agg(F.min("record_id").alias("first_id"))
    repeats = F.col("payload_bytes") >= MIN_REVISIT
    later = repeats & F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    (
        bare.join(first, "payload_digest")
        .withColumn("header", F.when(later, _header("revisit", date)).otherwise(_header("response", date)))
        .select("header", "payload_digest", "payload_bytes")
        .write.parquet(f"{path}/headers")
    )
    return path


def _field(name: str) -> Column:
    """Value of a header line; null where the block has no such line."""
    found = F.regexp_extract("header", f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records as they were written, with the header fields parsed back from the header blocks.

    Fails on a payload that does not match the digest under which it is stored.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    stored = stored.select(
        "payload_digest",
        F.when(actual == F.col("payload_digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), "payload_digest")))
        .alias("payload"),
    )
    headers = spark.read.parquet(f"{path}/headers").select("header")
    headers = headers.withColumn("payload_digest", F.substring_index(_field("WARC-Payload-Digest"), ":", -1))
    id_in = "<urn:x-record:(-?[0-9]+)>"
    number = lambda c: F.when(c != "", c).cast("long")
    return headers.join(stored, "payload_digest").select(
        number(F.regexp_extract("header", f"WARC-Record-ID: {id_in}", 1)).alias("record_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        number(F.regexp_extract("header", f"WARC-Refers-To: {id_in}", 1)).alias("refers_to"),
        "payload_digest",
        "payload",
        "header",
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write what ``read_archive`` gives as WARC files, one a task.

    The text writer ends each row with the two line breaks that end a WARC record.
    """
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    records.select(F.concat("header", block).alias("value")).write.option("lineSep", CRLF * 2).text(path)
