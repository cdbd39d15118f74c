"""Content-addressed web archive.

An archive is two tables. `payloads` holds each distinct payload once, under its SHA-256; `records`
holds the exact bytes of every WARC record in front of its payload (the record's header block, and a response's HTTP
head), and the digest of the payload that belongs to it. A record is these, the payload that a join finds (responses
only) and the closing blank lines. Every record has an id of its own. What is read back is verified: a payload must hash to the digest that it is stored under.

Everything is DataFrame operations. Payloads are thinned to one per digest and task before they are
shuffled, so a payload that a third of all pages share moves once per task.

Defined results: null html is an empty payload; a null url is written as an empty target. Of records
with one payload of `least` bytes or more the largest id is the response; ids that repeat there are
responses each. A null id is below every other id. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = DATE) -> None:
    """Write pages as an archive at `path` (a folder that all executors share)."""
    raw = pages.select(
        F.col(key).cast("long").alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    )
    hashed = raw.withColumn("sha256", F.sha2("payload", 256))
    hashed.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    slim = hashed.select("key", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    # settled with their ids, so that a revisit names the record that is written; the last ones apart, so that the join
    # may split a payload that many pages share
    slim = materialise(slim.withColumn("id", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))))
    last = materialise(slim.where(F.col("size") >= least).groupBy(F.col("sha256").alias("of")).agg(F.max(F.struct("key", "id")).alias("last")))
    told = slim.join(last, slim.sha256 == last.of, "left")
    last_key = F.col("last.key")
    revisit = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(last_key)

    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))

    size = F.col("size").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", size), F.lit(EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        F.when(revisit, line("WARC-Type", F.lit("revisit"))).otherwise(line("WARC-Type", F.lit("response"))),
        line("WARC-Record-ID", F.col("id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.col("last.id")),
            F.coalesce(line("X-Refers-To-Key", last_key.cast("string")), F.lit("")),
        )).otherwise(F.lit("")),
        line("X-Key", F.coalesce(F.col("key").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise((F.octet_length(http) + F.col("size")).cast("string"))), F.lit(EOL),
        F.when(revisit, F.lit("")).otherwise(http),
    )
    told.select(head.cast("binary").alias("header"), "sha256").write.parquet(f"{path}/records")


def _field(name: str) -> Column:
    """A header field's value; an empty string where there is none."""
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload; reading fails on a payload that does not hash to its digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("sha256")
    return stored.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' header blocks and the fields in them."""
    number = lambda name: F.when(_field(name) != "", _field(name)).cast("long")
    return spark.read.parquet(f"{path}/records").select(
        number("X-Key").alias("key"), _field("WARC-Type").alias("record_type"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        number("X-Refers-To-Key").alias("refers_to"), _field("WARC-Target-URI").alias("url"), "header", "sha256",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its original bytes: header, payload (none for revisits), two line ends."""
    joined = read_headers(spark, path).join(verified_payloads(spark, path), "sha256", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.withColumn("record", F.concat("header", body, F.lit(EOL * 2).cast("binary")))


def pages_archive(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: written, then read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archive")
    write_archive(pages, path)
    stored = verified_payloads(spark, path).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    heads = read_headers(spark, path)
    return heads.join(stored, "sha256", "left").select(
        F.col("key").alias("page_id"), "payload_bytes",
        F.when(F.col("digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"),
        "record_type", "refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, sha256(h) AS k FROM p),
m AS (SELECT k, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY k)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.last IS NOT NULL AND d.page_id IS DISTINCT FROM m.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last IS NOT NULL AND d.page_id IS DISTINCT FROM m.last THEN m.last END AS refers_to
FROM d LEFT JOIN m ON d.k = m.k
"""
