"""op10: all pages written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm import warc
from nichefold.llm.common import scratch, ship, table

NAME = "op10_warc"
LEAST = 100
URN = "<urn:page:"


def records(pages: DataFrame) -> DataFrame:
    """A WARC record per page: the first page of equal payloads responds, later ones revisit it.

    A page with a null id comes after all others.  First pages are found on digests alone; texts move once.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    urn = lambda c: F.concat(F.lit(URN), F.col(c).cast("string"), F.lit(">"))
    return rows.join(firsts, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(urn("page_id"), F.lit(f"{URN}>")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(again, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    warc.register(spark)
    where = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    records(pages).write.format("warc").mode("append").save(where)
    n, there = pages.count(), spark.read.format("warc").schema("record_id string").load(where).count()  # headers only
    if n != there:
        raise RuntimeError(f"{n} pages were written, {there} records are there")
    back = spark.read.format("warc").schema("warc_type string, record_id string, refers_to string, payload_digest string, payload_length long, payload_sha256 string").load(where)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)>$', 1) AS long)")
    return back.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("warc_type") == "revisit", F.substring_index("payload_digest", ":", -1)).otherwise(F.col("payload_sha256")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id > f THEN f END AS refers_to
FROM r
"""
