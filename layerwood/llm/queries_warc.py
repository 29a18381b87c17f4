"""op5: write every page to WARC archives, read the archives back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .warc import mark_revisits, read_archives, write_archives


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_archives(mark_revisits(pages, "page_id", F.col("html")), "page_id", "url", path)
    return read_archives(spark, path).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN g.n > 1 AND p.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.n > 1 AND p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""
