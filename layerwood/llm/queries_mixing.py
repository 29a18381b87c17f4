"""op3: mix all documents to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import fair_queue_mix


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fair_queue_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str) -> str:
    """Rows of fair_queue_mix over a relation with doc_id, text and source."""
    return rf"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS shuffled FROM {documents}),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM r),
v AS (SELECT *, CAST([5, 2, 1][1 + rank % 3] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS most FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
o AS (SELECT *, max(CASE WHEN most / weight > level THEN level END) OVER () AS open_level FROM l),
t AS (SELECT source, rank, source_size, CASE WHEN most / weight <= level THEN most ELSE weight * open_level END AS target FROM o),
q AS (SELECT doc_id, s.source, size, rank, source_size, target, row_number() OVER () AS nth,
    sum(size) OVER (PARTITION BY rank ORDER BY shuffled, size ROWS UNBOUNDED PRECEDING) AS served
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT nth, size, pass, rank, served, (CAST(pass * source_size + served AS DOUBLE)) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
f AS (SELECT nth, sum(size) OVER (ORDER BY finish, rank, pass, served ROWS UNBOUNDED PRECEDING) AS sent FROM c),
n AS (SELECT nth, count(*) AS copies FROM f WHERE sent <= (SELECT sum(size) FROM s) GROUP BY nth)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(copies, 0) AS INTEGER) AS copies,
  CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n USING (nth)"""


SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql('documents')})"
