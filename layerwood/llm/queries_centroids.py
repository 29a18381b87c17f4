"""op11: sixteen clusters of the vectors of 64 components, three rounds, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_vectors, with_inertia

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = cluster_vectors(table, "vec_id", "embedding", DIMS, SCALE, CLUSTERS, ROUNDS, seed=1)
    return with_inertia(spark, found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(n: int) -> str:
    each = "list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    return f"""a{n} AS MATERIALIZED (
  SELECT nr, min(struct_pack(d := {each}::BIGINT, k := c.k)) AS best FROM points p CROSS JOIN c{n} c GROUP BY nr)"""


def _moved(n: int) -> str:
    return f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT k, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS v FROM (
      SELECT a.best.k AS k, i, sum(p.v[i])::BIGINT AS s, count(*) AS n
      FROM a{n} a JOIN points p USING (nr) CROSS JOIN range(1, 65) t(i) GROUP BY a.best.k, i) GROUP BY k) m ON m.k = c.k)"""


#: Quotients are taken as doubles: the sums stay far below 2**53, so their floor is exact.
SQL = f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM points QUALIFY k < {CLUSTERS}),
{", ".join(f"{_assigned(n)}, {_moved(n)}" for n in range(ROUNDS))},
{_assigned(ROUNDS)}
SELECT p.vec_id, a.best.k::INTEGER AS cluster, a.best.d AS distance,
       sum(a.best.d) OVER (PARTITION BY a.best.k)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM points p JOIN a{ROUNDS} a USING (nr) JOIN c{ROUNDS} c ON c.k = a.best.k
"""
