"""Class vectors: projections, joins, concatenation, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics as M
from ..operators import vectors as V
from ..operators.sampling import random_blocks
from .registry import FORESTS, VECTOR_WIDTH, VECTORS_SQL, class_vectors, long_form, query, sql_hash, table


@query("forest_class_vectors", f"""
WITH {VECTORS_SQL}
SELECT instance, cast(0 AS BIGINT) AS block, cast(forest AS INTEGER) AS forest, cast(class AS INTEGER) AS pos,
       round(p, 9) AS value FROM vectors""")
def forest_class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name the probabilities features, tag them with the forest id, and union the forests."""
    rows = class_vectors(spark, sf_dir).withColumnRenamed("features", "probability")
    parts = [V.as_class_vectors(rows.filter(F.col("forest") == f).drop("forest"), f) for f in range(FORESTS)]
    return long_form(V.union_all(parts), "instance", "block", "forest")


@query("cast_label", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_linenumber AS DOUBLE) AS label,
       cast(3 AS BIGINT) AS block FROM lineitem""")
def cast_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                   F.col("l_linenumber").alias("label"))
    return V.with_block(V.to_double_label(rows, 8), 3)


@query("block_filter", f"""
SELECT event_id AS instance, value, {sql_hash(2, 'event_id')} % 10 AS block
FROM events WHERE {sql_hash(2, 'event_id')} % 10 = 4""")
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = random_blocks(table(spark, sf_dir, "events").select(F.col("event_id").alias("instance"), "value"),
                         10, 2, "instance")
    return rows.filter(F.col("block") == 4)


@query("union_blocks", f"""
SELECT event_id AS instance, value, {sql_hash(2, 'event_id')} % 10 AS block
FROM events WHERE {sql_hash(2, 'event_id')} % 10 IN (1, 4, 7)""")
def union_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = random_blocks(table(spark, sf_dir, "events").select(F.col("event_id").alias("instance"), "value"),
                         10, 2, "instance")
    return V.union_all([V.with_block(rows.filter(F.col("block") == b).drop("block"), b) for b in (1, 4, 7)])


MERGE_SQL = f"""
WITH {VECTORS_SQL},
raw AS (
  SELECT vec_id AS instance, p.pos AS pos, cast(embedding[p.pos + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS pos) p),
merged AS (
  SELECT instance, pos, value FROM raw
  UNION ALL SELECT instance, 64 + class, p FROM vectors WHERE forest = 0)
"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("instance"), F.lit(0).cast("long").alias("block"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query("merge_features_predictions", MERGE_SQL + """
SELECT instance, cast(0 AS BIGINT) AS block, cast(pos AS INTEGER) AS pos, round(value, 9) AS value FROM merged""")
def merge_features_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = class_vectors(spark, sf_dir).filter("forest = 0")
    return long_form(V.merge_features(_features(spark, sf_dir), predictions), "instance", "block")


@query("merge_by_instance", MERGE_SQL + """
SELECT instance, cast(pos AS INTEGER) AS pos, round(value, 9) AS value FROM merged""")
def merge_by_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = class_vectors(spark, sf_dir).filter("forest = 0")
    return long_form(V.merge_features(_features(spark, sf_dir), predictions, keys=("instance",)), "instance")


@query("eval_join", f"""
WITH {VECTORS_SQL},
mean AS (SELECT instance, label, class, avg(p) AS p FROM vectors GROUP BY 1, 2, 3),
top AS (SELECT instance, label, arg_max(class, p) AS predicted FROM mean GROUP BY 1, 2)
SELECT cast(sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_right, count(*) AS n_total FROM top""")
def eval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors joined back to the labels, then accuracy."""
    vectors = class_vectors(spark, sf_dir)
    labelled = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("instance"), F.lit(0).cast("long").alias("block"), F.col("label").cast("double"))
    joined = V.join_labels(labelled, V.stack_vectors(vectors, VECTOR_WIDTH))
    return M.accuracy(M.confusion(joined)).select("n_right", "n_total")


@query("concat_class_vectors", f"""
WITH {VECTORS_SQL}
SELECT instance, cast(0 AS BIGINT) AS block, cast(forest * 10 + class AS INTEGER) AS pos, round(p, 9) AS value
FROM vectors""")
def concat_class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(V.concat_vectors(class_vectors(spark, sf_dir)), "instance", "block")


STACK_SQL = f"""
WITH {VECTORS_SQL}
SELECT instance, cast(0 AS BIGINT) AS block, cast(class AS INTEGER) AS pos, round(avg(p), 9) AS value
FROM vectors GROUP BY instance, class"""


@query("stack_class_vectors", STACK_SQL)
def stack_class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(V.stack_vectors(class_vectors(spark, sf_dir), VECTOR_WIDTH), "instance", "block")


@query("stack_concatenated", STACK_SQL)
def stack_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same means from the concatenated vectors, position modulo the class count."""
    concatenated = V.concat_vectors(class_vectors(spark, sf_dir))
    return long_form(V.stack_concatenated(concatenated, VECTOR_WIDTH), "instance", "block")


@query("concat_scan_features", f"""
WITH {VECTORS_SQL}
SELECT instance, cast(label AS DOUBLE) AS label,
       cast(row_number() OVER (PARTITION BY instance ORDER BY forest % 2, forest // 2, forest, class) - 1 AS INTEGER) AS pos,
       round(p, 9) AS value FROM vectors""")
def concat_scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of three forests each, ordered by scan, forest and window."""
    vectors = class_vectors(spark, sf_dir).select(
        "instance", "label", "features", (F.col("forest") % 2).alias("scan_id"),
        (F.col("forest") / 2).cast("int").alias("forest"), F.col("forest").cast("long").alias("window"))
    scans = [vectors.filter(F.col("scan_id") == s) for s in (1, 0)]
    return long_form(V.concat_scans(scans), "instance", "label")


@query("normalize_votes", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(CASE WHEN t = 0 THEN s0 ELSE s0 / t END, 9) AS p0, round(CASE WHEN t = 0 THEN s1 ELSE s1 / t END, 9) AS p1
FROM (SELECT *, s0 + s1 AS t FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount AS s0, l_tax AS s1 FROM lineitem))""")
def normalize_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale votes to probabilities; rows without votes stay zero."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    out = table(spark, sf_dir, "lineitem").select(*keys, A.normalize(F.array("l_discount", "l_tax")).alias("p"))
    return out.select(*keys, *[F.round(F.get("p", F.lit(k)), 9).alias(f"p{k}") for k in (0, 1)])


@query("mean_fold_vectors", f"""
WITH {VECTORS_SQL}
SELECT instance, cast(class AS INTEGER) AS pos, round(avg(p), 9) AS value
FROM vectors GROUP BY instance, class""")
def mean_fold_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise mean of fold vectors that stand in a column each."""
    folds = [f"fold_{f}" for f in range(FORESTS)]
    wide = class_vectors(spark, sf_dir).groupBy("instance").agg(
        *[F.max_by("features", F.when(F.col("forest") == f, 1)).alias(name) for f, name in enumerate(folds)])
    return long_form(wide.select("instance", A.mean_vectors(*folds).alias("features")), "instance")


@query("table_dims", """
SELECT count(*) AS n_rows, cast(min(len(embedding)) AS INTEGER) AS n_features FROM embeddings""")
def table_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size("features")).alias("n_features"))


