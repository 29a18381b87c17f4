"""Named queries over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import MIX_RANGE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL text helpers

def sql_hash(seed: int, *cols: str) -> str:
    """The SQL twin of ``key_hash``."""
    text = ", ".join(f"cast({c} AS VARCHAR)" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 8) AS BIGINT)"


def sql_mix(a: str, b: str) -> str:
    """The SQL twin of ``mix``."""
    m = MIX_RANGE
    x0 = f"((xor(cast({a} AS BIGINT) % {m}, cast({b} AS BIGINT) % {m}) * 48271 + 11) % {m})"
    x1 = f"((xor({x0}, {x0} >> 15) * 69621 + 7) % {m})"
    return f"((xor({x1}, {x1} >> 13) * 40692) % {m})"


# ---------------------------------------------------------------- shared inputs

VECTOR_WIDTH = 10
FORESTS = 7

# seven class vectors of ten classes per embedding: shares of the absolute values of ten neighbours;
# the last one starts again at the first numbers, so all 64 are used
VECTORS_SQL = """
vec AS (
  SELECT vec_id AS instance, label, f.forest AS forest, c.class AS class,
         abs(cast(embedding[(f.forest * 10 + c.class) % 64 + 1] AS DOUBLE)) AS a
  FROM embeddings, (SELECT unnest(range(7)) AS forest) f, (SELECT unnest(range(10)) AS class) c),
vectors AS (
  SELECT instance, label, forest, class, a / sum(a) OVER (PARTITION BY instance, forest) AS p FROM vec)
"""


def class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance, block, label, forest, features): seven class vectors per embedding."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("instance"), F.col("label").cast("double").alias("label"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    cut = (emb.withColumn("forest", F.explode(F.sequence(F.lit(0), F.lit(FORESTS - 1))))
           .withColumn("v", F.slice(F.concat("e", "e"), F.col("forest") * VECTOR_WIDTH + 1, F.lit(VECTOR_WIDTH))))
    total = F.aggregate("v", F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return cut.select("instance", F.lit(0).cast("long").alias("block"), "label", "forest",
                      F.transform("v", lambda x: x / total).alias("features"))


def long_form(df: DataFrame, *keys: str, vector: str = "features", position: str = "pos",
              digits: int = 9) -> DataFrame:
    """One row per array slot, rounded."""
    return (df.select(*keys, F.posexplode(vector).alias(position, "value"))
              .withColumn("value", F.round("value", digits)))


LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

# three class scores per order line, with the return flag as label
LINE_SCORES_SQL = """
scores AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         l_discount * 10 AS s0, l_tax * 12 AS s1, l_quantity / 50 AS s2,
         CASE WHEN l_discount * 10 >= l_tax * 12 AND l_discount * 10 >= l_quantity / 50 THEN 0
              WHEN l_tax * 12 >= l_quantity / 50 THEN 1 ELSE 2 END AS predicted
  FROM lineitem)
"""


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    return li.select(*LINE_KEYS, "l_linestatus", label.alias("label"), F.array(
        F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50).alias("features"))
