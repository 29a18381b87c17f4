"""Splits, blocks, folds, draws and sampling rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling_rates as R
from ..functions.hashing import HASH_RANGE, MIX_RANGE, key_hash, key_hash_value
from ..operators import sampling as P
from ..session import materialize
from .registry import query, sql_hash, sql_mix, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), "o_totalprice")


@query("train_test_split", f"""
SELECT o_orderkey AS instance, o_totalprice, {sql_hash(7, 'o_orderkey')} < {int(0.7 * HASH_RANGE)} AS is_train
FROM orders""")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.train_test_split(_orders(spark, sf_dir), 0.7, 7, "instance")


@query("random_sample_blocks", f"""
SELECT o_orderkey AS instance, o_totalprice, {sql_hash(5, 'o_orderkey')} % 24 AS block FROM orders""")
def random_sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.random_blocks(_orders(spark, sf_dir), 24, 5, "instance")


@query("balanced_blocks", """
SELECT cast(b AS BIGINT) AS block, total // 24 + (b < total % 24)::INT AS n_rows, total AS n_instances
FROM (SELECT count(*) AS total, count(DISTINCT o_orderkey) AS ids FROM orders), (SELECT unnest(range(24)) AS b)""")
def balanced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of blocks dealt evenly; every instance is in one of them."""
    rows = materialize(P.balanced_blocks(_orders(spark, sf_dir), 24, 5, "instance"), "balanced")
    ids = rows.select("instance").distinct().agg(F.count("*").alias("n_instances"))
    return rows.groupBy("block").agg(F.count("*").alias("n_rows")).join(F.broadcast(ids))


@query("kfold", f"""
WITH folds AS (SELECT {sql_hash(9, 'o_orderkey')} % 3 AS fold, o_totalprice FROM orders)
SELECT cast(k.k AS INTEGER) AS fold, fold <> k.k AS is_train, count(*) AS n_rows, round(min(o_totalprice), 6) AS low,
       round(max(o_totalprice), 6) AS high FROM folds, (SELECT unnest(range(3)) AS k) k GROUP BY 1, 2""")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation side of every fold."""
    rows = P.k_folds(_orders(spark, sf_dir), 3, 9, "instance")
    sides = rows.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "fold", "o_totalprice")
    return sides.groupBy(F.col("k").alias("fold"), (F.col("fold") != F.col("k")).alias("is_train")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.min("o_totalprice"), 6).alias("low"),
        F.round(F.max("o_totalprice"), 6).alias("high"))


@query("bernoulli_sample", f"""
SELECT o_orderkey AS instance, o_totalprice FROM orders WHERE {sql_hash(3, 'o_orderkey')} < {int(0.2 * HASH_RANGE)}""")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bernoulli_sample(_orders(spark, sf_dir), 0.2, 3, "instance")


@query("sample_k_and_count", f"""
SELECT o_orderkey AS instance, o_totalprice, (SELECT count(*) FROM orders) AS total
FROM orders ORDER BY {sql_hash(13, 'o_orderkey')}, o_orderkey LIMIT 100""")
def sample_k_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_k_and_count(_orders(spark, sf_dir), 100, 13, "instance")


TREES = range(4)
TREE_HASHES = [key_hash_value(21, t) for t in TREES]
TREES_SQL = "(VALUES " + ", ".join(f"({t}, {h})" for t, h in zip(TREES, TREE_HASHES)) + ") t(tree, tree_hash)"


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(h).cast("long").alias("tree_hash"))
                      for t, h in zip(TREES, TREE_HASHES)])
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("instance"))
    return (rows.withColumn("row_hash", key_hash(17, "instance")).withColumn("t", F.explode(trees))
            .select("instance", "row_hash", "t.tree", "t.tree_hash"))


@query("tree_row_weights", f"""
SELECT event_id AS instance, t.tree, CASE WHEN {sql_mix(sql_hash(17, 'event_id'), 't.tree_hash')} < {int(0.6 * MIX_RANGE)}
  THEN 1 ELSE 0 END AS w FROM events, {TREES_SQL}""")
def tree_row_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without replacement: a row is in a tree or it is not."""
    return _tree_rows(spark, sf_dir).select(
        "instance", "tree", P.tree_weight(F.col("row_hash"), F.col("tree_hash"), 0.6, False).alias("w"))


POISSON_SQL = " + ".join(f"CASE WHEN m >= {int(b * MIX_RANGE)} THEN 1 ELSE 0 END" for b in P.poisson_cdf(1.0))


@query("bootstrap_weights", f"""
SELECT instance, tree, {POISSON_SQL} AS w FROM (
  SELECT event_id AS instance, t.tree, {sql_mix(sql_hash(17, 'event_id'), 't.tree_hash')} AS m FROM events, {TREES_SQL})""")
def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With replacement: a Poisson count per row and tree."""
    return _tree_rows(spark, sf_dir).select(
        "instance", "tree", P.tree_weight(F.col("row_hash"), F.col("tree_hash"), 1.0, True).alias("w"))


@query("node_feature_subset", f"""
WITH nodes AS (
  SELECT c_custkey AS node, t.tree, {sql_mix('t.tree_hash', 'c_custkey + 1')} AS k FROM customer, {TREES_SQL}),
ranked AS (
  SELECT tree, node, f.feature, row_number() OVER (
    PARTITION BY tree, node ORDER BY {sql_mix('k', 'f.feature')}, f.feature) AS r
  FROM nodes, (SELECT unnest(range(9)) AS feature) f)
SELECT tree, node + 1 AS node, cast(feature AS INTEGER) AS feature FROM ranked WHERE r <= 3""")
def node_feature_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of nine features for every (tree, node); the node ids come from the customer keys."""
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(h).cast("long").alias("tree_hash"))
                      for t, h in zip(TREES, TREE_HASHES)])
    nodes = (table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("node"), F.explode(trees).alias("t"))
             .select("t.tree", "node", "t.tree_hash"))
    return P.feature_subset(nodes, 9, 3).select("tree", "node", F.explode("features").alias("feature"))


@query("row_index", """
SELECT o_orderkey AS instance, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders""")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_index(_orders(spark, sf_dir).select("instance"), "instance")


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.random_blocks(_orders(spark, sf_dir), 24, 5, "instance")


BLOCKS_SQL = f"blocks AS (SELECT DISTINCT {sql_hash(5, 'o_orderkey')} % 24 AS block FROM orders)"


@query("choose_blocks", f"""
WITH {BLOCKS_SQL} SELECT block FROM blocks ORDER BY {sql_hash(31, 'block')}, block LIMIT 6""")
def choose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.choose_blocks_frame(_blocked(spark, sf_dir), 6, 31)


ASSIGN_SQL = f"""
{BLOCKS_SQL},
ranked AS (
  SELECT l.layer, m.model, block, row_number() OVER (
    PARTITION BY l.layer, m.model ORDER BY {sql_hash(33, 'l.layer', 'm.model', 'block')}, block) - 1 AS slot
  FROM blocks, (SELECT unnest(range(1, 4)) AS layer) l, (SELECT unnest(range(8)) AS model) m),
assigned AS (SELECT layer, model, slot, block FROM ranked WHERE slot < 5)
"""


@query("forest_block_assignment", f"""
WITH {ASSIGN_SQL}
SELECT cast(layer AS INTEGER) AS layer, cast(model AS INTEGER) AS model, cast(slot AS INTEGER) AS slot, block FROM assigned""")
def forest_block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of the blocks for each of eight models in each of three layers."""
    return P.assignment_frame(_blocked(spark, sf_dir).select("block").distinct(), 8, 5, 3, 33)


@query("block_sample_share", f"""
WITH {ASSIGN_SQL},
sizes AS (SELECT {sql_hash(5, 'o_orderkey')} % 24 AS block, count(*) AS n FROM orders GROUP BY 1),
model_rows AS (SELECT layer, model, cast(sum(n) AS BIGINT) AS n_rows FROM assigned JOIN sizes USING (block) GROUP BY 1, 2)
SELECT cast(layer AS INTEGER) AS layer, cast(model AS INTEGER) AS model, n_rows,
       round(n_rows / sum(n_rows) OVER (PARTITION BY layer), 9) AS share FROM model_rows""")
def block_sample_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocked(spark, sf_dir)
    assignment = P.assignment_frame(rows.select("block").distinct(), 8, 5, 3, 33)
    return P.block_share(rows, assignment).withColumn("share", F.round("share", 9))


@query("sampling_rate_bounds", """
WITH sizes AS (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
rates AS (
  SELECT o_custkey, n, n / 2 AS s, CASE WHEN n / 2 < 6 THEN 12.0::DOUBLE WHEN n / 2 < 16 THEN 9.0::DOUBLE ELSE 6.0::DOUBLE END AS d,
         -ln(0.0001::DOUBLE) / n AS g FROM sizes)
SELECT o_custkey, round(greatest(s - d * sqrt(s), 1e-15), 9) AS poisson_lower, round(greatest(s + d * sqrt(s), 1e-10), 9) AS poisson_upper,
  round(0.5 + g * 2 / 3 - sqrt(g * 2 / 3 * g * 2 / 3 + 3 * g * 2 / 3 * 0.5), 9) AS binomial_lower,
  round(least(1, greatest(1e-10, 0.5 + g + sqrt(g * g + 2 * g * 0.5))), 9) AS binomial_upper,
  round(greatest(s + d * sqrt(s), 1e-10) / n, 9) AS rate_with, round(least(1, greatest(1e-10, s / n + g + sqrt(g * g + 2 * g * (s / n)))), 9) AS rate_without
FROM rates""")
def sampling_rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds for drawing half of each customer's orders."""
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, s, half = F.col("n"), F.col("n") / 2.0, F.lit(0.5)
    out = {"poisson_lower": R.poisson_mean(s, False), "poisson_upper": R.poisson_mean(s, True),
           "binomial_lower": R.binomial_rate(n, half, False), "binomial_upper": R.binomial_rate(n, half, True),
           "rate_with": R.keep_rate(s, n, True),
           "rate_without": R.keep_rate(s, n, False)}
    return sizes.select("o_custkey", *[F.round(c, 9).alias(name) for name, c in out.items()])
