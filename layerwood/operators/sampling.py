"""Splits, blocks, folds and draws; every choice is a hash of ids and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import HASH_RANGE, MIX_RANGE, key_hash, key_hash_value, mix
from ..session import materialize

#: Largest weight that a bootstrap draw can give; at rate 1 a larger one has a probability below 1e-14.
POISSON_TERMS = 16


def train_test_split(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Add ``is_train``; one narrow pass, the same row always lands on the same side."""
    return df.withColumn("is_train", key_hash(seed, *keys) < F.lit(int(fraction * HASH_RANGE)))


def random_blocks(df: DataFrame, blocks: int, seed: int, *keys: str) -> DataFrame:
    """Add ``block``: every block is a random sample of the whole, without a shuffle."""
    return df.withColumn("block", key_hash(seed, *keys) % F.lit(blocks))


def balanced_blocks(df: DataFrame, blocks: int, seed: int, *keys: str) -> DataFrame:
    """Add ``block`` so that the sizes of blocks differ by one row at most.

    Each partition is put in hash order and dealt round the blocks, beginning where
    the partition before it stopped; so every block is a random sample of every
    partition.  Nothing is shuffled: only the row counts of partitions are added
    up.  The dealt rows are written first, so that a lost task cannot deal anew.
    """
    order = df.withColumn("_h", key_hash(seed, *keys)).sortWithinPartitions("_h", *keys)
    # the id holds the partition in its upper bits and the place in it in the lower ones
    placed = materialize(order.drop("_h").withColumn("_m", F.monotonically_increasing_id()), "dealt")
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"_p": F.shiftright("_m", 33), "_m": place})
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn("block", (F.col("_s") + F.col("_m")) % F.lit(blocks)).drop("_p", "_m", "_s")


def k_folds(df: DataFrame, folds: int, seed: int, *keys: str) -> DataFrame:
    return df.withColumn("fold", (key_hash(seed, *keys) % F.lit(folds)).cast("int"))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    return df.filter(key_hash(seed, *keys) < F.lit(int(fraction * HASH_RANGE)))


def sample_k_and_count(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """A uniform sample of k rows with the total count on each row (all rows if fewer).

    Sort-and-limit keeps k rows per task; the count is a separate aggregate, so
    no task ever holds more than k rows.
    """
    picked = (df.withColumn("_h", key_hash(seed, *keys)).orderBy("_h", *keys).limit(k).drop("_h"))
    counted = df.agg(F.count(F.lit(1)).alias("total"))
    return picked.withColumn("_one", F.lit(1)).join(
        F.broadcast(counted.withColumn("_one", F.lit(1))), "_one").drop("_one")


def poisson_cdf(rate: float) -> list[float]:
    steps, term, acc = [], math.exp(-rate), 0.0
    for k in range(POISSON_TERMS):
        acc += term
        steps.append(acc)
        term *= rate / (k + 1)
    return steps


def tree_weight(row_hash: Column, tree_hash: Column, rate: float, bootstrap: bool) -> Column:
    """How often a row counts in one tree: a Poisson draw, or 0/1 by rate."""
    draw = mix(row_hash, tree_hash)
    if bootstrap:
        weight = F.lit(0)
        for bound in poisson_cdf(rate):
            weight = weight + (draw >= F.lit(int(bound * MIX_RANGE))).cast("int")
        return weight
    if rate >= 1.0:
        return F.lit(1)
    return (draw < F.lit(int(rate * MIX_RANGE))).cast("int")


def choose_blocks(block_count: int, take: int, seed: int) -> list[int]:
    """g of P block numbers, by hash order."""
    if take > block_count:
        raise ValueError(f"cannot take {take} of {block_count} blocks")
    order = sorted(range(block_count), key=lambda b: (key_hash_value(seed, b), b))
    return sorted(order[:take])


def assign_blocks(blocks: list[int], models: int, per_model: int, layer: int, seed: int) -> list[list[int]]:
    """For every model of a layer its own draw of blocks, without replacement."""
    if per_model > len(blocks):
        raise ValueError(f"cannot give {per_model} of {len(blocks)} blocks to a model")
    return [sorted(blocks, key=lambda b: (key_hash_value(seed, layer, m, b), b))[:per_model]
            for m in range(models)]


def choose_blocks_frame(df: DataFrame, take: int, seed: int) -> DataFrame:
    """The same draw over the distinct block ids of a table."""
    return (df.select("block").distinct()
              .orderBy(key_hash(seed, "block"), "block").limit(take))


def assignment_frame(blocks: DataFrame, models: int, per_model: int, layers: int, seed: int) -> DataFrame:
    """(layer, model, slot, block) rows; the window runs over the few block ids only."""
    grid = (blocks.select("block")
            .withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(layers))))
            .withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))))
    order = Window.partitionBy("layer", "model").orderBy(key_hash(seed, "layer", "model", "block"), "block")
    return (grid.withColumn("slot", F.row_number().over(order) - 1)
                .filter(F.col("slot") < per_model).select("layer", "model", "slot", "block"))


def feature_subset(nodes: DataFrame, num_features: int, size: int) -> DataFrame:
    """For each (tree, node, tree_hash) row the ``size`` features of smallest hash.

    The candidates live in one array per row, so no shuffle is needed.
    """
    key = mix(F.col("tree_hash"), F.col("node"))
    ranked = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(num_features - 1)),
        lambda f: F.struct(mix(F.col("_k"), f.cast("long")).alias("h"), f.alias("feature"))))
    return (nodes.withColumn("_k", key)
            .withColumn("_s", F.slice(ranked, 1, size))
            .withColumn("features", F.transform("_s", lambda s: s["feature"])).drop("_k", "_s"))


def row_index(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Contiguous 0-based positions in the order of a numeric unique key.

    Approximate quantiles cut the key range into buckets, the bucket counts
    give the offsets, and each bucket is numbered on its own: no single task
    sees the whole table.
    """
    buckets = buckets or df.sparkSession.sparkContext.defaultParallelism
    points = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(key, points, 1000)).first()[0] if points else []
    bucket = F.lit(0)
    for bound in sorted(set(bounds or [])):
        bucket = bucket + (F.col(key) > F.lit(bound)).cast("int")
    marked = df.withColumn("_b", bucket)
    counts = marked.groupBy("_b").count()
    starts = counts.select("_b", F.coalesce(F.sum("count").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = marked.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1)
    return (numbered.join(F.broadcast(starts), "_b")
            .withColumn("row_index", F.col("_r") + F.col("_o")).drop("_b", "_r", "_o"))


def block_share(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Training rows of each model and its share of the layer's total.

    The block counts have one row per block, which the configuration fixes.
    """
    per_block = df.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    per_model = (assignment.join(F.broadcast(per_block), "block")
                 .groupBy("layer", "model").agg(F.sum("n").alias("n_rows")))
    whole = Window.partitionBy("layer")
    return per_model.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(whole))


