"""Block tables and layer tables on shared storage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import to_csv_text


def write_blocks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per block, so that later reads open the chosen blocks only.

    The rebalance hint gathers the rows of a block and lets adaptive execution
    split a block that is too large for one task.  Mode ``ignore`` keeps blocks
    that were written before.
    """
    df.hint("rebalance", "block").write.mode(mode).partitionBy("block").parquet(path)


def read_blocks(spark: SparkSession, path: str, blocks: Iterable[int]) -> DataFrame:
    """Partition pruning keeps the other blocks' files unread."""
    df = spark.read.parquet(path)
    return (df.filter(F.col("block").isin([int(b) for b in blocks]))
              .withColumn("block", F.col("block").cast("long")))


def read_assigned_blocks(spark: SparkSession, path: str, assignment: DataFrame, layer: int) -> DataFrame:
    """Rows of the blocks that the models of a layer draw, one copy per model: adds layer, model and slot.

    ``assignment`` is a written table (layer, model, slot, block).  It is joined,
    so Spark learns at run time which block folders to open; its rows of one layer
    are models x blocks per model, which the configuration fixes.
    """
    drawn = F.broadcast(assignment.filter(F.col("layer") == layer).select("layer", "model", "slot", F.col("block").alias("_drawn")))
    rows = spark.read.parquet(path)
    return (rows.join(drawn, F.col("block") == F.col("_drawn")).drop("_drawn")
                .withColumn("block", F.col("block").cast("long")))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def layer_lines(df: DataFrame, with_block: bool) -> DataFrame:
    """The text form of a layer table: instance, features..., label[, block]."""
    parts = [F.col("instance").cast("string"), to_csv_text("features"), F.col("label").cast("string")]
    if with_block:
        parts.append(F.col("block").cast("string"))
    return df.select(F.concat_ws(",", *parts).alias("value"))


def write_layer_text(df: DataFrame, path: str, with_block: bool = True) -> None:
    layer_lines(df, with_block).write.mode("overwrite").text(path)
