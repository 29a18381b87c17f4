"""Class vectors as rows and columns: merge, concatenate, stack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import stack_mean
from ..session import require_columns

KEYS = ("instance", "block")


def as_class_vectors(df: DataFrame, forest: int, keys=KEYS, vector: str = "probability") -> DataFrame:
    """Name the probabilities ``features`` and tag them with the forest id."""
    return df.select(*keys, F.col(vector).alias("features"), F.lit(forest).alias("forest"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def with_block(df: DataFrame, block: int) -> DataFrame:
    return df.withColumn("block", F.lit(block).cast("long"))


def merge_features(df: DataFrame, predictions: DataFrame | None, keys=KEYS) -> DataFrame:
    """Append each row's prediction vector to its features; no predictions, no change.

    Both sides are as large as the table, so this is a shuffled equi-join on the
    row key.  The cascade does not use it: there the vector is made in the same
    row as the features and no join is needed.
    """
    if predictions is None:
        return df
    require_columns(df, *keys, "features")
    pred = predictions.select(*keys, F.col("features").alias("_prediction"))
    return (df.join(pred, list(keys), "inner")
              .withColumn("features", F.concat("features", "_prediction")).drop("_prediction"))


def concat_vectors(predictions: DataFrame, keys=KEYS, order=("forest",), extra=()) -> DataFrame:
    """One vector per row, forests in order.  A group has one record per forest."""
    record = F.struct(*order, "features")
    ordered = F.array_sort(F.collect_list(record))
    firsts = [F.first(c).alias(c) for c in extra]
    return predictions.groupBy(*keys).agg(
        *firsts, F.flatten(F.transform(ordered, lambda r: r["features"])).alias("features"))


def stack_vectors(predictions: DataFrame, num_classes: int, keys=KEYS) -> DataFrame:
    """Mean class vector per row as plain partial sums, one per class."""
    sums = [F.sum(F.get("features", F.lit(k))) for k in range(num_classes)]
    n = F.count(F.lit(1))
    return predictions.groupBy(*keys).agg(F.array(*[s / n for s in sums]).alias("features"))


def stack_concatenated(df: DataFrame, num_classes: int) -> DataFrame:
    return df.withColumn("features", stack_mean("features", num_classes))


def concat_scans(frames: list[DataFrame]) -> DataFrame:
    """Join the windows of several scans into one vector per instance."""
    return concat_vectors(union_all(frames), keys=("instance",),
                          order=("scan_id", "forest", "window"), extra=("label",))


def multi_grain_scan(df: DataFrame, data_style: str = "Seq") -> DataFrame:
    """Sequence data passes through; there is no image scan."""
    if data_style != "Seq":
        raise ValueError("only data_style='Seq' is supported")
    return df


def join_labels(labelled: DataFrame, predictions: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, label, features) with the prediction as features, ready for metrics."""
    pred = predictions.select(*keys, "features")
    return labelled.select(*keys, "label").join(pred, list(keys), "inner")


def to_double_label(df: DataFrame, num_classes: int, column: str = "label") -> DataFrame:
    """Cast the label and pin the class count in its metadata."""
    meta = {"ml_attr": {"type": "nominal", "num_vals": num_classes}}
    return df.withColumn(column, F.col(column).cast("double").alias(column, metadata=meta))
