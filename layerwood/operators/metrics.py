"""Accuracy, macro precision, macro F1 and Cohen's kappa from one confusion table.

The confusion table has at most classes^2 rows per group and is made with
partial aggregation, so every metric costs one narrow pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..session import require_columns

NAN = float("nan")


def confusion(df: DataFrame, by=(), vector: str | None = "features",
              prediction: str | None = None) -> DataFrame:
    """(by..., label, predicted, n) with integer classes."""
    if prediction is None:
        require_columns(df, *by, "label", vector)
        predicted = argmax(vector)
    else:
        require_columns(df, *by, "label", prediction)
        predicted = F.col(prediction).cast("int")
    return (df.select(*by, F.col("label").cast("int").alias("label"), predicted.alias("predicted"))
              .groupBy(*by, "label", "predicted").agg(F.count(F.lit(1)).alias("n")))


def accuracy(counts: DataFrame, by=()) -> DataFrame:
    """right, total and their ratio; an empty set has accuracy 0."""
    right = F.coalesce(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))), F.lit(0))
    n = F.coalesce(F.sum("n"), F.lit(0))
    base = counts.groupBy(*by).agg(right.alias("n_right"), n.alias("n_total"))
    return base.withColumn("accuracy", F.col("n_right") / F.greatest(F.col("n_total"), F.lit(1)))


def class_counts(counts: DataFrame, num_classes: int, by=()) -> DataFrame:
    """(by..., class, tp, fp, fn); every class appears, also the absent ones."""
    label, predicted, n = F.col("label"), F.col("predicted"), F.col("n")
    spread = counts.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))))
    c = F.col("class")

    def total(condition):
        return F.sum(F.when(condition, n).otherwise(F.lit(0)))

    return spread.groupBy(*by, "class").agg(
        total((label == c) & (predicted == c)).alias("tp"),
        total((label != c) & (predicted == c)).alias("fp"),
        total((label == c) & (predicted != c)).alias("fn"))


def report(counts: DataFrame, num_classes: int, by=()) -> DataFrame:
    """One row per group with all four metrics.

    Macro values average over all classes; a class that is never predicted
    counts 0.  F1 is the harmonic mean of macro precision and macro recall and
    is NaN when both are 0; kappa is NaN when chance agreement is complete.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = F.lit(1).cast("long")
    sums = class_counts(counts, num_classes, by).groupBy(*by).agg(
        F.sum("tp").alias("n_right"), F.sum(tp + fp).alias("n_total"),
        F.avg(tp / F.greatest(tp + fp, one)).alias("precision"),
        F.avg(tp / F.greatest(tp + fn, one)).alias("recall"),
        F.sum(((tp + fp) * (tp + fn)).cast("double")).alias("_agree"))
    total = F.greatest(F.col("n_total"), one).cast("double")
    p, r = F.col("precision"), F.col("recall")
    p0, pe = F.col("accuracy"), F.col("_pe")
    return (sums.withColumn("accuracy", F.col("n_right") / total)
            .withColumn("_pe", F.col("_agree") / (total * total))
            .withColumn("f1", F.when(p + r == 0, F.lit(NAN)).otherwise(2.0 * p * r / (p + r)))
            .withColumn("kappa", F.when(pe == 1.0, F.lit(NAN)).otherwise((p0 - pe) / (F.lit(1.0) - pe)))
            .drop("_agree", "_pe"))


def pooled_accuracy(parts: DataFrame, by=()) -> DataFrame:
    """Merge (n_right, n_total) of folds or forests: a weighted ratio, not a mean of ratios."""
    return parts.groupBy(*by).agg(
        F.sum("n_right").alias("n_right"), F.sum("n_total").alias("n_total")).withColumn(
        "accuracy", F.col("n_right") / F.greatest(F.col("n_total"), F.lit(1)))


def pooled_report(parts: DataFrame, num_classes: int, by=()) -> DataFrame:
    """All metrics from the added confusion tables of folds or forests, not from means of their metrics."""
    return report(parts.groupBy(*by, "label", "predicted").agg(F.sum("n").alias("n")), num_classes, by)


def best_layer(accuracies: list[float]) -> int:
    """1-based index of the first best layer."""
    return accuracies.index(max(accuracies)) + 1


def should_stop(accuracies: list[float], rounds: int, max_layers: int) -> bool:
    layer = len(accuracies)
    return layer == max_layers or layer - best_layer(accuracies) >= rounds
