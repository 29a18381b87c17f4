"""Checks of rows on their way into fitting and scoring: a bad row is an error, never a wrong number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fail(text: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), F.coalesce(value.cast("string"), F.lit("null"))))


def checked_label(label: Column, num_classes: int) -> Column:
    """The label, which must be a whole number from 0 to below ``num_classes``."""
    x = label.cast("double")
    fine = x.isNotNull() & (x >= 0) & (x < num_classes) & (x == F.floor(x))
    return F.when(F.coalesce(fine, F.lit(False)), label).otherwise(fail(f"label outside 0..{num_classes - 1}: ", label).cast("double"))


def checked_features(features: Column, width: int, arity: dict[int, int] | None = None) -> Column:
    """The vector, which must have ``width`` numbers, none null, and category codes below their arity."""
    fine = features.isNotNull() & (F.size(features) == width) & ~F.exists(features, lambda x: x.isNull())
    for f, codes in sorted((arity or {}).items()):
        x = F.get(features, F.lit(f))
        fine = fine & (x >= 0) & (x < codes) & (x == F.floor(x))
    return F.when(F.coalesce(fine, F.lit(False)), features).otherwise(
        fail(f"features need {width} numbers and known category codes: ", features).cast("array<double>"))


def checked_rows(df: DataFrame, num_classes: int, width: int, arity: dict[int, int] | None = None) -> DataFrame:
    return df.withColumns({"label": checked_label(F.col("label"), num_classes),
                           "features": checked_features(F.col("features"), width, arity)})
