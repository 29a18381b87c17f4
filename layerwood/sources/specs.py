"""What the input files look like: feature kinds and the dataset registry."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import category_names, one_hot, ordinal


@dataclasses.dataclass(frozen=True)
class FeatureSpec:
    """A number, or a category with known names (slot 0 is the unknown one)."""

    names: tuple[str, ...] = ()

    @property
    def is_number(self) -> bool:
        return not self.names

    @property
    def width(self) -> int:
        return 1 if self.is_number else len(self.names)

    @classmethod
    def parse(cls, line: str) -> FeatureSpec:
        if line.strip() == "C":
            return cls()
        return cls(tuple(category_names(line)))

    def encode(self, text: Column) -> Column:
        """Array of this feature's slots."""
        if self.is_number:
            return F.array(F.trim(text).cast("double"))
        return one_hot(text, list(self.names))

    def code(self, text: Column) -> Column:
        """One number: the value itself, or the index of the category."""
        if self.is_number:
            return F.trim(text).cast("double")
        return ordinal(text, list(self.names))


def numbers(count: int) -> list[FeatureSpec]:
    return [FeatureSpec()] * count


def read_feature_specs(spark: SparkSession, path: str) -> list[FeatureSpec]:
    """One line per feature; the file has as many lines as the table has columns."""
    rows = spark.read.text(path).filter(F.length("value") > 0).collect()
    return [FeatureSpec.parse(r.value) for r in rows]


def encoded_width(specs: list[FeatureSpec]) -> int:
    return sum(s.width for s in specs)


@dataclasses.dataclass(frozen=True)
class DatasetSpec:
    """Column layout of one delimited dataset.

    ``fields`` / ``label_at`` describe the raw file; a layer file has
    ``layer_fields`` columns with a plain numeric label at the end.
    """

    name: str
    num_classes: int
    fields: int
    layer_fields: int
    label_at: int
    label_shift: float = 0.0
    zero_label_text: str | None = None

    def label(self, parts: Column) -> Column:
        text = F.get(parts, F.lit(self.label_at))
        if self.zero_label_text is not None:
            return F.when(F.contains(text, F.lit(self.zero_label_text)), 0.0).otherwise(1.0)
        return F.trim(text).cast("double") + F.lit(self.label_shift)

    def feature_positions(self) -> list[int]:
        return [i for i in range(self.fields) if i != self.label_at]


# Field counts, label places and class counts of the five public datasets.
DATASETS = {
    "uci_adult": DatasetSpec("uci_adult", 2, 15, 115, 14, zero_label_text="<=50K"),
    "covertype": DatasetSpec("covertype", 7, 55, 62, 54, label_shift=-1.0),
    "watch_acc": DatasetSpec("watch_acc", 18, 6, 24, 1, label_shift=-1.0),
    "susy": DatasetSpec("susy", 2, 19, 21, 0),
    "higgs": DatasetSpec("higgs", 2, 29, 31, 0),
}


def dataset_spec(name: str) -> DatasetSpec:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; known: {sorted(DATASETS)}")
    return DATASETS[name]
