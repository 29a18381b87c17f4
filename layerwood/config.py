"""Hyper-parameters of the cascade, validated once at construction."""

from __future__ import annotations

import dataclasses
import math

FEATURE_SUBSETS = ("auto", "all", "sqrt", "log2", "onethird")
IMPURITIES = ("gini", "entropy")


@dataclasses.dataclass(frozen=True)
class ForestConfig:
    """One object for every estimator: single forest, block forest, cascade.

    ``rf_num`` / ``crf_num`` are the ordinary and completely random models per
    layer, ``sub_rf_num`` the blocks (hence forests) of each model and
    ``trees`` the trees of each forest.
    """

    num_classes: int = 2
    rf_num: int = 4
    crf_num: int = 4
    sub_rf_num: int = 2
    trees: int = 4
    max_layers: int = 4
    max_depth: int = 30
    max_bins: int = 32
    min_instances: int = 1
    min_info_gain: float = 1e-6
    feature_subset: str = "sqrt"
    crf_feature_subset: str = "log2"
    impurity: str = "gini"
    num_folds: int = 3
    early_stopping_rounds: int = 4
    early_stop_by_test: bool = True
    subsampling_rate: float = 1.0
    data_style: str = "Seq"
    seed: int = 123

    def __post_init__(self):
        def need(ok: bool, message: str):
            if not ok:
                raise ValueError(message)

        need(self.num_classes >= 2, "num_classes must be at least 2")
        need(self.rf_num >= 0 and self.crf_num >= 0, "model counts must not be negative")
        need(self.rf_num + self.crf_num > 0, "a layer needs at least one model")
        for name in ("sub_rf_num", "trees", "max_layers", "min_instances",
                     "num_folds", "early_stopping_rounds"):
            need(getattr(self, name) > 0, f"{name} must be positive")
        need(0 < self.max_depth <= 30, "max_depth must be in 1..30")
        need(2 <= self.max_bins <= 65_536, "max_bins must be in 2..65536")
        need(self.min_info_gain >= 0, "min_info_gain must not be negative")
        need(0 < self.subsampling_rate <= 1, "subsampling_rate must be in (0, 1]")
        need(self.feature_subset in FEATURE_SUBSETS, f"unknown feature_subset {self.feature_subset}")
        need(self.crf_feature_subset in FEATURE_SUBSETS,
             f"unknown crf_feature_subset {self.crf_feature_subset}")
        need(self.impurity in IMPURITIES, f"unknown impurity {self.impurity}")
        need(self.data_style == "Seq",
             "only data_style='Seq' is supported: the image style never produced features")

    @property
    def models_per_layer(self) -> int:
        return self.rf_num + self.crf_num

    def replace(self, **changes) -> ForestConfig:
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


def subset_size(strategy: str, num_features: int, num_trees: int) -> int:
    """Number of candidate features per node."""
    if strategy == "auto":
        strategy = "all" if num_trees == 1 else "sqrt"
    if strategy == "all":
        return num_features
    if strategy == "sqrt":
        return max(1, math.ceil(math.sqrt(num_features)))
    if strategy == "log2":
        return max(1, math.ceil(math.log2(num_features))) if num_features > 1 else 1
    if strategy == "onethird":
        return max(1, math.ceil(num_features / 3.0))
    raise ValueError(f"unknown feature subset strategy {strategy}")
