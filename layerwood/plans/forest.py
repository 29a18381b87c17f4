"""Single forests: one block of rows, or one forest per block."""

from __future__ import annotations

import dataclasses

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..config import ForestConfig
from ..functions.arrays import argmax
from ..operators.vectors import to_double_label
from ..session import materialize, spread
from .checks import checked_features, checked_rows
from .grower import STATE_BYTES, Binning, Tree, fit_binning, grouped_points, grow, plan_trees, with_row_hash
from .scoring import Layer, with_class_vectors


def ready_rows(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Fill in the optional columns of a training table and spread it over the cores."""
    if "block" not in df.columns:
        df = df.withColumn("block", F.lit(0).cast("long"))
    if "fold" not in df.columns:
        df = df.withColumn("fold", F.lit(-1))
    df = df.withColumn("block", F.col("block").cast("long"))
    keys = keys or ("block", "instance")
    return with_row_hash(spread(df, *keys), seed, *keys)


def fit_layer(rows: DataFrame, trees: list[Tree], binning: Binning, config: ForestConfig,
              state_bytes: int = STATE_BYTES) -> Layer:
    """Train all trees of a layer on (block, fold, row_hash, label, features) rows."""
    points = grouped_points(rows, binning).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Layer(trees, grow(points, trees, binning, config, state_bytes), config.num_classes)
    finally:
        points.unpersist()


@dataclasses.dataclass
class ForestModel:
    """One model (one or several forests voting together)."""

    layer: Layer
    num_features: int
    state_bytes: int = STATE_BYTES
    arity: dict[int, int] = dataclasses.field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``."""
        rows = df if "block" in df.columns else df.withColumn("block", F.lit(0).cast("long"))
        rows = rows.withColumn("features", checked_features(F.col("features"), self.num_features, self.arity))
        out = with_class_vectors(rows, self.layer, "probability", state_bytes=self.state_bytes)
        out = out.withColumn("prediction", argmax("probability").cast("double"))
        return out.select(*df.columns, "probability", "prediction")

    def feature_importances(self) -> DataFrame:
        """(feature, importance): gain times rows, scaled per tree and then over all trees."""
        weight = F.aggregate("counts", F.lit(0.0).cast("double"), lambda acc, x: acc + x)
        per = (self.layer.nodes.filter("not is_leaf").groupBy("tree", "feature")
               .agg(F.sum(F.col("gain") * weight).alias("g")))
        tree_sum = per.groupBy("tree").agg(F.sum("g").alias("t"))
        scaled = (per.join(tree_sum, "tree").filter("t > 0").groupBy("feature")
                  .agg(F.sum(F.col("g") / F.col("t")).alias("s")))
        whole = F.sum("s").over(Window.partitionBy())  # one row per feature
        return scaled.select("feature", (F.col("s") / whole).alias("importance"))


def fit_block_forest(df: DataFrame, config: ForestConfig, is_random: bool, num_features: int,
                     blocks: list[int] | None = None, arity: dict[int, int] | None = None,
                     state_bytes: int = STATE_BYTES) -> ForestModel:
    """One model with one forest per block; the j-th forest sees the j-th block only."""
    blocks = [0] if blocks is None else blocks
    if "block" in df.columns:
        df = df.filter(F.col("block").isin([int(b) for b in blocks]))
    df = checked_rows(df, config.num_classes, num_features, arity)
    rows = ready_rows(df, config.seed).select("block", "fold", "row_hash", "label", "features")
    rows = materialize(rows, "forest-input")
    trees = plan_trees([blocks], {0} if is_random else set(), num_features, config, layer=1)
    binning = fit_binning(rows, blocks, num_features, config, arity)
    return ForestModel(fit_layer(rows, trees, binning, config, state_bytes), num_features, state_bytes, dict(arity or {}))


def fit_forest(df: DataFrame, config: ForestConfig, is_random: bool, num_features: int,
               arity: dict[int, int] | None = None, state_bytes: int = STATE_BYTES) -> ForestModel:
    """One forest on all rows (``block`` is ignored)."""
    return fit_block_forest(df.drop("block"), config, is_random, num_features, None, arity, state_bytes)


def library_forest_vectors(train: DataFrame, test: DataFrame, config: ForestConfig) -> DataFrame:
    """The ordinary forest of Spark's own library, as (…, probability array, prediction)."""
    forest = RandomForestClassifier(
        numTrees=config.trees, maxDepth=config.max_depth, maxBins=config.max_bins, seed=config.seed,
        featureSubsetStrategy=config.feature_subset, minInfoGain=config.min_info_gain,
        minInstancesPerNode=config.min_instances, subsamplingRate=config.subsampling_rate)
    vector = array_to_vector("features")
    model = forest.fit(to_double_label(train.withColumn("features", vector), config.num_classes))
    out = model.transform(test.withColumn("features", vector))
    return (out.withColumn("features", vector_to_array("features"))
            .withColumn("probability", vector_to_array("probability")).drop("rawPrediction"))


