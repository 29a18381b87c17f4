"""Cascades: layers of models whose class vectors become features of the next layer.

A layer costs one scan for the bins, one scan of narrow binned rows per tree
level, and one narrow scoring pass.  The scoring pass writes the rows with
their new vectors as the next layer's input, so predictions are never joined
back to the rows and the lineage is cut once per layer.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForestConfig
from ..functions.arrays import argmax, models_mean
from ..operators import metrics as M
from ..operators.sampling import assign_blocks, k_folds
from ..operators.vectors import multi_grain_scan
from ..session import discard, materialize, require_columns
from .forest import fit_layer, ready_rows
from .checks import checked_features, checked_rows
from .grower import STATE_BYTES, Binning, fit_binning, plan_trees
from .scoring import Layer, with_class_vectors
from .store import FitProgress

MEAN, CONCAT = "mean", "concat"


def fed_forward(layer: Layer, feed: str, vector: str = "vector") -> str:
    """SQL for what a layer hands to the next one."""
    return models_mean(vector, layer.num_models, layer.num_classes) if feed == MEAN else vector


@dataclasses.dataclass
class CascadeModel:
    """Layers of models.  ``feed`` tells whether a layer passes on the mean class
    vector or all of its models' vectors; ``history`` has the metrics per layer."""

    layers: list[Layer]
    config: ForestConfig
    num_features: int
    feed: str = MEAN
    history: list[dict] = dataclasses.field(default_factory=list)
    state_bytes: int = STATE_BYTES
    arity: dict[int, int] = dataclasses.field(default_factory=dict)

    @property
    def best_layer(self) -> int:
        by_test = self.config.early_stop_by_test and any(h["split"] == "test" for h in self.history)
        wanted = "test" if by_test else "train"
        return M.best_layer([h["accuracy"] for h in self.history if h["split"] == wanted])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``; all layers run in one narrow pass."""
        require_columns(df, "instance", "features")
        rows = df.withColumn("features", checked_features(F.col("features"), self.num_features, self.arity))
        rows = rows.withColumn("_raw", F.col("features"))
        if "block" not in df.columns:
            rows = rows.withColumn("block", F.lit(0).cast("long"))
        for i, layer in enumerate(self.layers):
            scored = with_class_vectors(rows, layer, "_vector", state_bytes=self.state_bytes)
            if i + 1 < len(self.layers):
                passed_on = F.expr(fed_forward(layer, self.feed, "_vector"))
                rows = scored.withColumn("features", F.concat("_raw", passed_on)).drop("_vector")
            else:
                rows = scored.withColumn("probability", F.expr(fed_forward(layer, MEAN, "_vector")))
        rows = rows.withColumn("features", F.col("_raw"))
        rows = rows.withColumn("prediction", argmax("probability").cast("double"))
        return rows.select(*df.columns, "probability", "prediction")


def feature_count(df: DataFrame, column: str = "features") -> int:
    row = df.select(F.size(column).alias("n")).first()
    if row is None:
        raise ValueError("no training rows")
    return row["n"]


class _Bins:
    """Bins of the raw features are made once; a layer only adds those of its new features."""

    def __init__(self, rows: DataFrame, blocks: list[int], num_features: int, config: ForestConfig, arity):
        self.blocks, self.config = blocks, config
        self.raw = fit_binning(rows, blocks, num_features, config, arity)

    def at(self, rows: DataFrame, extra: int) -> Binning:
        if not extra:
            return self.raw
        added = rows.select("block", F.col("previous").alias("features"))
        return self.raw.extend(fit_binning(added, self.blocks, extra, self.config))


def with_previous(rows: DataFrame) -> DataFrame:
    """Raw features with the previous layer's vector appended."""
    return rows.withColumn("features", F.concat("raw", "previous"))


def score_layer(rows: DataFrame, layer: Layer, feed: str, name: str, state_bytes: int, last: bool, path: str | None = None) -> DataFrame:
    """Class vectors of all rows, written as the next layer's input.

    What the next layer does not read is written for the progress only.  Behind the
    last layer the rows are read once, by its metrics, so they are not written at all.
    """
    keep = [c for c in rows.columns if c not in ("features", "previous", "vector")] + (["vector"] if path else [])
    scored = with_class_vectors(with_previous(rows), layer, "vector", fold=F.col("fold"),
                                state_bytes=state_bytes)
    scored = scored.select(*keep, F.expr(fed_forward(layer, feed)).alias("previous"))
    return scored if last and not path else materialize(scored, name, path)


def layer_report(rows: DataFrame, layer: Layer, layer_id: int) -> list[dict]:
    """Accuracy, macro precision and recall, F1 and kappa of the mean vector (``previous``), by split."""
    table = M.report(M.confusion(rows, by=("split",), vector="previous"), layer.num_classes, by=("split",))
    return [{"layer": layer_id, **r.asDict()} for r in table.collect()]


def block_cascade_rows(train: DataFrame, test: DataFrame | None, config: ForestConfig, num_features: int,
                       arity: dict[int, int] | None, cv: int, named: bool) -> DataFrame:
    """Training and test rows in one written table: instance (if ``named``), block, fold, label, split, row_hash, raw, previous."""
    columns = ["instance", "block", "fold", "label", "features"]
    no_fold = F.lit(-1).alias("fold")
    train = k_folds(train, cv, config.seed, "instance") if cv else train.withColumn("fold", no_fold)
    rows = train.select(*columns, F.lit("train").alias("split"))
    if test is not None:
        held_out = test.withColumns({"block": F.lit(0).cast("long"), "fold": no_fold})
        rows = rows.unionByName(held_out.select(*columns, F.lit("test").alias("split")))
    rows = checked_rows(rows, config.num_classes, num_features, arity)
    rows = ready_rows(rows, config.seed, "block", "instance").withColumnRenamed("features", "raw")
    rows = rows if named else rows.drop("instance")
    return materialize(rows.withColumn("previous", F.array().cast("array<double>")), "layer-input")


def fit_block_cascade(train: DataFrame, test: DataFrame | None, config: ForestConfig,
                      arity: dict[int, int] | None = None, state_bytes: int = STATE_BYTES, cv: int = 0,
                      progress_path: str | None = None, after_layer: Callable[[int], None] | None = None) -> CascadeModel:
    """The block cascade.

    ``train`` has instance, block, label, features: the chosen blocks.  In every
    layer each model draws ``sub_rf_num`` of them, grows one forest per block
    and scores all rows; the mean vector goes on.  ``test`` rows take part in
    scoring only.  Without them early stopping looks at the training rows.

    With ``cv`` folds every forest of a block also grows once without each fold, in
    the same jobs, and a training row is scored by the trees that left its fold
    out, in its own block and in all others.  So no class vector that a layer
    learns from, and no training metric, comes from a tree that saw the row (or
    another row of its instance).  Test rows are scored by the trees on all folds.

    With ``progress_path`` each layer is published there when it is complete, and a
    fit that finds complete layers goes on behind them; ``after_layer`` is called
    with the number of each layer once that is done.
    """
    require_columns(train, "instance", "block", "label", "features")
    if cv < 0 or cv == 1:
        raise ValueError("cv is 0 (none) or at least 2")
    spark = train.sparkSession
    train = multi_grain_scan(train, config.data_style)
    num_features = feature_count(train)
    progress = None if progress_path is None else FitProgress(spark, progress_path, {
        "config": config.to_dict(), "num_features": num_features, "arity": sorted((arity or {}).items()), "cv": cv, "test": test is not None})
    layers, history, rows = progress.last() if progress else ([], [], None)
    if rows is None:
        rows = block_cascade_rows(train, test, config, num_features, arity, cv, named=progress is not None)
    seen = rows.filter("split = 'train'").select("block").distinct().collect()  # one row per block
    blocks = sorted(int(r["block"]) for r in seen)
    randoms = set(range(config.rf_num, config.models_per_layer))
    stop_on = "test" if test is not None and config.early_stop_by_test else "train"
    model = CascadeModel(layers, config, num_features, MEAN, history, state_bytes, dict(arity or {}))
    accuracies = [h["accuracy"] for h in history if h["split"] == stop_on]
    bins = None
    while not (accuracies and M.should_stop(accuracies, config.early_stopping_rounds, config.max_layers)):
        if bins is None:
            bins = _Bins(rows.filter("split = 'train'").withColumn("features", F.col("raw")), blocks, num_features, config, arity)
        layer_id = len(model.layers) + 1
        extra = config.num_classes if layer_id > 1 else 0
        assignment = assign_blocks(blocks, config.models_per_layer, config.sub_rf_num, layer_id, config.seed)
        used = sorted({b for chosen in assignment for b in chosen})
        training = rows.filter((F.col("split") == "train") & F.col("block").isin(used))
        trees = plan_trees(assignment, randoms, num_features + extra, config, layer_id, folds_out=(-1, *range(cv)))
        layer = fit_layer(with_previous(training), trees, bins.at(rows.filter("split = 'train'"), extra),
                          config, state_bytes)
        model.layers.append(layer)
        scored = score_layer(rows, layer, MEAN, f"layer-{layer_id}", state_bytes, layer_id >= config.max_layers,
                             progress.rows_path(layer_id) if progress else None)
        report = layer_report(scored, layer, layer_id)
        discard(rows)
        rows = scored
        model.history += report
        accuracies.append(next(h["accuracy"] for h in report if h["split"] == stop_on))
        if progress:
            progress.publish(layer_id, layer, report)
        if after_layer:
            after_layer(layer_id)
    discard(rows)
    return model


def scored_rows(spark: SparkSession, progress_path: str) -> DataFrame:
    """Rows behind the last published layer: ``vector`` of its models, ``previous`` (what it hands on), fold and split."""
    rows = FitProgress(spark, progress_path, {}).rows()
    if rows is None:
        raise ValueError(f"{progress_path} holds no complete layer")
    return rows


def pooled_layer_accuracy(rows: DataFrame, layer: Layer) -> tuple[int, int]:
    """(right, total) over all models of a layer, whose vectors are in ``previous``: every model votes on its own."""
    k = layer.num_classes
    right = [F.sum((argmax(F.slice("previous", m * k + 1, k)) == F.col("label").cast("int")).cast("long"))
             for m in range(layer.num_models)]
    row = rows.agg(*[r.alias(f"m{m}") for m, r in enumerate(right)], F.count(F.lit(1)).alias("n")).first()
    return sum(row[f"m{m}"] or 0 for m in range(layer.num_models)), row["n"] * layer.num_models


def fit_cascade(train: DataFrame, config: ForestConfig, arity: dict[int, int] | None = None,
                state_bytes: int = STATE_BYTES) -> CascadeModel:
    """The k-fold cascade: each row's vector comes from trees that left its fold out.

    All folds of all forests, and the forests on all rows used for prediction,
    grow in the same jobs.  The models' vectors are passed on concatenated.
    """
    require_columns(train, "instance", "label", "features")
    train = multi_grain_scan(train, config.data_style)
    num_features = feature_count(train)
    rows = checked_rows(train, config.num_classes, num_features, arity)
    rows = k_folds(rows.drop("block", "fold"), config.num_folds, config.seed, "instance")
    rows = ready_rows(rows, config.seed, "instance").withColumnRenamed("features", "raw")
    rows = materialize(rows.drop("instance").withColumn("previous", F.array().cast("array<double>")), "layer-input")
    bins = _Bins(rows.withColumn("features", F.col("raw")), [0], num_features, config, arity)
    randoms = set(range(config.rf_num, config.models_per_layer))
    model = CascadeModel([], config, num_features, CONCAT, [], state_bytes, dict(arity or {}))
    accuracies: list[float] = []
    while True:
        layer_id = len(model.layers) + 1
        extra = config.models_per_layer * config.num_classes if layer_id > 1 else 0
        trees = plan_trees([[0]] * config.models_per_layer, randoms, num_features + extra, config, layer_id,
                           folds_out=(-1, *range(config.num_folds)))
        layer = fit_layer(with_previous(rows), trees, bins.at(rows, extra), config, state_bytes)
        model.layers.append(layer)
        scored = score_layer(rows, layer, CONCAT, f"layer-{layer_id}", state_bytes, layer_id >= config.max_layers)
        right, total = pooled_layer_accuracy(scored, layer)
        discard(rows)
        rows = scored
        accuracies.append(right / max(total, 1))
        model.history.append({"layer": layer_id, "split": "train", "n_right": right, "n_total": total,
                              "accuracy": accuracies[-1]})
        if M.should_stop(accuracies, config.early_stopping_rounds, config.max_layers):
            discard(rows)
            return model


def out_of_fold_vectors(train: DataFrame, config: ForestConfig, is_random: bool,
                        state_bytes: int = STATE_BYTES) -> tuple[DataFrame, Layer]:
    """One forest's out-of-fold vectors for every row, and the forest itself."""
    num_features = feature_count(train)
    train = checked_rows(train, config.num_classes, num_features)
    rows = ready_rows(k_folds(train.drop("block", "fold"), config.num_folds, config.seed, "instance"),
                      config.seed, "instance")
    rows = materialize(rows, "fold-input")
    trees = plan_trees([[0]], {0} if is_random else set(), num_features, config, 1,
                       folds_out=(-1, *range(config.num_folds)))
    layer = fit_layer(rows, trees, fit_binning(rows, [0], num_features, config), config, state_bytes)
    scored = with_class_vectors(rows, layer, "probability", fold=F.col("fold"), state_bytes=state_bytes)
    return scored.select("instance", "fold", "label", "probability"), layer
