"""Save and load models: versions of a tree table, a node table by layer and one JSON line."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import ForestConfig
from .cascade import CascadeModel
from .forest import ForestModel
from .scoring import Layer
from .store import current_version, drop_versions, facts_of, next_version, publish, read_layers, write_layers

#: Complete versions kept by a save.
KEPT = 2


def _save(spark: SparkSession, layers: list[Layer], path: str, meta: dict) -> None:
    """A version of its own; it becomes the current one when its last line is written."""
    folder = next_version(spark, path)
    write_layers(spark, layers, folder)
    publish(spark, folder, meta)
    drop_versions(spark, path, KEPT)


def _load(spark: SparkSession, path: str, kind: str) -> tuple[dict, list[Layer]]:
    folder = current_version(spark, path)
    meta = facts_of(spark, folder)
    if meta["type"] != kind:
        raise ValueError(f"{path} holds a {meta['type']}")
    return meta, read_layers(spark, folder, meta["num_classes"])


def save_cascade(model: CascadeModel, path: str) -> None:
    spark = model.layers[0].nodes.sparkSession
    _save(spark, model.layers, path, {
        "type": "cascade", "num_classes": model.config.num_classes, "num_features": model.num_features,
        "feed": model.feed, "config": model.config.to_dict(), "history": model.history,
        "state_bytes": model.state_bytes, "arity": sorted(model.arity.items())})


def load_cascade(spark: SparkSession, path: str) -> CascadeModel:
    meta, layers = _load(spark, path, "cascade")
    return CascadeModel(layers, ForestConfig(**meta["config"]), meta["num_features"],
                        meta["feed"], meta["history"], meta["state_bytes"], {f: n for f, n in meta["arity"]})


def save_forest(model: ForestModel, path: str) -> None:
    layer = model.layer
    _save(layer.nodes.sparkSession, [layer], path, {
        "type": "forest", "num_classes": layer.num_classes, "num_features": model.num_features,
        "num_trees": len(layer.trees), "state_bytes": model.state_bytes, "arity": sorted(model.arity.items())})


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    meta, layers = _load(spark, path, "forest")
    return ForestModel(layers[0], meta["num_features"], meta["state_bytes"], {f: n for f, n in meta["arity"]})
