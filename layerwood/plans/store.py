"""Numbered folders on shared storage that count only once they are complete.

A folder is written part by part and gets a line of JSON last.  Readers look at
complete folders only, so they never see half of one, a failed save leaves the
one before it in force, and no store has to rename anything.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, exists, remove
from .grower import Tree
from .scoring import Layer

TREE_SCHEMA = ("tree int, model int, forest int, block long, is_random boolean, bootstrap boolean, "
               "rate double, tree_hash long, subset int, fold_out int")
FIELDS = [f.strip().split(" ")[0] for f in TREE_SCHEMA.split(",")]


def numbered(name: str, number: int) -> str:
    return f"{name}-{number:06d}"


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """All numbers used so far, complete or not."""
    return [int(c.rsplit("-", 1)[1]) for c in children(spark, path) if c.rsplit("-", 1)[0] == name and c.rsplit("-", 1)[1].isdigit()]


def complete(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/complete/_SUCCESS")


def publish(spark: SparkSession, folder: str, facts: dict) -> None:
    """Make a folder count; everything else in it has to be written before."""
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/complete")


def facts_of(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/complete").first()["value"])


def next_version(spark: SparkSession, path: str) -> str:
    return f"{path}/{numbered('version', max(numbers(spark, path, 'version'), default=0) + 1)}"


def current_version(spark: SparkSession, path: str) -> str:
    """The newest complete version."""
    for number in sorted(numbers(spark, path, "version"), reverse=True):
        folder = f"{path}/{numbered('version', number)}"
        if complete(spark, folder):
            return folder
    raise ValueError(f"{path} holds no complete version")


def drop_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the newest complete ones; what failed before them goes too."""
    held = 0
    for number in sorted(numbers(spark, path, "version"), reverse=True):
        folder = f"{path}/{numbered('version', number)}"
        if held >= keep:
            remove(spark, folder)
        held += complete(spark, folder)


def write_layers(spark: SparkSession, layers: list[Layer], folder: str) -> None:
    """Nodes and trees of layers, numbered from 0."""
    tagged = None
    for i, layer in enumerate(layers):
        nodes = layer.nodes.withColumn("layer", F.lit(i))
        tagged = nodes if tagged is None else tagged.unionByName(nodes)
    tagged.write.mode("overwrite").partitionBy("layer").parquet(f"{folder}/nodes")
    trees = [(*[getattr(t, f) for f in FIELDS], i) for i, layer in enumerate(layers) for t in layer.trees]
    spark.createDataFrame(trees, TREE_SCHEMA + ", layer int").write.mode("overwrite").parquet(f"{folder}/trees")


def read_layers(spark: SparkSession, folder: str, num_classes: int) -> list[Layer]:
    trees: dict[int, list[Tree]] = {}
    for r in spark.read.parquet(f"{folder}/trees").orderBy("layer", "tree").collect():
        fields = r.asDict()
        trees.setdefault(fields.pop("layer"), []).append(Tree(**fields))
    nodes: DataFrame = spark.read.parquet(f"{folder}/nodes")
    return [Layer(trees[i], nodes.filter(F.col("layer") == i).drop("layer"), num_classes) for i in sorted(trees)]


class FitProgress:
    """Layers of a fit that goes on after its driver was lost.

    Each layer's scored rows, trees and metrics are published together.  The rows
    hold all that the next layer needs, so a new driver reads the last complete
    layer and nothing of the input.  A fit of another configuration is refused.
    """

    def __init__(self, spark: SparkSession, path: str, identity: dict):
        self.spark, self.path, self.identity = spark, path.rstrip("/"), json.loads(json.dumps(identity))

    def folder(self, layer: int) -> str:
        return f"{self.path}/{numbered('layer', layer)}"

    def rows_path(self, layer: int) -> str:
        return f"{self.folder(layer)}/rows"

    def publish(self, number: int, layer: Layer, history: list[dict]) -> None:
        """The rows are at ``rows_path`` already; those of the layer before are not needed any more."""
        write_layers(self.spark, [layer], self.folder(number))
        publish(self.spark, self.folder(number), {"identity": self.identity, "history": history, "num_classes": layer.num_classes})
        if number > 1:
            remove(self.spark, self.rows_path(number - 1))

    def rows(self) -> DataFrame | None:
        """The rows behind the last complete layer."""
        number = 0
        while complete(self.spark, self.folder(number + 1)):
            number += 1
        return self.spark.read.parquet(self.rows_path(number)) if number else None

    def last(self) -> tuple[list[Layer], list[dict], DataFrame | None]:
        """Layers and metrics of all complete layers, and the rows behind the last one."""
        layers, history = [], []
        while complete(self.spark, self.folder(len(layers) + 1)):
            folder = self.folder(len(layers) + 1)
            facts = facts_of(self.spark, folder)
            if facts["identity"] != self.identity:
                raise ValueError(f"{self.path} holds layers of another fit")
            layers += read_layers(self.spark, folder, facts["num_classes"])
            history += facts["history"]
        return layers, history, self.rows()
