"""Class vectors of rows from a layer's node table."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import normalize
from ..session import materialize
from . import tasks
from .grower import STATE_BYTES, Tree, list_column


@dataclasses.dataclass
class Layer:
    """A trained layer: its trees and one node table."""

    trees: list[Tree]
    nodes: DataFrame
    num_classes: int
    _sizes: dict[int, int] | None = dataclasses.field(default=None, repr=False, compare=False)
    _words: int = dataclasses.field(default=1, repr=False, compare=False)
    _shared: Broadcast | None = dataclasses.field(default=None, repr=False, compare=False)

    @property
    def num_models(self) -> int:
        return max(t.model for t in self.trees) + 1

    def sizes(self) -> dict[int, int]:
        """Nodes by tree, counted once; one row per tree reaches the driver."""
        if self._sizes is None:
            rows = self.nodes.groupBy("tree").agg(F.count("*").alias("n"), F.max(F.size("mask")).alias("words")).collect()
            self._sizes, self._words = {r["tree"]: r["n"] for r in rows}, max((r["words"] for r in rows), default=1)
        return self._sizes

    def size(self) -> int:
        return sum(self.sizes().values())

    def shared_state(self) -> Broadcast:
        """The node arrays of all trees, sent once however often the layer scores."""
        if self._shared is None:
            self._shared = self.nodes.sparkSession.sparkContext.broadcast(layer_state(self, self.trees))
        return self._shared

    def forests(self) -> dict[tuple[int, int, int], int]:
        """A place for the votes of each (model, left-out fold, forest)."""
        return {key: i for i, key in enumerate(sorted({(t.model, t.fold_out, t.forest) for t in self.trees}))}

    def groups(self, state_bytes: int) -> list[list[Tree]]:
        """Trees in runs whose node arrays stay below the bound; one tree at least."""
        sizes = self.sizes()
        per_node, out, held = 48 + 8 * self.num_classes + 8 * self._words, [[]], 0
        for t in self.trees:
            size = per_node * sizes.get(t.tree, 0)
            if out[-1] and held + size > state_bytes:
                out.append([])
                held = 0
            out[-1].append(t)
            held += size
        return out


def layer_state(layer: Layer, trees: list[Tree]) -> dict:
    """Node arrays of some trees for the tasks."""
    own = layer.nodes if len(trees) == len(layer.trees) else layer.nodes.filter(F.col("tree").isin([t.tree for t in trees]))
    table = own.select("tree", "node", "is_leaf", "feature", "kind", "mask", "threshold", "counts").toArrow()
    tree, node = table.column("tree").to_numpy(), table.column("node").to_numpy()
    key = tree.astype(np.int64) << 32 | node
    order = np.argsort(key)
    column = {n: table.column(n).to_numpy()[order] for n in ("is_leaf", "feature", "kind", "threshold")}
    column["mask"] = list_column(table, "mask")[order]
    tree, node, key = tree[order], node[order], key[order]
    # children are found by key and stored side by side, so one index serves both
    child = np.full(len(key), -1, np.int64)
    inner = np.flatnonzero(~column["is_leaf"])
    left = np.searchsorted(key, tree[inner].astype(np.int64) << 32 | (2 * node[inner]))
    child[inner] = left
    counts = list_column(table, "counts")[order]
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)
    roots = dict(zip(tree[node == 1].tolist(), np.flatnonzero(node == 1).tolist()))
    places = layer.forests()
    return {"num_classes": layer.num_classes, "num_forests": len(places),
            "roots": [(t.fold_out, places[t.model, t.fold_out, t.forest], roots[t.tree]) for t in trees if t.tree in roots],
            "nodes": {"child": child, "shares": shares, **column,
                      "has_categories": bool((column["kind"] != 0).any())}}


def list_array(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def members_of(layer: Layer) -> dict[int, list[tuple[int, int]]]:
    """By left-out fold the (model, place) of its forests."""
    members: dict[int, list[tuple[int, int]]] = {}
    for (model, fold_out, _), at in layer.forests().items():
        members.setdefault(fold_out, []).append((model, at))
    return members


# Spark may evaluate a deterministic function again wherever its result is filtered or
# exploded; these are expensive, so they are marked as not to be repeated.

def whole_column(layer: Layer, features: Column, fold: Column) -> Column:
    """Features to class vectors in one step, by the node arrays of all trees."""
    shared, members, models, classes = layer.shared_state(), members_of(layer), layer.num_models, layer.num_classes

    @F.arrow_udf("array<double>")
    def vectors(values: pa.Array, folds: pa.Array) -> pa.Array:
        folds = np.asarray(folds)
        return list_array(tasks.class_vectors(tasks.forest_votes(tasks.matrix(values), folds, shared.value), folds, members, models, classes))

    return vectors.asNondeterministic()(features, fold)


def votes_column(layer: Layer, trees: list[Tree], features: Column, fold: Column, votes: Column | None) -> Column:
    """The votes so far, if any, with those of some trees added; a narrow pass with broadcast node arrays."""
    shared = layer.nodes.sparkSession.sparkContext.broadcast(layer_state(layer, trees))
    width = len(layer.forests()) * layer.num_classes

    @F.arrow_udf("array<double>")
    def first(vectors: pa.Array, folds: pa.Array) -> pa.Array:
        return list_array(tasks.forest_votes(tasks.matrix(vectors), np.asarray(folds), shared.value))

    @F.arrow_udf("array<double>")
    def add(vectors: pa.Array, folds: pa.Array, before: pa.Array) -> pa.Array:
        return list_array(tasks.matrix(before, width) + tasks.forest_votes(tasks.matrix(vectors), np.asarray(folds), shared.value))

    return first.asNondeterministic()(features, fold) if votes is None else add.asNondeterministic()(features, fold, votes)


def class_vector_column(layer: Layer, votes: Column, fold: Column) -> Column:
    """Votes to one vector of models x classes: a forest's votes, then a model's, are scaled to 1."""
    members, places, classes, models = members_of(layer), len(layer.forests()), layer.num_classes, layer.num_models

    @F.arrow_udf("array<double>")
    def vectors(summed: pa.Array, folds: pa.Array) -> pa.Array:
        return list_array(tasks.class_vectors(tasks.matrix(summed, places * classes), np.asarray(folds), members, models, classes))

    return vectors.asNondeterministic()(votes, fold)


def forest_votes(votes: DataFrame, num_classes: int, keys) -> DataFrame:
    """Sum over trees (keys, model, forest, counts) of leaf shares, scaled to 1 per forest; empty leaves do not vote."""
    share = normalize("counts")
    sums = votes.withColumn("_s", share).groupBy(*keys, "model", "forest").agg(
        *[F.sum(F.get("_s", F.lit(k))).alias(f"v{k}") for k in range(num_classes)])
    vector = F.array(*[F.col(f"v{k}") for k in range(num_classes)])
    return sums.select(*keys, "model", "forest", normalize(vector).alias("probability"))


def with_class_vectors(df: DataFrame, layer: Layer, output: str = "vector", fold: Column | None = None,
                       state_bytes: int = STATE_BYTES) -> DataFrame:
    """Add the models' concatenated class vectors to rows with ``features``.

    ``fold`` is the fold a row belongs to: trees that left it out vote; without it
    the trees that left no fold out do.  While all node arrays stay below the byte
    bound that is one call per row; beyond it trees vote in groups, one narrow pass
    each, and the rows are written between the passes, so that a task holds one group
    at a time.  Rows are never joined, so ids may be null or repeat.  A row whose
    trees saw no row at all gets zeros.
    """
    rows = df.withColumn("_fold", F.lit(-1) if fold is None else fold)
    groups = layer.groups(state_bytes)
    if len(groups) == 1:
        return rows.withColumn(output, whole_column(layer, F.col("features"), F.col("_fold"))).drop("_fold")
    for i, trees in enumerate(groups):
        before = F.col("_votes") if i else None
        rows = rows.withColumn("_votes", votes_column(layer, trees, F.col("features"), F.col("_fold"), before))
        if i + 1 < len(groups):
            rows = materialize(rows, "votes")
    return rows.withColumn(output, class_vector_column(layer, F.col("_votes"), F.col("_fold"))).drop("_votes", "_fold")
