"""Grow every tree of a layer at once, level by level.

Each level is one job: tasks walk their groups of equal binned rows down the trees known so
far and emit partial class counts, Spark merges them by (tree, node) and picks
the cuts, and one row per open node comes back to the driver.  The binned rows
never change, so a lost executor only recomputes its own rows and no lineage
builds up.

The trees known so far travel as a broadcast.  Its size in bytes is checked before
every level; a group of trees beyond ``state_bytes`` is halved, and the halves
grow on one after the other, each reading only the blocks of its own trees.  One
tree is the smallest group.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ForestConfig, subset_size
from ..functions.hashing import MIX_RANGE, key_hash, key_hash_value, mix_array
from ..operators import splits as S
from ..operators.sampling import poisson_cdf
from ..session import materialize, require_columns
from . import tasks

STATE_BYTES = 256 << 20
NODE_SCHEMA = ("tree int, node long, is_leaf boolean, feature int, kind int, cut int, mask array<long>, "
               "threshold double, gain double, counts array<double>")


@dataclasses.dataclass(frozen=True)
class Tree:
    """One tree: which model and forest it votes in, and which rows it sees.

    It trains on the rows of ``block`` except those of fold ``fold_out``
    (-1: no fold is left out).
    """

    tree: int
    model: int
    forest: int
    block: int
    is_random: bool
    bootstrap: bool
    rate: float
    tree_hash: int
    subset: int
    fold_out: int = -1


def plan_trees(assignment: list[list[int]], random_models: set[int], num_features: int,
               config: ForestConfig, layer: int, folds_out=(-1,)) -> list[Tree]:
    """Trees of a layer: model m has one forest per assigned block, for every
    left-out fold.  Completely random trees use the whole block, ordinary ones
    a bootstrap draw when the forest has more than one tree."""
    out = []
    for model, blocks in enumerate(assignment):
        is_random = model in random_models
        strategy = config.crf_feature_subset if is_random else config.feature_subset
        size = subset_size(strategy, num_features, config.trees)
        for forest, block in enumerate(blocks):
            for fold_out in folds_out:
                for _ in range(config.trees):
                    tree = len(out)
                    out.append(Tree(tree, model, forest, block, is_random,
                                    not is_random and config.trees > 1, config.subsampling_rate,
                                    key_hash_value(config.seed, layer, tree), size, fold_out))
    return out


# ---------------------------------------------------------------- features to bins

@dataclasses.dataclass
class Binning:
    """Per block: edges (values), thresholds (midpoints), both by feature.

    None marks a categorical feature.  The size is blocks x features x max_bins
    numbers, fixed by the configuration and independent of the rows.
    """

    edges: dict[int, list]
    thresholds: dict[int, list]
    arity: dict[int, int]
    kinds: list[int]

    def num_splits(self, block: int) -> np.ndarray:
        out = []
        for f, edge in enumerate(self.edges[block]):
            kind = self.kinds[f]
            if kind == S.CONTINUOUS:
                out.append(len(edge))
            elif kind == S.ORDERED:
                out.append(self.arity[f] - 1)
            else:
                out.append((1 << (self.arity[f] - 1)) - 1)
        return np.array(out, np.int64)

    @property
    def bin_type(self) -> str:
        """One byte per bin while all bins and categories fit it, else two."""
        most = max([len(e) for features in self.edges.values() for e in features if e is not None] + [a - 1 for a in self.arity.values()], default=0)
        return "u1" if most < 256 else "<u2"

    def extend(self, other: Binning) -> Binning:
        """Append the features of another binning of the same blocks."""
        shift = len(self.kinds)
        return Binning({b: self.edges[b] + other.edges[b] for b in self.edges},
                       {b: self.thresholds[b] + other.thresholds[b] for b in self.edges},
                       {**self.arity, **{f + shift: a for f, a in other.arity.items()}},
                       self.kinds + other.kinds)


def feature_kinds(num_features: int, arity: dict[int, int], config: ForestConfig) -> list[int]:
    """Few-valued categories of a multiclass target are split by subsets, others by order."""
    limit = int(math.log2(config.max_bins // 2 + 1) + 1)
    kinds = []
    for f in range(num_features):
        if f not in arity:
            kinds.append(S.CONTINUOUS)
            continue
        if arity[f] > config.max_bins:
            raise ValueError(f"feature {f} has {arity[f]} categories, more than max_bins")
        kinds.append(S.UNORDERED if config.num_classes > 2 and arity[f] <= limit else S.ORDERED)
    return kinds


def sample_edges(df: DataFrame, max_splits: int, seed: int, skip=()) -> dict[tuple[int, int], np.ndarray]:
    """Uniform sample of at most ``max_splits`` distinct values per (block, feature),
    never the largest one: {(block, feature): sorted values}.

    One scan: every task hands on a sketch of its smallest hashes, one value more
    than wanted in case the largest is among them.  The values of a group's smallest
    hashes are in the sketches of all tasks that saw them, so the merged sketch is
    exact without any count before it.
    """
    keep = max_splits + 1
    sketches = df.select("block", "features").mapInArrow(
        lambda it: tasks.smallest_hashes(it, keep, seed, skip), "block long, feature int, hash long, value double, top double")
    merged = sketches.groupBy("block", "feature", "hash", "value").agg(F.max("top").alias("top"))
    order = Window.partitionBy("block", "feature").orderBy("hash", "value")
    # without an order the window takes in the whole group
    merged = merged.withColumns({"r": F.row_number().over(order), "top": F.max("top").over(Window.partitionBy("block", "feature"))})
    # one row per (block, feature, kept value): the size is fixed by the configuration
    out: dict[tuple[int, int], list] = {}
    for r in merged.filter((F.col("r") <= keep)).orderBy("block", "feature", "r").collect():
        held = out.setdefault((r["block"], r["feature"]), [])
        if r["value"] is not None and (r["value"] < r["top"] or math.isnan(r["top"])) and len(held) < max_splits:
            held.append(r["value"])
    return {key: np.array(sorted(v), np.float64) for key, v in out.items()}


def fit_binning(df: DataFrame, blocks: list[int], num_features: int, config: ForestConfig,
                arity: dict[int, int] | None = None) -> Binning:
    """Edges and thresholds of the training rows ``(block, features)``."""
    arity = arity or {}
    kinds = feature_kinds(num_features, arity, config)
    sampled = sample_edges(df.select("block", "features"), config.max_bins - 1, config.seed, tuple(arity))
    none = np.array([], np.float64)
    edges = {b: [None if f in arity else sampled.get((b, f), none) for f in range(num_features)] for b in blocks}
    shared = df.sparkSession.sparkContext.broadcast(edges)
    lows = (df.select("block", "features")
            .mapInArrow(lambda it: tasks.lowest_above(it, shared.value),
                        "block long, feature int, bin int, low double")
            .groupBy("block", "feature", "bin").agg(F.min("low").alias("low")).collect())
    above = {(r["block"], r["feature"], r["bin"]): r["low"] for r in lows}
    shared.unpersist()
    thresholds = {b: [None if e is None else np.array(
        [(v + above.get((b, f, i + 1), v)) / 2.0 for i, v in enumerate(e)])
        for f, e in enumerate(edges[b])] for b in blocks}
    return Binning(edges, thresholds, arity, kinds)


def with_row_hash(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.withColumn("row_hash", key_hash(seed, *keys))


def _binned(df: DataFrame, binning: Binning, then, schema: str) -> DataFrame:
    require_columns(df, "block", "fold", "row_hash", "label", "features")
    shared, bin_type = df.sparkSession.sparkContext.broadcast(binning.edges), binning.bin_type
    return df.select("block", "fold", "row_hash", F.col("label").cast("int").alias("label"), "features").mapInArrow(
        lambda it: then(tasks.binned_batches(it, shared.value, bin_type)), schema)


def bin_points(df: DataFrame, binning: Binning) -> DataFrame:
    """One narrow row (block, fold, row_hash, label, bins) per training row; a bin takes one byte or two."""
    return _binned(df, binning, lambda batches: batches, "block long, fold int, row_hash long, label int, bins binary")


def grouped_points(df: DataFrame, binning: Binning) -> DataFrame:
    """Binned rows that differ in their hash only, as one row (block, fold, label, bins, hashes).

    Each task groups the rows that it holds at a time, ordered by block (no shuffle), so a
    tree is walked once per group; only the draws of bootstrap trees cost a step per row.
    """
    return _binned(df, binning, tasks.grouped_batches, "block long, fold int, label int, bins binary, hashes binary")


# ---------------------------------------------------------------- driver-side tree table

class NodeArrays:
    """The nodes found so far, as columns; children of a node are neighbours."""

    def __init__(self, trees: list[Tree], num_classes: int, words: int = 1):
        n = len(trees)
        self.columns = {
            "tree": np.array([t.tree for t in trees], np.int32), "node": np.ones(n, np.int64),
            "child": np.full(n, -1, np.int64), "feature": np.zeros(n, np.int32),
            "kind": np.zeros(n, np.int32), "cut": np.zeros(n, np.int32), "mask": np.zeros((n, words), np.int64),
            "gain": np.zeros(n), "counts": np.zeros((n, num_classes))}
        self.open = np.arange(n)

    def __len__(self):
        return len(self.columns["tree"])

    def roots(self) -> dict[int, int]:
        at = np.flatnonzero(self.columns["node"] == 1)
        return dict(zip(self.columns["tree"][at].tolist(), at.tolist()))

    def state_bytes(self, trees: list[Tree]) -> int:
        """Size of what a level sends to the tasks: nodes, and candidates of the open ones."""
        width = max(t.subset for t in trees) + 1
        return (40 + 8 * self.columns["mask"].shape[1]) * len(self) + (16 + 12 * width) * len(self.open)

    def part(self, members: list[int]) -> NodeArrays:
        """The nodes of some trees."""
        keep = np.isin(self.columns["tree"], members)
        place = np.cumsum(keep) - 1
        out = object.__new__(NodeArrays)
        out.columns = {n: v[keep] for n, v in self.columns.items()}
        child = out.columns["child"]
        out.columns["child"] = np.where(child >= 0, place[np.maximum(child, 0)], -1)
        out.open = place[self.open[keep[self.open]]]
        return out

    def halves(self) -> list[list[int]]:
        """The trees in two runs with about equally many nodes."""
        names, sizes = np.unique(self.columns["tree"], return_counts=True)
        cut = min(max(int(np.searchsorted(np.cumsum(sizes), len(self) / 2)) + 1, 1), len(names) - 1)
        return [names[:cut].tolist(), names[cut:].tolist()]

    def apply(self, found: dict, num_classes: int) -> None:
        """Store the decisions of one level and open the children that may split."""
        c, front = self.columns, self.open
        keys = c["tree"][front].astype(np.int64) << 32 | c["node"][front]
        order = np.argsort(keys)
        at = front[order[np.searchsorted(keys[order], found["tree"].astype(np.int64) << 32 | found["node"])]]
        roots = c["node"][at] == 1
        if roots.any():
            c["counts"][at[roots]] = found["counts"][roots]
        split = ~found["is_leaf"]
        at = at[split]
        for name in ("feature", "kind", "cut", "mask", "gain"):
            c[name][at] = found[name][split].reshape(len(at), *c[name].shape[1:])
        n, start = len(at), len(self)
        c["child"][at] = start + 2 * np.arange(n)
        if not n:
            self.open = np.array([], np.int64)
            return
        left, right = found["left"][split], found["counts"][split] - found["left"][split]
        added = {name: np.zeros((2 * n, *column.shape[1:]), column.dtype) for name, column in c.items()}
        added["tree"] = np.repeat(c["tree"][at], 2)
        added["node"] = np.stack([2 * c["node"][at], 2 * c["node"][at] + 1], 1).ravel()
        added["child"] = np.full(2 * n, -1, np.int64)
        added["counts"] = np.stack([left, right], 1).reshape(-1, num_classes)
        done = np.stack([found["left_leaf"][split], found["right_leaf"][split]], 1).ravel()
        for name in c:
            c[name] = np.concatenate([c[name], added[name]])
        self.open = start + np.flatnonzero(~done)

    def known(self) -> np.ndarray:
        """Positions of all nodes but the roots of trees that saw no row."""
        c = self.columns
        return np.flatnonzero((c["counts"].sum(1) > 0) | (c["node"] != 1))

    def frame(self, spark: SparkSession, trees: list[Tree], binning: Binning, rows=None) -> DataFrame:
        c = self.columns
        rows = self.known() if rows is None else rows
        blocks = sorted(binning.edges)
        grid = np.zeros((len(blocks), len(binning.kinds), max(
            [1] + [len(v) for b in blocks for v in binning.thresholds[b] if v is not None])))
        for i, b in enumerate(blocks):
            for f, values in enumerate(binning.thresholds[b]):
                if values is not None:
                    grid[i, f, :len(values)] = values
        block_of = np.searchsorted(blocks, [t.block for t in trees])
        uses = (c["child"][rows] >= 0) & (c["kind"][rows] == S.CONTINUOUS)
        cut = np.where(uses, c["cut"][rows], 0)
        thresholds = np.where(uses, grid[block_of[c["tree"][rows]], c["feature"][rows], cut], 0.0)
        counts = c["counts"][rows]
        table = pa.table({
            "tree": c["tree"][rows], "node": c["node"][rows], "is_leaf": c["child"][rows] < 0,
            "feature": c["feature"][rows], "kind": c["kind"][rows], "cut": c["cut"][rows],
            "mask": listed(c["mask"][rows]), "threshold": thresholds, "gain": c["gain"][rows], "counts": listed(counts)})
        return spark.createDataFrame(table, NODE_SCHEMA)


def candidate_arrays(trees: list[Tree], binning: Binning, tree: np.ndarray, node: np.ndarray, with_totals: bool):
    """Candidate features, kinds and cuts of the open nodes; unused places hold -2."""
    width = max(t.subset for t in trees)
    subset = np.array([t.subset for t in trees])
    tree_hash = np.array([t.tree_hash for t in trees], np.int64)
    is_random = np.array([t.is_random for t in trees])
    blocks = sorted(binning.edges)
    place = {b: i for i, b in enumerate(blocks)}
    block_of = np.array([place[t.block] for t in trees])
    num_splits = np.stack([binning.num_splits(b) for b in blocks])
    kinds = np.array(binning.kinds, np.int32)
    out = []
    for start in range(0, len(tree), 100_000):
        t, n = tree[start:start + 100_000], node[start:start + 100_000]
        h = mix_array(mix_array(tree_hash[t], n)[:, None], np.arange(len(kinds))[None, :])
        feature = np.argsort(h, axis=1, kind="stable")[:, :width].astype(np.int32)
        h = np.take_along_axis(h, feature, 1)
        splits = num_splits[block_of[t][:, None], feature]
        cut = np.where(is_random[t][:, None], mix_array(h, S.CUT_SALT) % np.maximum(splits, 1), S.ALL_CUTS)
        unused = (splits <= 0) | (np.arange(feature.shape[1])[None, :] >= subset[t][:, None])
        kind = kinds[feature]
        feature = np.where(unused, -2, feature)
        if with_totals:
            one = np.ones((len(t), 1), np.int32)
            feature, kind = np.hstack([S.TOTALS * one, feature]), np.hstack([S.CONTINUOUS * one, kind])
            cut = np.hstack([S.ALL_CUTS * one, cut])
        out.append((feature.astype(np.int32), kind.astype(np.int32), cut.astype(np.int32)))
    return [np.concatenate(parts) for parts in zip(*out)]


def task_trees(trees: list[Tree], roots: dict[int, int]) -> dict[int, list[dict]]:
    by_block: dict[int, list[dict]] = {}
    for t in (t for t in trees if t.tree in roots):
        by_block.setdefault(t.block, []).append({
            "tree": t.tree, "root": roots[t.tree], "tree_hash": t.tree_hash, "bootstrap": t.bootstrap,
            "rate": t.rate, "fold_out": t.fold_out,
            "poisson": np.array([int(p * MIX_RANGE) for p in poisson_cdf(t.rate)], np.int64)})
    return by_block


def level_state(nodes: NodeArrays, trees: list[Tree], binning: Binning, config: ForestConfig, level: int) -> dict:
    c, front = nodes.columns, nodes.open
    feature, kind, cut = candidate_arrays(trees, binning, c["tree"][front], c["node"][front], level == 0)
    slot = np.full(len(nodes), -1, np.int64)
    slot[front] = np.arange(len(front))
    return {"trees": task_trees(trees, nodes.roots()), "bin_type": binning.bin_type, "num_classes": config.num_classes, "num_bins": config.max_bins + 1,
            "slot_tree": c["tree"][front], "slot_node": c["node"][front],
            "cand_feature": feature, "cand_kind": kind, "cand_cut": cut,
            "nodes": {**{k: c[k] for k in ("child", "feature", "kind", "cut", "mask")}, "slot": slot,
                      "has_categories": bool(binning.arity)}}


def listed(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


def list_column(table: pa.Table, name: str) -> np.ndarray:
    """A list column of equal lengths as a 2-d array; without rows its width is 0."""
    column = table.column(name).combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1 if len(column) else 0)


def read_level(table: pa.Table) -> dict:
    out = {n: table.column(n).to_numpy() for n in (
        "tree", "node", "feature", "kind", "cut", "gain", "is_leaf", "left_leaf", "right_leaf")}
    return {**out, **{n: list_column(table, n) for n in ("left", "counts", "mask")}}


def choose_level(histogram: DataFrame, config: ForestConfig, kinds, level: int, words: int = 1) -> DataFrame:
    candidates = S.candidate_splits(histogram, config.num_classes, sorted(set(kinds)), config.impurity, words)
    best = S.best_split(candidates, config.num_classes, config.impurity, config.min_instances,
                        config.min_info_gain)
    return S.expand_nodes(best, level, config.max_depth, config.num_classes, config.impurity,
                          config.min_info_gain)


def grow(points: DataFrame, trees: list[Tree], binning: Binning, config: ForestConfig,
         state_bytes: int = STATE_BYTES) -> DataFrame:
    """Node table of all trees, from grouped points."""
    spark = points.sparkSession
    fields = "tree int, node long, feature int, kind int, cut int, bin int, " + ", ".join(
        f"{c} double" for c in S.count_columns(config.num_classes))
    words = S.words_for(max(binning.arity.values(), default=0))
    todo, done = [(NodeArrays(trees, config.num_classes, words), 0)], []
    while todo:
        nodes, level = todo.pop()
        while level < config.max_depth and len(nodes.open):
            if nodes.state_bytes(trees) > state_bytes and len(nodes.roots()) > 1:
                todo += [(nodes.part(half), level) for half in reversed(nodes.halves())]
                break
            blocks = sorted({t.block for t in trees if t.tree in nodes.roots()})
            shared = spark.sparkContext.broadcast(level_state(nodes, trees, binning, config, level))
            own = points.filter(F.col("block").isin(blocks))
            partial = own.mapInArrow(lambda it, s=shared: tasks.histogram_batches(it, s.value), fields)
            # partial counts are merged inside each task; one shuffle by node and feature serves
            # the merge, the prefix sums and the feature's best cut, so even a root is merged by
            # as many tasks as it has candidates; then one row per feature goes to its node
            merged = S.merge_histogram(partial.repartition("tree", "node", "feature"), config.num_classes)
            nodes.apply(read_level(choose_level(merged, config, binning.kinds, level, words).toArrow()), config.num_classes)
            shared.unpersist()
            level += 1
        else:
            done.append(nodes.frame(spark, trees, binning))
            if todo or len(done) > 1:
                done[-1] = materialize(done[-1], "nodes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
