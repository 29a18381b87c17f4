"""Cascades against their SQL twins: two layers, left-out folds, a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForestConfig
from ..operators import splits as S
from ..plans.cascade import MEAN, CascadeModel, fed_forward, fit_block_cascade, scored_rows
from ..plans.checks import checked_rows
from ..plans.forest import fit_layer, ready_rows
from ..plans.grower import fit_binning, plan_trees
from ..plans.scoring import Layer, with_class_vectors
from ..session import new_path
from .cascade_sql import layers_sql, node_rows, probabilities
from .models import SMALL, block_plan, blocked_lines, blocked_rows_sql
from .registry import query, sql_hash, table

#: Two layers, small enough for SQL, with every kind of tree and two forests in a model.
TWO_LAYERS = SMALL.replace(rf_num=1, crf_num=1, trees=2, max_depth=2)
FOLDED = SMALL.replace(rf_num=1, crf_num=1, trees=2, max_depth=3, max_layers=1)


TWO_LAYERS_SQL = layers_sql(blocked_rows_sql(TWO_LAYERS.seed), 4, TWO_LAYERS, block_plan(TWO_LAYERS), 2)


@query("block_cascade_two_layers", f"""{TWO_LAYERS_SQL}
{probabilities(TWO_LAYERS, 'mean_2', 'inst AS instance, label::DOUBLE AS label', where="split = 'test'")}""")
def block_cascade_two_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block cascade of two layers of depth two: class probabilities of all held-out rows."""
    train, test = blocked_lines(spark, sf_dir)
    out = fit_block_cascade(train, test, TWO_LAYERS).transform(test)
    return out.select("instance", "label", F.posexplode("probability").alias("class", "value")).withColumn("value", F.round("value", 6))


@query("block_cascade_cv", f"""{layers_sql(blocked_rows_sql(FOLDED.seed, 3), 4, FOLDED, block_plan(FOLDED, cv=3), 1)}
SELECT inst AS instance, block::BIGINT AS block, cast(fold AS INTEGER) AS fold, split, round(p0, 6) AS p0, round(p1, 6) AS p1
FROM mean_1 JOIN rows1 USING (rid)""")
def block_cascade_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With three left-out folds: the vector of every training row comes from trees that never saw it."""
    train, test = blocked_lines(spark, sf_dir)
    path = new_path(spark, "progress")
    fit_block_cascade(train, test, FOLDED, cv=3, progress_path=path)
    rows = scored_rows(spark, path)
    return rows.select("instance", "block", "fold", "split", *[F.round(F.get("previous", F.lit(k)), 6).alias(f"p{k}") for k in range(2)])


class DriverLost(Exception):
    """Stands for the loss of the driver after a layer."""


def restarted(spark: SparkSession, sf_dir: str) -> CascadeModel:
    """A fit that loses its driver after the first layer, and the fit that goes on."""
    train, test = blocked_lines(spark, sf_dir)
    path = new_path(spark, "progress")

    def lost(layer: int) -> None:
        raise DriverLost(layer)

    try:
        fit_block_cascade(train, test, TWO_LAYERS, progress_path=path, after_layer=lost)
    except DriverLost:
        pass
    seen = []
    model = fit_block_cascade(train, test, TWO_LAYERS, progress_path=path, after_layer=seen.append)
    if seen != [2]:
        raise RuntimeError(f"layers {seen} were fitted after the restart")
    return model


@query("block_cascade_restart", f"{TWO_LAYERS_SQL} {node_rows(TWO_LAYERS, 2)}")
def block_cascade_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a cascade whose fit was broken off after its first layer and went on."""
    out = None
    for i, layer in enumerate(restarted(spark, sf_dir).layers, start=1):
        nodes = layer.nodes.select(F.lit(i).alias("layer"), "tree", "node", "is_leaf", "feature", F.round("threshold", 9).alias("threshold"),
                                   *[F.get("counts", F.lit(k)).alias(f"c{k}") for k in range(TWO_LAYERS.num_classes)])
        out = nodes if out is None else out.unionByName(nodes)
    return out


# ---------------------------------------------------------------- categories

#: 5 categories in subsets, 200 in order (four words), and up to 1,000 bins of a price; three classes.
ARITY = {0: 5, 1: 200}
WIDE = ForestConfig(num_classes=3, rf_num=1, crf_num=1, sub_rf_num=1, trees=6, max_depth=3, max_bins=1_000, max_layers=1,
                    crf_feature_subset="all", feature_subset="all", seed=53)
ORDER_LABEL_SQL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
ORDER_ROWS_SQL = f"""
SELECT row_number() OVER () AS rid, o_orderkey AS inst, {sql_hash(53, "0", "o_orderkey")} AS row_hash, {ORDER_LABEL_SQL} AS label, 0 AS block, -1 AS fold,
       'train' AS split, [cast(substr(o_orderpriority, 1, 1) AS DOUBLE) - 1, (o_custkey % 200)::DOUBLE, o_totalprice] AS x FROM orders"""


def wide_plan(layer: int, features: int):
    return plan_trees([[0], [0]], {1}, features, WIDE, layer)


def category_layer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layer]:
    """Ordinary and completely random trees on categories: all cuts, and forced ones."""
    label = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("instance"), F.lit(0).cast("long").alias("block"), label.alias("label"),
        F.array(F.substring("o_orderpriority", 1, 1).cast("double") - 1, (F.col("o_custkey") % 200).cast("double"), "o_totalprice").alias("features"))
    rows = ready_rows(checked_rows(rows, 3, 3, ARITY), WIDE.seed, "block", "instance")
    return rows, fit_layer(rows, wide_plan(1, 3), fit_binning(rows, [0], 3, WIDE, ARITY), WIDE)


WIDE_SQL = layers_sql(ORDER_ROWS_SQL, 3, WIDE, wide_plan, 1, arity=ARITY)


@query("category_forest", f"""{WIDE_SQL}
SELECT cast(tree AS INTEGER) AS tree, cast(node AS BIGINT) AS node, is_leaf, cast(feature AS INTEGER) AS feature, round(threshold, 9) AS threshold,
       coalesce(array_to_string(list_sort(lefts), ','), '') AS lefts, c0, c1, c2 FROM nodes_1""")
def category_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes: 200 categories by order, 5 by subsets, 1,000 bins of a number."""
    _, layer = category_layer(spark, sf_dir)
    bits = F.filter(F.sequence(F.lit(0), F.size("mask") * S.WORD - 1),
                    lambda b: F.call_function("shiftright", F.get("mask", F.floor(b / S.WORD).cast("int")), b % S.WORD).bitwiseAND(F.lit(1).cast("long")) == 1)
    lefts = F.when(F.col("kind") == S.CONTINUOUS, F.lit("")).otherwise(F.array_join(F.transform(bits, lambda b: b.cast("string")), ","))
    return layer.nodes.select("tree", "node", "is_leaf", "feature", F.round("threshold", 9).alias("threshold"), lefts.alias("lefts"),
                              *[F.get("counts", F.lit(k)).alias(f"c{k}") for k in range(3)])


@query("category_forest_vectors", f"{WIDE_SQL} SELECT inst AS instance, {', '.join(f'round(p{k}, 6) AS p{k}' for k in range(3))} FROM mean_1 JOIN rows1 USING (rid)")
def category_forest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class vectors of rows that walk down cuts of categories."""
    rows, layer = category_layer(spark, sf_dir)
    scored = with_class_vectors(rows, layer, "vector").withColumn("mean", F.expr(fed_forward(layer, MEAN)))
    return scored.select("instance", *[F.round(F.get("mean", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])
