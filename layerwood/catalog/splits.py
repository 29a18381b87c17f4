"""Split search and tree growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForestConfig
from ..functions import arrays as A
from ..functions import impurity as I
from ..functions.hashing import MIX_RANGE, key_hash_value
from ..operators import sampling as P
from ..operators import splits as S
from ..plans.forest import fit_layer, ready_rows
from ..plans.grower import bin_points, fit_binning, plan_trees
from ..plans.scoring import Layer, forest_votes, with_class_vectors
from .registry import query, sql_hash, sql_mix, table

FLAG_SQL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
LINE_ID_SQL = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with four few-valued features and the return flag as label."""
    flag = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("instance"),
        F.lit(0).cast("long").alias("block"), flag.alias("label"),
        F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("features"))


VALUES_SQL = f"""
rows AS MATERIALIZED (
  SELECT {LINE_ID_SQL} AS inst, {FLAG_SQL} AS label, l_quantity AS f0, l_discount AS f1, l_tax AS f2,
         cast(l_linenumber AS DOUBLE) AS f3 FROM lineitem),
vals AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT DISTINCT {i} AS feature, f{i} AS v FROM rows" for i in range(4))}),
coded AS MATERIALIZED (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS bin FROM vals),
nsplits AS MATERIALIZED (SELECT feature, count(*) - 1 AS n FROM vals GROUP BY feature),
binned AS MATERIALIZED (
  SELECT inst, label, b0.bin AS b0, b1.bin AS b1, b2.bin AS b2, b3.bin AS b3 FROM rows
  {" ".join(f"JOIN (SELECT v, bin FROM coded WHERE feature = {i}) b{i} ON f{i} = b{i}.v" for i in range(4))})
"""


@query("feature_value_counts", f"""
WITH {VALUES_SQL}
{" UNION ALL ".join(f"SELECT cast({i} AS INTEGER) AS feature, f{i} AS value, count(*) AS n FROM rows GROUP BY f{i}" for i in range(4))}""")
def feature_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feature_value_counts(line_rows(spark, sf_dir)).drop("block")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two many-valued features, over four blocks."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("instance"), (F.col("o_orderstatus") == "F").cast("double").alias("label"),
        F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("features"))
    return P.random_blocks(rows, 4, 19, "instance")


ORDER_VALUES_SQL = f"""
orders_b AS MATERIALIZED (
  SELECT o_orderkey AS instance, {sql_hash(19, 'o_orderkey')} % 4 AS block, o_totalprice AS f0,
         cast(o_custkey AS DOUBLE) AS f1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
vals AS MATERIALIZED (
  SELECT DISTINCT block, 0 AS feature, f0 AS value FROM orders_b
  UNION ALL SELECT DISTINCT block, 1, f1 FROM orders_b),
pairs AS MATERIALIZED (
  SELECT block, feature, value, lead(value) OVER (PARTITION BY block, feature ORDER BY value) AS next_value FROM vals),
chosen AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY block, feature
      ORDER BY {sql_hash(123, 'block', 'feature', 'value')}, value) AS r FROM pairs WHERE next_value IS NOT NULL)
  WHERE r <= 31)
"""


@query("candidate_thresholds", f"""
WITH {ORDER_VALUES_SQL}
SELECT block, cast(feature AS INTEGER) AS feature, value, next_value, (value + next_value) / 2 AS threshold
FROM pairs WHERE next_value IS NOT NULL""")
def candidate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = S.explode_features(order_rows(spark, sf_dir), "block")
    return S.candidate_thresholds(cells).select("block", "feature", "value", "next_value", "threshold")


@query("sample_thresholds", f"""
WITH {ORDER_VALUES_SQL}
SELECT block, cast(feature AS INTEGER) AS feature, (value + next_value) / 2 AS threshold FROM chosen""")
def sample_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 31 thresholds per block and feature, as the grower takes them."""
    binning = fit_binning(order_rows(spark, sf_dir), list(range(4)), 2, ForestConfig())
    rows = [(b, f, float(x)) for b, features in binning.thresholds.items()
            for f, values in enumerate(features) for x in values]
    return spark.createDataFrame(rows, "block long, feature int, threshold double")


@query("bin_features", f"""
WITH {ORDER_VALUES_SQL}
SELECT o.block, {sql_hash(123, 'o.instance')} AS row_hash, cast(o.label AS INTEGER) AS label,
  cast((SELECT count(*) FROM chosen c WHERE c.block = o.block AND c.feature = 0 AND o.f0 > (c.value + c.next_value) / 2) AS INTEGER) AS bin_0,
  cast((SELECT count(*) FROM chosen c WHERE c.block = o.block AND c.feature = 1 AND o.f1 > (c.value + c.next_value) / 2) AS INTEGER) AS bin_1
FROM orders_b o""")
def bin_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of every row against its own block's thresholds."""
    rows = ready_rows(order_rows(spark, sf_dir), 123, "instance")
    points = bin_points(rows, fit_binning(rows, list(range(4)), 2, ForestConfig()))

    def byte(i: int):
        return F.conv(F.hex(F.substring("bins", i + 1, 1)), 16, 10).cast("int").alias(f"bin_{i}")

    return points.select("block", "row_hash", "label", byte(0), byte(1))


# ---------------------------------------------------------------- histograms of two trees with two nodes

NUM_CLASSES = 3


def tree_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees; tree 1 counts every row twice.  Nodes 2 and 3 by line number."""
    bins = [F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int"),
            F.round(F.col("l_tax") * 100).cast("int"), F.col("l_linenumber") - 1]
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return (table(spark, sf_dir, "lineitem")
            .select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"),
                    (F.col("l_linenumber") % 2 + 2).cast("long").alias("node"), flag.alias("label"),
                    F.array(*bins).alias("bins"))
            .withColumn("w", F.col("tree") + 1))


def frontier_rows(points: DataFrame) -> DataFrame:
    """All four features of every node, all cuts."""
    every = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(S.CONTINUOUS).alias("kind"),
                               F.lit(S.ALL_CUTS).alias("cut")) for f in range(4)])
    return points.select("tree", "node").distinct().withColumn("candidates", every)


HIST_SQL = f"""
pts AS MATERIALIZED (
  SELECT t.tree, l_linenumber % 2 + 2 AS node, {FLAG_SQL} AS label, t.tree + 1 AS w,
         cast(l_quantity AS BIGINT) - 1 AS b0, cast(round(l_discount * 100) AS BIGINT) AS b1,
         cast(round(l_tax * 100) AS BIGINT) AS b2, l_linenumber - 1 AS b3
  FROM lineitem, (SELECT unnest(range(2)) AS tree) t),
cells AS ({" UNION ALL ".join(f"SELECT tree, node, {i} AS feature, b{i} AS bin, label, w FROM pts" for i in range(4))}),
hist AS MATERIALIZED (
  SELECT tree, node, feature, bin,
         {", ".join(f"cast(sum(CASE WHEN label = {k} THEN w ELSE 0 END) AS DOUBLE) AS c{k}" for k in range(3))}
  FROM cells GROUP BY 1, 2, 3, 4),
cums AS MATERIALIZED (
  SELECT *, {", ".join(f"sum(c{k}) OVER (PARTITION BY tree, node, feature ORDER BY bin) AS l{k}, sum(c{k}) OVER (PARTITION BY tree, node, feature) AS t{k}" for k in range(3))}
  FROM hist)
"""
NODE_COLUMNS_SQL = "cast(tree AS INTEGER) AS tree, cast(node AS BIGINT) AS node, cast(feature AS INTEGER) AS feature"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tree_points(spark, sf_dir)
    return S.node_histogram(points, frontier_rows(points), NUM_CLASSES, with_totals=False)


@query("node_histogram", f"WITH {HIST_SQL} SELECT {NODE_COLUMNS_SQL}, cast(bin AS INTEGER) AS bin, c0, c1, c2 FROM hist")
def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir).drop("kind", "cut")


@query("bin_prefix_sums", f"""WITH {HIST_SQL}
SELECT {NODE_COLUMNS_SQL}, cast(bin AS INTEGER) AS bin, l0, l1, l2, t0, t1, t2 FROM cums""")
def bin_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prefix_sums(_histogram(spark, sf_dir), NUM_CLASSES).select(
        "tree", "node", "feature", "bin", "l0", "l1", "l2", "t0", "t1", "t2")


def sql_gini(counts: list[str]) -> str:
    n = "(" + " + ".join(counts) + ")"
    return (f"(CASE WHEN {n} = 0 THEN 0::DOUBLE ELSE 1::DOUBLE - ("
            + " + ".join(f"{c} * {c}" for c in counts) + f") / ({n} * {n}) END)")


def sql_gain(min_instances: int = 1) -> str:
    left, whole = ["l0", "l1", "l2"], ["t0", "t1", "t2"]
    right = [f"({t} - {l})" for t, l in zip(whole, left)]
    n_left, n_right, n = (f"({' + '.join(x)})" for x in (left, right, whole))
    gain = (f"({sql_gini(whole)} - {n_left} / {n} * {sql_gini(left)} - {n_right} / {n} * {sql_gini(right)})")
    return (f"CASE WHEN {n_left} >= {min_instances} AND {n_right} >= {min_instances} AND {gain} >= 1e-6 "
            f"THEN {gain} ELSE -1.7976931348623157e308::DOUBLE END")


GAIN_SQL = f"""{HIST_SQL},
scored AS MATERIALIZED (SELECT *, {sql_gain(500)} AS gain FROM cums),
best AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, bin) AS r FROM scored)
  WHERE r = 1)
"""


@query("split_gain", f"""WITH {GAIN_SQL}
SELECT {NODE_COLUMNS_SQL}, cast(bin AS INTEGER) AS cut, gain > 0 AS is_valid, round(greatest(gain, -1), 9) AS gain FROM scored""")
def split_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = S.candidate_splits(_histogram(spark, sf_dir), NUM_CLASSES)
    gain = I.split_gain(["t0", "t1", "t2"], ["l0", "l1", "l2"], "gini", 500)
    return (cuts.selectExpr("tree", "node", "feature", "cut", f"{gain} AS gain")
            .selectExpr("tree", "node", "feature", "cut", "gain > 0 AS is_valid",
                        "round(greatest(gain, -1D), 9) AS gain"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_split(S.candidate_splits(_histogram(spark, sf_dir), NUM_CLASSES), NUM_CLASSES, min_instances=500)


@query("best_split", f"""WITH {GAIN_SQL}
SELECT {NODE_COLUMNS_SQL}, cast(bin AS INTEGER) AS cut, round(gain, 9) AS gain, l0, l1, l2 FROM best""")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).selectExpr("tree", "node", "feature", "cut", "round(gain, 9) AS gain",
                                           *[f"get(left, {k}) AS l{k}" for k in range(3)])


@query("node_expand", f"""WITH {GAIN_SQL}
SELECT cast(tree AS INTEGER) AS tree, cast(node * 2 + s.side AS BIGINT) AS node,
  CASE WHEN s.side = 0 THEN l0 ELSE t0 - l0 END AS c0, CASE WHEN s.side = 0 THEN l1 ELSE t1 - l1 END AS c1,
  CASE WHEN s.side = 0 THEN l2 ELSE t2 - l2 END AS c2,
  CASE WHEN s.side = 0 THEN greatest(l0, l1, l2) = l0 + l1 + l2
       ELSE greatest(t0 - l0, t1 - l1, t2 - l2) = t0 + t1 + t2 - l0 - l1 - l2 END AS is_leaf
FROM best, (SELECT unnest(range(2)) AS side) s WHERE gain >= 1e-6""")
def node_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = S.expand_nodes(_best(spark, sf_dir), 1, 5, NUM_CLASSES)
    return S.children(expanded).selectExpr("tree", "node", *[f"get(counts, {k}) AS c{k}" for k in range(3)], "is_leaf")


@query("route_rows", f"""WITH {GAIN_SQL},
moved AS (
  SELECT p.tree, p.node * 2 + CASE WHEN (CASE feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END) <= b.bin
         THEN 0 ELSE 1 END AS node, p.label, p.w
  FROM pts p JOIN best b ON p.tree = b.tree AND p.node = b.node WHERE b.gain >= 1e-6)
SELECT cast(tree AS INTEGER) AS tree, cast(node AS BIGINT) AS node, cast(label AS INTEGER) AS label, count(*) AS n_rows, cast(sum(w) AS BIGINT) AS weight
FROM (SELECT *, count(DISTINCT label) OVER (PARTITION BY tree, node) AS k FROM moved) WHERE k > 1 GROUP BY 1, 2, 3""")
def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows moved to the children of their node; rows in pure children are done and drop out."""
    moved = S.route_points(tree_points(spark, sf_dir), S.expand_nodes(_best(spark, sf_dir), 1, 5, NUM_CLASSES))
    return moved.groupBy("tree", "node", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("weight"))


@query("node_id_join", f"""
SELECT o_orderkey AS instance, o_totalprice, {sql_hash(41, 'o_orderkey')} % 8 + 8 AS node FROM orders""")
def node_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their current node, joined by key instead of by position."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), "o_totalprice")
    nodes = P.random_blocks(rows.select("instance"), 8, 41, "instance").select(
        "instance", (F.col("block") + 8).alias("node"))
    return rows.join(nodes, "instance")


@query("impurity", """
WITH counts AS (
  SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS a, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS b,
         count(*) FILTER (l_returnflag = 'R')::DOUBLE AS c, count(*)::DOUBLE AS n, sum(l_quantity) AS s,
         sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(1 - (a * a + b * b + c * c) / (n * n), 9) AS gini,
  round(CASE WHEN a > 0 THEN -a / n * log2(a / n) ELSE 0 END + CASE WHEN b > 0 THEN -b / n * log2(b / n) ELSE 0 END
        + CASE WHEN c > 0 THEN -c / n * log2(c / n) ELSE 0 END, 9) AS entropy,
  round((q - s * s / n) / n, 6) AS variance FROM counts""")
def impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        *[F.expr(f"cast(count_if(l_returnflag = '{x}') AS double) AS {name}")
          for x, name in (("A", "a"), ("N", "b"), ("R", "c"))],
        F.expr("cast(count(*) AS double) AS n"), F.expr("sum(l_quantity) AS s"),
        F.expr("sum(l_quantity * l_quantity) AS q"))
    abc = ["a", "b", "c"]
    return counts.selectExpr("l_suppkey", f"round({I.gini(abc)}, 9) AS gini", f"round({I.entropy(abc)}, 9) AS entropy",
                             f"round({I.variance('n', 's', 'q')}, 6) AS variance")


# ---------------------------------------------------------------- categories

def priority_cells(spark: SparkSession, sf_dir: str, classes: int) -> DataFrame:
    """Histogram of order priority against status, per customer nation's region as node."""
    status = (F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
              if classes == 3 else (F.col("o_orderstatus") == "F").cast("int"))
    cells = table(spark, sf_dir, "orders").select(
        F.lit(0).alias("tree"), (F.col("o_custkey") % 7 + 1).cast("long").alias("node"), F.lit(0).alias("feature"),
        F.lit(S.ORDERED).alias("kind"), F.lit(S.ALL_CUTS).alias("cut"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("bin"), status.alias("label"))
    return S.merge_histogram(cells.selectExpr(
        *S.CELL, "bin", *[f"if(label = {k}, 1D, 0D) AS c{k}" for k in range(classes)]), classes)


def priority_sql(classes: int) -> str:
    status = ("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END" if classes == 3
              else "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END")
    return f"""
cells AS (SELECT o_custkey % 7 + 1 AS node, cast(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS bin, {status} AS label FROM orders),
hist AS (SELECT node, bin, {", ".join(f"count(*) FILTER (label = {k})::DOUBLE AS c{k}" for k in range(classes))} FROM cells GROUP BY 1, 2)
"""


@query("category_centroid_order", f"""
WITH {priority_sql(3)}, centred AS (SELECT node, bin, {sql_gini(['c0', 'c1', 'c2'])} AS centroid FROM hist)
SELECT cast(node AS BIGINT) AS node, cast(bin AS INTEGER) AS category, round(centroid, 9) AS centroid,
       cast(row_number() OVER (PARTITION BY node ORDER BY centroid, bin) - 1 AS INTEGER) AS rank FROM centred""")
def category_centroid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.centroid_order(priority_cells(spark, sf_dir, 3), 3)
    return out.select("node", F.col("bin").alias("category"), F.round("centroid", 9).alias("centroid"), "rank")


@query("category_count_order", f"""
WITH {priority_sql(2)}
SELECT cast(node AS BIGINT) AS node, cast(bin AS INTEGER) AS category, c1 AS centroid,
       cast(row_number() OVER (PARTITION BY node ORDER BY c1, bin) - 1 AS INTEGER) AS rank FROM hist""")
def category_count_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes: categories by the count of class 1."""
    return S.centroid_order(priority_cells(spark, sf_dir, 2), 2).select(
        "node", F.col("bin").alias("category"), "centroid", "rank")


@query("ordered_category_cuts", f"""
WITH {priority_sql(2)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c1, bin) - 1 AS rank FROM hist)
SELECT cast(node AS BIGINT) AS node, cast(rank AS INTEGER) AS cut,
  cast(sum(1 << bin) OVER w AS BIGINT) AS mask, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1
FROM ranked WINDOW w AS (PARTITION BY node ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ordered_category_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = S.candidate_splits(priority_cells(spark, sf_dir, 2), 2, (S.ORDERED,))
    return cuts.select("node", "cut", F.get("mask", F.lit(0)).alias("mask"), "l0", "l1")


@query("unordered_category_cuts", f"""
WITH {priority_sql(3)}, masks AS (SELECT unnest(range(1, 16)) AS mask)
SELECT cast(node AS BIGINT) AS node, mask, {", ".join(f"sum(CASE WHEN (mask >> bin) & 1 = 1 THEN c{k} ELSE 0::DOUBLE END) AS l{k}, sum(c{k}) AS t{k}" for k in range(3))}
FROM hist, masks GROUP BY node, mask""")
def unordered_category_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category counts in every subset that holds it."""
    cells = priority_cells(spark, sf_dir, 3).withColumn("kind", F.lit(S.UNORDERED))
    cuts = S.candidate_splits(cells, 3, (S.UNORDERED,))
    return cuts.select("node", F.get("mask", F.lit(0)).alias("mask"), *[f"{s}{k}" for k in range(3) for s in ("l", "t")])


@query("category_subsets", """
WITH arities AS (
  SELECT 'o_orderpriority' AS feature, count(DISTINCT o_orderpriority) AS k FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders),
numbered AS (SELECT feature, k, unnest(range(1, (1 << (k - 1)))) AS number FROM arities)
SELECT feature, number, cast(c.c AS INTEGER) AS category FROM numbered, (SELECT unnest(range(8)) AS c) c
WHERE c.c < k AND (number >> c.c) & 1 = 1""")
def category_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All two-sided category subsets of the categorical order columns."""
    wide = table(spark, sf_dir, "orders").agg(F.count_distinct("o_orderpriority").alias("o_orderpriority"),
                                              F.count_distinct("o_orderstatus").alias("o_orderstatus"))
    arities = wide.unpivot([], ["o_orderpriority", "o_orderstatus"], "feature", "k")
    numbered = arities.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), A.subset_count("k"))))
    return numbered.select("feature", "number", F.explode(A.category_subset("number", "k")).alias("category"))


# ---------------------------------------------------------------- whole trees

TREE_SEED = 77


def growth_sql(depth: int, trees: int, subset: int, is_random: bool, bootstrap: bool) -> str:
    """All nodes of small forests, one chain of table expressions per level."""
    hashes = ", ".join(f"({t}, {key_hash_value(TREE_SEED, 1, t)})" for t in range(trees))
    weight = (" + ".join(f"CASE WHEN m >= {int(b * MIX_RANGE)} THEN 1 ELSE 0 END" for b in P.poisson_cdf(1.0))
              if bootstrap else "1")
    parts = [VALUES_SQL, f"trees(tree, tree_hash) AS (VALUES {hashes})", f"""
drawn AS MATERIALIZED (
  SELECT b.*, tree, {sql_mix('row_hash', 'tree_hash')} AS m
  FROM (SELECT *, {sql_hash(TREE_SEED, 'inst')} AS row_hash FROM binned) b, trees)""", f"""
p0 AS MATERIALIZED (SELECT * FROM (SELECT tree, 1::BIGINT AS node, label, b0, b1, b2, b3, {weight} AS w FROM drawn) WHERE w > 0)"""]
    out = []
    for d in range(depth):
        cells = " UNION ALL ".join(
            f"SELECT p.tree, p.node, c.feature, c.cut, p.b{i} AS bin, p.label, p.w FROM p{d} p "
            f"JOIN c{d} c ON p.tree = c.tree AND p.node = c.node AND c.feature = {i}" for i in range(4))
        sums = ", ".join(f"sum(CASE WHEN label = {k} THEN w ELSE 0 END)::DOUBLE AS c{k}" for k in range(3))
        if is_random:
            sides = ", ".join(
                f"sum(CASE WHEN label = {k} AND bin <= cut THEN w ELSE 0 END)::DOUBLE AS l{k}, "
                f"sum(CASE WHEN label = {k} THEN w ELSE 0 END)::DOUBLE AS t{k}" for k in range(3))
            cums = f"SELECT tree, node, feature, cut, {sides} FROM x{d} GROUP BY 1, 2, 3, 4"
        else:
            over = "(PARTITION BY tree, node, feature ORDER BY bin)"
            sides = ", ".join(f"sum(c{k}) OVER {over} AS l{k}, sum(c{k}) OVER (PARTITION BY tree, node, feature) AS t{k}"
                              for k in range(3))
            cums = (f"SELECT tree, node, feature, bin AS cut, {sides} FROM "
                    f"(SELECT tree, node, feature, bin, {sums} FROM x{d} GROUP BY 1, 2, 3, 4)")
        last = d + 1 == depth
        parts += [
            f"n{d} AS MATERIALIZED (SELECT tree, node, {sql_mix('tree_hash', 'node')} AS k FROM "
            f"(SELECT DISTINCT tree, node FROM p{d}) JOIN trees USING (tree))",
            f"h{d} AS MATERIALIZED (SELECT tree, node, feature, n, {sql_mix('k', 'feature')} AS h FROM n{d}, nsplits)",
            f"c{d} AS MATERIALIZED (SELECT tree, node, feature, {sql_mix('h', str(S.CUT_SALT))} % greatest(n, 1) AS cut "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY h, feature) AS r FROM h{d}) "
            f"WHERE r <= {subset} AND n > 0)",
            f"x{d} AS MATERIALIZED ({cells})",
            f"u{d} AS MATERIALIZED ({cums})",
            f"g{d} AS MATERIALIZED (SELECT *, {sql_gain()} AS gain FROM u{d})",
            f"s{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node "
            f"ORDER BY gain DESC, feature, cut) AS r FROM g{d}) WHERE r = 1)"]
        kids = ", ".join(f"CASE WHEN side = 0 THEN l{k} ELSE t{k} - l{k} END AS c{k}" for k in range(3))
        parts.append(f"k{d} AS MATERIALIZED (SELECT *, {'true' if last else 'greatest(c0, c1, c2) = c0 + c1 + c2'} AS is_leaf "
                     f"FROM (SELECT tree, node * 2 + side AS node, {kids} FROM s{d}, (SELECT unnest(range(2)) AS side) "
                     f"WHERE gain >= 1e-6))")
        out += [f"SELECT s.tree, s.node, gain < 1e-6 AS is_leaf, CASE WHEN gain < 1e-6 THEN 0 ELSE s.feature END AS feature, "
                f"CASE WHEN gain < 1e-6 THEN 0::DOUBLE ELSE (lo.v + hi.v) / 2 END AS threshold, t0 AS c0, t1 AS c1, t2 AS c2 "
                f"FROM s{d} s LEFT JOIN coded lo ON lo.feature = s.feature AND lo.bin = s.cut "
                f"LEFT JOIN coded hi ON hi.feature = s.feature AND hi.bin = s.cut + 1",
                f"SELECT tree, node, true, 0, 0::DOUBLE, c0, c1, c2 FROM k{d} WHERE is_leaf"]
        if not last:
            side = "CASE WHEN (CASE s.feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END) <= s.cut THEN 0 ELSE 1 END"
            parts.append(f"p{d + 1} AS MATERIALIZED (SELECT m.* FROM (SELECT p.tree, p.node * 2 + {side} AS node, p.label, "
                         f"b0, b1, b2, b3, p.w FROM p{d} p JOIN s{d} s ON p.tree = s.tree AND p.node = s.node "
                         f"WHERE s.gain >= 1e-6) m JOIN k{d} k ON m.tree = k.tree AND m.node = k.node AND NOT k.is_leaf)")
    return (f"WITH {', '.join(parts)} SELECT cast(tree AS INTEGER) AS tree, cast(node AS BIGINT) AS node, is_leaf, "
            f"cast(feature AS INTEGER) AS feature, round(threshold, 9) AS threshold, c0, c1, c2 FROM ("
            + " UNION ALL ".join(out) + ")")


def votes_sql(depth: int, trees: int, subset: int, is_random: bool, bootstrap: bool) -> str:
    """A forest's class vector of every row: rows walk down the trees of ``growth_sql``."""
    value = "CASE n.feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END"
    steps = ["w0 AS (SELECT inst, f0, f1, f2, f3, tree, 1::BIGINT AS node FROM r, (SELECT DISTINCT tree FROM nodes))"]
    for d in range(depth):
        steps.append(
            f"w{d + 1} AS (SELECT inst, f0, f1, f2, f3, w.tree, CASE WHEN n.is_leaf THEN w.node "
            f"WHEN {value} <= n.threshold THEN 2 * w.node ELSE 2 * w.node + 1 END AS node FROM w{d} w JOIN nodes n USING (tree, node))")
    votes = ", ".join(f"sum(c{k} / (c0 + c1 + c2)) AS v{k}" for k in range(3))
    return (f"WITH nodes AS MATERIALIZED ({growth_sql(depth, trees, subset, is_random, bootstrap)}), "
            f"r AS (SELECT DISTINCT {LINE_ID_SQL} AS inst, l_quantity AS f0, l_discount AS f1, l_tax AS f2, "
            f"cast(l_linenumber AS DOUBLE) AS f3 FROM lineitem), {', '.join(steps)}, "
            f"v AS (SELECT inst, f0, f1, f2, f3, {votes} FROM w{depth} JOIN nodes USING (tree, node) GROUP BY inst, f0, f1, f2, f3) "
            f"SELECT inst AS instance, {', '.join(f'round(v{k} / (v0 + v1 + v2), 6) AS p{k}' for k in range(3))} FROM v")


def grown_layer(spark: SparkSession, sf_dir: str, depth: int, trees: int, is_random: bool,
                state_bytes: int | None = None) -> Layer:
    config = ForestConfig(num_classes=3, trees=trees, max_depth=depth, max_bins=64, seed=TREE_SEED)
    rows = ready_rows(line_rows(spark, sf_dir), TREE_SEED, "instance")
    plan = plan_trees([[0]], {0} if is_random else set(), 4, config, 1)
    extra = {} if state_bytes is None else {"state_bytes": state_bytes}
    return fit_layer(rows, plan, fit_binning(rows, [0], 4, config), config, **extra)


def grown(spark: SparkSession, sf_dir: str, depth: int, trees: int, is_random: bool,
          state_bytes: int | None = None) -> DataFrame:
    layer = grown_layer(spark, sf_dir, depth, trees, is_random, state_bytes)
    return layer.nodes.select("tree", "node", "is_leaf", "feature", F.round("threshold", 9).alias("threshold"),
                              *[F.get("counts", F.lit(k)).alias(f"c{k}") for k in range(3)])


@query("random_tree_level", growth_sql(1, 8, 2, True, False))
def random_tree_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of eight completely random trees."""
    return grown(spark, sf_dir, 1, 8, True)


@query("completely_random_forest", growth_sql(3, 4, 2, True, False))
def completely_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of four completely random trees of depth three."""
    return grown(spark, sf_dir, 3, 4, True)


@query("bootstrap_forest", growth_sql(3, 4, 2, False, True))
def bootstrap_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of four ordinary trees: bootstrap rows, best cut of each feature subset."""
    return grown(spark, sf_dir, 3, 4, False)


@query("bootstrap_forest_in_groups", growth_sql(3, 4, 2, False, True))
def bootstrap_forest_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees on the path without broadcasts, used for node tables of any size."""
    return grown(spark, sf_dir, 3, 4, False, state_bytes=0)


def grown_vectors(spark: SparkSession, sf_dir: str, is_random: bool, state_bytes: int) -> DataFrame:
    """Class vectors of all rows; rows with equal ids and features are one."""
    layer = grown_layer(spark, sf_dir, 3, 4, is_random)
    rows = with_class_vectors(line_rows(spark, sf_dir), layer, "vector", state_bytes=state_bytes)
    rows = rows.select("instance", "features", *[F.round(F.get("vector", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])
    return rows.distinct().drop("features")


@query("forest_vectors", votes_sql(3, 4, 2, False, True))
def forest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class vectors of an ordinary forest."""
    return grown_vectors(spark, sf_dir, False, 1 << 30)


@query("random_forest_vectors_in_groups", votes_sql(3, 4, 2, True, False))
def random_forest_vectors_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class vectors of a completely random forest, one tree at a time."""
    return grown_vectors(spark, sf_dir, True, 0)


CUT_HASHES = [key_hash_value(TREE_SEED, 1, t) for t in range(8)]


@query("random_cut", f"""
WITH {VALUES_SQL}, trees(tree, tree_hash) AS (VALUES {", ".join(f"({t}, {h})" for t, h in enumerate(CUT_HASHES))}),
keys AS MATERIALIZED (SELECT tree, {sql_mix('tree_hash', '1')} AS k FROM trees),
feats AS MATERIALIZED (SELECT tree, feature, n, {sql_mix('k', 'feature')} AS h FROM keys, nsplits),
cuts AS MATERIALIZED (SELECT tree, feature, {sql_mix('h', str(S.CUT_SALT))} % n AS cut FROM feats),
cells AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS feature, b{i} AS bin, label FROM binned" for i in range(4))})
SELECT cast(tree AS INTEGER) AS tree, cast(c.feature AS INTEGER) AS feature, cast(cut AS INTEGER) AS cut,
  {", ".join(f"count(*) FILTER (label = {k} AND bin <= cut)::DOUBLE AS l{k}, count(*) FILTER (label = {k})::DOUBLE AS t{k}" for k in range(3))}
FROM cuts c JOIN cells USING (feature) GROUP BY 1, 2, 3""")
def random_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random cut of every feature at the root of eight trees, with the counts left of it."""
    config = ForestConfig(num_classes=3, max_bins=64, seed=TREE_SEED)
    rows = ready_rows(line_rows(spark, sf_dir), TREE_SEED, "instance")
    binning = fit_binning(rows, [0], 4, config)
    roots = spark.createDataFrame(
        [(t, 1, h, True, 4, [int(n) for n in binning.num_splits(0)], binning.kinds) for t, h in enumerate(CUT_HASHES)],
        "tree int, node long, tree_hash long, is_random boolean, subset int, num_splits array<int>, kinds array<int>")
    bytes_ = [F.conv(F.hex(F.substring("bins", f + 1, 1)), 16, 10).cast("int") for f in range(4)]
    points = bin_points(rows, binning).select(
        F.explode(F.array(*[F.lit(t) for t in range(8)])).alias("tree"), F.lit(1).cast("long").alias("node"),
        "label", F.lit(1).alias("w"), F.array(*bytes_).alias("bins"))
    histogram = S.node_histogram(points, S.candidate_cuts(roots), 3, with_totals=False)
    return S.candidate_splits(histogram, 3).select(
        "tree", "feature", "cut", *[f"{s}{k}" for k in range(3) for s in ("l", "t")])


@query("forest_vote", f"""
WITH counts AS (
  SELECT l_suppkey AS instance, l_linenumber AS tree, {", ".join(f"count(*) FILTER ({FLAG_SQL} = {k})::DOUBLE AS c{k}" for k in range(3))}
  FROM lineitem GROUP BY 1, 2),
votes AS (
  SELECT instance, {", ".join(f"sum(c{k} / (c0 + c1 + c2)) AS v{k}" for k in range(3))} FROM counts GROUP BY 1)
SELECT instance, {", ".join(f"round(v{k} / (v0 + v1 + v2), 9) AS p{k}" for k in range(3))} FROM votes""")
def forest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf counts (here per supplier and line number) to forest probabilities."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    leaves = (table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instance"), "l_linenumber", flag.alias("k"))
              .groupBy("instance", "l_linenumber").agg(
                  F.array(*[F.count_if(F.col("k") == k).cast("double") for k in range(3)]).alias("counts")))
    votes = forest_votes(leaves.withColumn("model", F.lit(0)).withColumn("forest", F.lit(0)), 3, ["instance"])
    return votes.select("instance", *[F.round(F.get("probability", F.lit(k)), 9).alias(f"p{k}") for k in range(3)])
