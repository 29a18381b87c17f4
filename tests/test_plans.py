"""The physical plans are the ones we want: few shuffles, pruned scans, no hidden cross joins."""

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from layerwood import ForestConfig
from layerwood.catalog.splits import line_rows, tree_points
from layerwood.operators import metrics as M
from layerwood.operators import sampling as P
from layerwood.operators import splits as S
from layerwood.plans.cascade import fit_block_cascade, fit_cascade
from layerwood.plans.forest import fit_forest
from layerwood.plans.grower import choose_level, sample_edges
from layerwood.session import shared_dir
from layerwood.sources.tables import read_assigned_blocks, write_blocks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning") + \
        plan(df).count("Exchange RoundRobin")


def test_splits_blocks_and_folds_do_not_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("instance"), "o_totalprice")
    out = P.k_folds(P.random_blocks(P.train_test_split(orders, 0.7, 1, "instance"), 9, 2, "instance"), 3, 4, "instance")
    assert "Exchange" not in plan(out)
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(out)


def test_one_shuffle_per_level(spark):
    fields = "tree int, node long, feature int, kind int, cut int, bin int, c0 double, c1 double"
    partial = spark.range(100).selectExpr("int(id) tree", "id node", "0 feature", "0 kind", "-1 cut", "int(id) bin",
                                          "1D c0", "0D c1").mapInArrow(lambda it: it, fields)
    merged = S.merge_histogram(partial.repartition("tree", "node"), 2)
    assert shuffles(choose_level(merged, ForestConfig(), [S.CONTINUOUS], 0)) == 1


def test_best_cuts_in_two_steps(spark):
    fields = "tree int, node long, feature int, kind int, cut int, bin int, c0 double, c1 double"
    partial = spark.range(100).selectExpr("int(id) tree", "id node", "0 feature", "0 kind", "-1 cut", "int(id) bin",
                                          "1D c0", "0D c1").mapInArrow(lambda it: it, fields)
    merged = S.merge_histogram(partial.repartition("tree", "node", "feature"), 2)
    text = plan(choose_level(merged, ForestConfig(), [S.CONTINUOUS], 0))
    # sums and prefix sums are dealt by feature; only best cuts are dealt by node
    node = text.index("hashpartitioning(tree#", 0)
    assert text.count("Exchange hashpartitioning") == 2 and "max_by" in text[node:] and "feature#" in text[text.rindex("hashpartitioning("):].split("\n")[0]


def test_scoring_is_evaluated_once(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    model = fit_block_cascade(rows, None, ForestConfig(num_classes=3, rf_num=1, crf_num=1, sub_rf_num=1, trees=2, max_depth=2, max_layers=2))
    long = model.transform(rows).select("instance", F.posexplode("probability")).filter("col > 0.1")
    assert plan(long).count("ArrowEvalPython") == 2


def test_sampled_thresholds_take_one_scan(spark, sf_dir):
    seen = []
    rows = line_rows(spark, sf_dir)
    real = type(rows).mapInArrow
    try:
        type(rows).mapInArrow = lambda self, *a, **k: seen.append(1) or real(self, *a, **k)
        sample_edges(rows, 31, 1)
    finally:
        type(rows).mapInArrow = real
    assert len(seen) == 1


def test_value_ranges_are_even(spark):
    # nine tenths of the values lie in a thousandth of the range
    df = spark.range(100_000).select(F.lit(0).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id") / 1e5).otherwise(F.col("id") * 1.0).alias("value"))
    sizes = [r["count"] for r in S.value_ranges(df.distinct(), ["g"], 16).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 2 * 100_000 / 16


def test_blocks_dealt_evenly(spark):
    rows = P.balanced_blocks(spark.range(1_003).repartition(7), 10, 5, "id")
    # only the counts of partitions are shuffled, and the rows meet them by broadcast
    assert "SortMergeJoin" not in plan(rows) and shuffles(rows) == 1 and "partial_count" in plan(rows)
    out = rows.collect()
    sizes = [sum(r["block"] == b for r in out) for b in range(10)]
    assert sorted(r["id"] for r in out) == list(range(1_003)) and sorted(sizes) == [100] * 7 + [101] * 3
    assert P.balanced_blocks(spark.range(0), 4, 1, "id").count() == 0


def test_assigned_blocks_prune_folders_at_run_time(spark, tmp_path):
    write_blocks(P.random_blocks(spark.range(1_000), 8, 1, "id"), f"{tmp_path}/blocks")
    spark.createDataFrame([(1, 0, 0, 3), (2, 0, 0, 5)], "layer int, model int, slot int, block long").write.parquet(f"{tmp_path}/draw")
    rows = read_assigned_blocks(spark, f"{tmp_path}/blocks", spark.read.parquet(f"{tmp_path}/draw"), 1)
    assert "dynamicpruning" in plan(rows)
    assert {r["block"] for r in rows.select("block").distinct().collect()} == {3}


def test_histogram_is_summed_before_the_shuffle(spark, sf_dir):
    points = tree_points(spark, sf_dir)
    frontier = points.select("tree", "node").distinct().withColumn("candidates", F.expr(
        "array(struct(0 AS feature, 0 AS kind, -1 AS cut))"))
    text = plan(S.node_histogram(points, frontier, 3, False))
    assert "partial_sum" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sample_rank_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id")
    assert "WindowGroupLimit" in plan(S.sample_per_group(df, 5, 1, ["g"], "id"))


def test_metrics_take_one_narrow_pass(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    text = plan(M.confusion(rows))
    assert "partial_count" in text and "l_extendedprice" not in text


def test_scoring_does_not_shuffle(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    model = fit_forest(rows, ForestConfig(num_classes=3, trees=2, max_depth=2), True, 4)
    assert "Exchange" not in plan(model.transform(rows)) and "ArrowEvalPython" in plan(model.transform(rows))


def test_blocks_are_balanced_random_samples(spark):
    counts = [r["n"] for r in P.random_blocks(spark.range(48_000), 24, 5, "id").groupBy("block").agg(
        F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == 24 and sum(counts) == 48_000 and max(counts) < 1.15 * min(counts)


def test_each_model_draws_distinct_blocks():
    chosen = P.choose_blocks(240, 20, 3)
    draws = P.assign_blocks(chosen, 8, 5, 1, 3)
    assert len(set(chosen)) == 20 and all(len(set(d)) == 5 and set(d) <= set(chosen) for d in draws)
    assert len({tuple(d) for d in draws}) > 1 and draws != P.assign_blocks(chosen, 8, 5, 2, 3)


def test_small_sample_returns_all(spark):
    rows = P.sample_k_and_count(spark.range(5), 10, 1, "id").collect()
    assert len(rows) == 5 and {r["total"] for r in rows} == {5}


def test_layer_tables_are_deleted(spark):
    folder = Path(urlparse(shared_dir(spark)).path)
    tables = lambda: {p.name for p in folder.glob("layer-*")}
    before = tables()
    rows = spark.range(200).select(F.col("id").alias("instance"), (F.col("id") % 2).cast("double").alias("label"),
                                   (F.col("id") % 3).alias("block"), F.array((F.col("id") % 2).cast("double")).alias("features"))
    config = ForestConfig(rf_num=1, crf_num=1, sub_rf_num=1, trees=1, max_depth=2, max_layers=3)
    model = fit_block_cascade(rows, rows, config)
    assert fit_cascade(rows.drop("block"), config.replace(num_folds=2)).history
    assert model.transform(rows).count() == 200
    assert tables() == before


def test_points_meet_nodes_without_a_task_per_node(spark, monkeypatch):
    points = spark.range(0, 8_000, 1, 8).selectExpr("0 AS tree", "1L AS node", "int(id % 2) AS label", "1 AS w", "array(int(id % 5)) AS bins")
    frontier = spark.createDataFrame([(0, 1, [(0, S.CONTINUOUS, S.ALL_CUTS)])], "tree int, node long, candidates array<struct<feature:int,kind:int,cut:int>>")
    split = spark.createDataFrame([(0, 1, 0, 0, 2, [0], False, False, False)],
                                  "tree int, node long, feature int, kind int, cut int, mask array<long>, left_leaf boolean, right_leaf boolean, is_leaf boolean")

    def sums():
        found = S.node_histogram(points, frontier, 2, False).collect()
        return sorted((r["bin"], r["c0"], r["c1"]) for r in found), sorted(tuple(r) for r in S.route_points(points, split).groupBy("node").count().collect())

    text = plan(S.node_histogram(points, frontier, 2, False))
    assert "SortMergeJoin" not in text and shuffles(S.node_histogram(points, frontier, 2, False)) == 1
    assert shuffles(S.route_points(points, split)) == 0
    sent = sums()
    # nodes too large to be sent: the points of the only node are dealt over its parts
    monkeypatch.setattr(S, "SEND_BYTES", 0)
    assert sums() == sent and sent[1] == [(2, 4_800), (3, 3_200)]
    moved = S.route_points(points, split)
    assert "_part" in plan(moved) and "spark_partition_id" in plan(moved).lower()
    assert "partial_sum" in plan(S.node_histogram(points, frontier, 2, False))
