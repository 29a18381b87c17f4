import numpy as np
import pytest
from pyspark.sql import functions as F

from layerwood import ForestConfig
from layerwood.functions.hashing import key_hash_value, mix_array
from layerwood.operators import metrics as M
from layerwood.operators import splits as S
from layerwood.operators.sampling import poisson_cdf
from layerwood.plans import scoring, tasks
from layerwood.plans.cascade import fit_block_cascade, fit_cascade, out_of_fold_vectors
from layerwood.plans.forest import fit_forest, fit_layer, library_forest_vectors
from layerwood.plans.grower import bin_points, fit_binning, grouped_points, plan_trees, sample_edges
from layerwood.plans.persist import load_cascade, load_forest, save_cascade, save_forest
from layerwood.plans.scoring import with_class_vectors
from layerwood.session import materialize


def values(spark, per_block):
    rows = [(b, [float(x)]) for b, xs in per_block.items() for x in xs]
    return spark.createDataFrame(rows, "block long, features array<double>")


def test_thresholds_golden(spark):
    df = values(spark, {0: [1, 1, 2, 4], 1: [5, 5]})
    found = fit_binning(df, [0, 1], 1, ForestConfig()).thresholds
    assert found[0][0].tolist() == [1.5, 3.0] and found[1][0].tolist() == []
    one = fit_binning(df, [0, 1], 1, ForestConfig(max_bins=2)).thresholds
    assert one[0][0].tolist() in ([1.5], [3.0])


def test_sampled_edges_equal_brute_force_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    xs = np.concatenate([rng.integers(0, 50_000, 20_000) / 8.0, np.full(10_000, 77.0)])
    got = sample_edges(values(spark, {3: xs}), 31, seed=9)[3, 0]
    distinct = sorted(set(xs))[:-1]
    best = sorted(distinct, key=lambda v: (key_hash_value(9, 3, 0, v), v))[:31]
    assert got.tolist() == sorted(best)
    # sketches of many tasks give the same sample
    assert sample_edges(values(spark, {3: xs}).repartition(13), 31, seed=9)[3, 0].tolist() == sorted(best)


def test_sampled_edges_of_few_values(spark):
    found = sample_edges(values(spark, {0: [5.0], 1: [1.0, 2.0, -0.0, 0.0], 2: [float("nan"), 3.0, 4.0], 3: [float("nan")]}), 3, seed=1)
    assert {k: v.tolist() for k, v in found.items()} == {(0, 0): [], (1, 0): [0.0, 1.0], (2, 0): [3.0, 4.0], (3, 0): []}


def test_successors_over_many_buckets(spark):
    xs = np.random.default_rng(1).permutation(5000)[:3000] * 1.5
    df = values(spark, {0: xs}).select("block", F.lit(0).alias("feature"), F.get("features", F.lit(0)).alias("value"))
    got = {r["value"]: r["next_value"] for r in S.successors(df, ["block", "feature"], buckets=16).collect()}
    ordered = sorted(xs)
    assert got == dict(zip(ordered, [*ordered[1:], None]))


def table(spark, n=4000, classes=3):
    """Two numbers and two categories; the label depends on all of them."""
    df = spark.range(n).select(
        F.col("id").alias("instance"), (F.col("id") * 7919 % 1009 / 10.0).alias("a"), (F.col("id") * 104729 % 499).cast("double").alias("b"),
        (F.col("id") * 31 % 4).cast("double").alias("c"), (F.col("id") * 17 % 11).cast("double").alias("d"))
    score = (F.col("a") > 50).cast("int") + ((F.col("c") == 2) | (F.col("d") > 6)).cast("int")
    return df.select("instance", F.least(score, F.lit(classes - 1)).cast("double").alias("label"),
                     F.array("a", "b", "c", "d").alias("features"))


def node_rows(model):
    return model.layer.nodes.orderBy("tree", "node").collect()


@pytest.mark.parametrize("is_random", [False, True])
@pytest.mark.parametrize("classes", [2, 3])
def test_one_group_and_many_grow_and_score_alike(spark, is_random, classes):
    config = ForestConfig(num_classes=classes, trees=3, max_depth=4, feature_subset="all", crf_feature_subset="all")
    arity = {2: 4, 3: 11}
    df = table(spark, classes=classes)
    fast = fit_forest(df, config, is_random, 4, arity)
    slow = fit_forest(df, config, is_random, 4, arity, state_bytes=0)
    switched = fit_forest(df, config, is_random, 4, arity, state_bytes=3000)
    a, b, c = node_rows(fast), node_rows(slow), node_rows(switched)
    for other in (b, c):
        assert [(r["tree"], r["node"], r["is_leaf"], r["feature"], r["mask"], r["counts"]) for r in a] == \
               [(r["tree"], r["node"], r["is_leaf"], r["feature"], r["mask"], r["counts"]) for r in other]
    assert {r["kind"] for r in a if not r["is_leaf"]} - {S.CONTINUOUS}
    by_key = {(r["tree"], r["node"]): r for r in a}
    for r in a:
        if not r["is_leaf"]:
            left, right = by_key[r["tree"], 2 * r["node"]], by_key[r["tree"], 2 * r["node"] + 1]
            assert [x + y for x, y in zip(left["counts"], right["counts"])] == r["counts"]
    p = {r["instance"]: r["probability"] for r in fast.transform(df).collect()}
    q = {r["instance"]: r["probability"] for r in slow.transform(df).collect()}
    assert len(p) == 4000 and all(np.allclose(p[i], q[i]) and abs(sum(p[i]) - 1) < 1e-9 for i in p)


def test_leaf_counts_are_the_training_rows(spark):
    df = table(spark)
    model = fit_forest(df, ForestConfig(num_classes=3, trees=2, max_depth=5), True, 4)
    leaves = model.layer.nodes.filter("is_leaf").select("tree", F.aggregate(
        "counts", F.lit(0.0), lambda acc, x: acc + x).alias("n")).groupBy("tree").agg(F.sum("n").alias("n"))
    assert {r["n"] for r in leaves.collect()} == {4000.0}


def test_growth_may_find_no_cut_at_all(spark):
    """Too few rows for any child: roots stay leaves, on both ways."""
    df = table(spark, 12)
    for bound in (2_000_000, 0):
        model = fit_forest(df, ForestConfig(num_classes=3, trees=3, max_depth=4, min_instances=7), True, 4,
                           state_bytes=bound)
        assert [r["is_leaf"] for r in node_rows(model)] == [True] * 3
        assert model.transform(df).count() == 12
    deep = fit_forest(df, ForestConfig(num_classes=3, trees=6, max_depth=30), True, 4)
    assert deep.layer.size() >= 6


def test_accuracy_like_the_library_forest(spark):
    df = table(spark)
    config = ForestConfig(num_classes=3, trees=10, max_depth=6, feature_subset="all")
    ours = M.report(M.confusion(fit_forest(df, config, False, 4).transform(df), vector="probability"), 3).first()
    theirs = M.report(M.confusion(library_forest_vectors(df, df, config), vector="probability"), 3).first()
    assert ours["accuracy"] > 0.95 and abs(ours["accuracy"] - theirs["accuracy"]) < 0.03


def test_impure_labels_with_one_hot_block(spark):
    """A third of all rows in one block, a constant feature, and a class that one block lacks."""
    df = table(spark).withColumn("block", F.when(F.col("instance") % 3 == 0, 0).otherwise(F.col("instance") % 5 + 1))
    df = df.filter("block != 2 or label < 2").withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    config = ForestConfig(num_classes=3, rf_num=1, crf_num=1, sub_rf_num=3, trees=2, max_depth=4, max_layers=2)
    model = fit_block_cascade(df, df.drop("block").limit(500), config)
    out = model.transform(df)
    assert out.count() == df.count()
    assert {len(r["probability"]) for r in out.select("probability").distinct().collect()} == {3}


def test_block_cascade_widths_history_and_reload(spark, tmp_path):
    df = table(spark).withColumn("block", F.col("instance") % 5)
    train, test = df.filter("instance < 3000"), df.filter("instance >= 3000").drop("block")
    config = ForestConfig(num_classes=3, rf_num=1, crf_num=2, sub_rf_num=2, trees=2, max_depth=4, max_layers=2,
                          feature_subset="all", crf_feature_subset="all")
    model = fit_block_cascade(train, test, config)
    assert len(model.layers) == 2 and len(model.history) == 4
    assert {h["n_total"] for h in model.history if h["split"] == "test"} == {1000}
    assert {t.subset for t in model.layers[0].trees} == {4} and {t.subset for t in model.layers[1].trees} == {7}
    assert all(len({t.block for t in model.layers[0].trees if t.model == m}) == 2 for m in range(3))
    scored = model.transform(test)
    report = M.report(M.confusion(scored, vector="probability"), 3).first()
    last = next(h for h in model.history if h["layer"] == 2 and h["split"] == "test")
    assert report["accuracy"] == pytest.approx(last["accuracy"])
    save_cascade(model, str(tmp_path / "m"))
    again = load_cascade(spark, str(tmp_path / "m"))
    key = lambda rows: sorted((r["instance"], tuple(r["probability"])) for r in rows)
    assert key(again.transform(test).collect()) == key(scored.collect())
    assert again.best_layer == model.best_layer and again.config == config
    with pytest.raises(ValueError, match="holds a cascade"):
        load_forest(spark, str(tmp_path / "m"))


def test_k_fold_cascade(spark):
    df = table(spark, 2000)
    config = ForestConfig(num_classes=3, rf_num=1, crf_num=1, trees=2, max_depth=4, max_layers=2,
                          feature_subset="all", crf_feature_subset="all")
    model = fit_cascade(df, config)
    assert {t.subset for t in model.layers[1].trees} == {4 + 2 * 3}
    assert all(h["n_total"] == 2 * 2000 for h in model.history)
    vectors, layer = out_of_fold_vectors(df, config, True)
    assert vectors.count() == 2000 and vectors.select("instance").distinct().count() == 2000
    sizes = {r["fold"]: r["n"] for r in vectors.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    roots = {r["tree"]: sum(r["counts"]) for r in layer.nodes.filter("node = 1").collect()}
    for t in layer.trees:
        assert roots[t.tree] == 2000 - (sizes[t.fold_out] if t.fold_out >= 0 else 0)


def test_forest_reload_and_importance(spark, tmp_path):
    df = table(spark)
    model = fit_forest(df, ForestConfig(num_classes=3, trees=3, max_depth=4, feature_subset="all"), False, 4)
    save_forest(model, str(tmp_path / "f"))
    again = load_forest(spark, str(tmp_path / "f"))
    key = lambda rows: sorted((r["instance"], tuple(r["probability"])) for r in rows)
    assert key(again.transform(df).collect()) == key(model.transform(df).collect())
    importance = {r["feature"]: r["importance"] for r in model.feature_importances().collect()}
    assert sum(importance.values()) == pytest.approx(1) and min(importance, key=importance.get) == 1


@pytest.mark.parametrize("change", [
    {"num_classes": 1}, {"trees": 0}, {"max_depth": 31}, {"min_info_gain": -1.0}, {"rf_num": 0, "crf_num": 0},
    {"feature_subset": "some"}, {"data_style": "Img"}, {"max_bins": 1}, {"early_stopping_rounds": 0}])
def test_config_is_checked(change):
    with pytest.raises(ValueError):
        ForestConfig(**change)


def bad_rows():
    return {"label": ["label = 3.0", "label = -1.0", "label = 0.5", "label = NULL"],
            "features": ["features = NULL", "features = array(1D)", "features = array(1D, 2D, 3D, 4D, 5D)",
                         "features = array(1D, 2D, 3D, NULL)", "features = array(1D, 2D, 4D, 3D)", "features = array(1D, 2D, -1D, 3D)"]}


@pytest.mark.parametrize("change", [c for cs in bad_rows().values() for c in cs])
def test_bad_rows_are_errors(spark, change):
    df = table(spark, 40, classes=3)
    name, value = change.split(" = ", 1)
    kind = dict(df.dtypes)[name]
    bad = df.withColumn(name, F.expr(f"CASE WHEN instance = 7 THEN CAST({value} AS {kind}) ELSE {name} END"))
    config = ForestConfig(num_classes=3, trees=1, max_depth=2, rf_num=1, crf_num=0, max_layers=1, sub_rf_num=1, num_folds=2)
    arity = {2: 4, 3: 11}
    with pytest.raises(Exception, match="label outside|features need"):
        fit_forest(bad, config, False, 4, arity)
    if name == "features":
        model = fit_forest(df, config, False, 4, arity)
        with pytest.raises(Exception, match="features need"):
            model.transform(bad).collect()


def test_scoring_keeps_rows_with_null_and_repeated_ids(spark):
    df = table(spark, 400)
    model = fit_forest(df, ForestConfig(num_classes=3, trees=4, max_depth=3), False, 4)
    odd = df.withColumn("instance", F.expr("CASE WHEN instance < 10 THEN NULL ELSE instance % 50 END"))
    rows = sorted((str(r["features"]), str(np.round(r["probability"], 9))) for r in model.transform(odd).collect())
    model.state_bytes = 0
    assert len(rows) == 400
    assert rows == sorted((str(r["features"]), str(np.round(r["probability"], 9))) for r in model.transform(odd).collect())


def group_input(spark):
    """Rows of few different values: 3 x 2 of them over two blocks and two folds, 900 times each or more."""
    return spark.range(0, 12_000, 1, 2).selectExpr(
        "id % 2 AS block", "int(id % 4 div 2) AS fold", "id * 7919 % 4294967296 AS row_hash", "double(id % 3 = 0) AS label",
        "array(double(id % 3), double(id % 5 = 0)) AS features")


def test_equal_rows_are_grouped_and_keep_their_draws(spark, monkeypatch):
    rows = group_input(spark)
    config = ForestConfig(trees=2, max_depth=3, seed=5)
    binning = fit_binning(rows, [0, 1], 2, config)
    single = sorted((r["block"], r["fold"], r["label"], bytes(r["bins"]), r["row_hash"] % tasks.MIX_RANGE) for r in bin_points(rows, binning).collect())

    def groups():
        return grouped_points(rows, binning).collect()

    found = groups()
    spread = sorted((r["block"], r["fold"], r["label"], bytes(r["bins"]), h) for r in found for h in np.frombuffer(r["hashes"], "<u4").tolist())
    assert spread == single
    # a level walks groups: 64 rows in each, but for one rest per value, block, fold and task
    assert len(found) <= 12_000 / tasks.GROUP_ROWS + 2 * 24 and max(len(r["hashes"]) for r in found) == 4 * tasks.GROUP_ROWS

    trees = plan_trees([[0, 1], [0, 1]], {1}, 2, config, 1, folds_out=(-1, 0, 1))

    def nodes():
        return sorted(map(str, fit_layer(rows, trees, binning, config).nodes.collect()))

    grouped = nodes()
    monkeypatch.setattr(tasks, "GROUP_ROWS", 1)
    assert nodes() == grouped and len(grouped) > len(trees)


def test_weights_of_groups_are_sums_of_draws():
    rows = np.arange(1, 1_001, dtype=np.int64) * 7919
    sizes = np.array([1, 64, 35, 400, 500])
    tree = {"bootstrap": True, "rate": 1.0, "tree_hash": 99, "poisson": np.array([int(p * tasks.MIX_RANGE) for p in poisson_cdf(1.0)])}
    single = np.searchsorted(tree["poisson"], mix_array(rows, 99), "right")
    assert tasks.tree_weights(rows, tree).tolist() == single.tolist()
    ends = np.cumsum(sizes)
    assert tasks.group_weights(rows, sizes, tree).tolist() == [int(single[a:b].sum()) for a, b in zip(ends - sizes, ends)]
    assert tasks.group_weights(rows, sizes, {**tree, "bootstrap": False}) is sizes


def test_last_layer_is_not_written_and_names_only_for_progress(spark, tmp_path, monkeypatch):
    from layerwood.plans import cascade as C

    written = []
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name, path=None: written.append((name, set(df.columns))) or real(df, name, path))
    rows = group_input(spark).selectExpr("row_hash AS instance", "block", "label", "features")
    config = ForestConfig(rf_num=1, crf_num=1, sub_rf_num=1, trees=2, max_depth=2, max_layers=2, early_stopping_rounds=5)
    model = C.fit_block_cascade(rows, rows.drop("block"), config)
    assert [n for n, _ in written] == ["layer-input", "layer-1"] and all(not c & {"instance", "vector"} for _, c in written)
    del written[:]
    kept = C.fit_block_cascade(rows, rows.drop("block"), config, progress_path=f"{tmp_path}/fit")
    assert [n for n, _ in written] == ["layer-input", "layer-1", "layer-2"] and {"instance", "vector"} <= written[-1][1]
    assert kept.history == model.history and len(model.history) == 4


def test_votes_in_groups_need_no_null_vector(spark, monkeypatch):
    rows = group_input(spark)
    config = ForestConfig(trees=3, max_depth=2, seed=5)
    layer = fit_layer(rows, plan_trees([[0, 1]], set(), 2, config, 1), fit_binning(rows, [0, 1], 2, config), config)
    whole = with_class_vectors(rows, layer, "vector").select("row_hash", "vector").collect()
    written = []
    monkeypatch.setattr(scoring, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    parts = with_class_vectors(rows, layer, "vector", state_bytes=0)
    assert len(layer.groups(0)) == len(layer.trees) == len(written) + 1  # written between the passes only
    assert "null" not in parts._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(np.allclose(a["vector"], b["vector"]) for a, b in zip(sorted(whole), sorted(parts.select("row_hash", "vector").collect())))
