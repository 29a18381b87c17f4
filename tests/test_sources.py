import pytest
from pyspark.sql import functions as F

from layerwood import ForestConfig
from layerwood.plans.job import run_job
from layerwood.sources.delimited import keep_data_lines, load_delimited, numbered_lines, parse_delimited, parse_layer_lines, with_row_ids
from layerwood.sources.specs import DATASETS, FeatureSpec, dataset_spec, numbers, read_feature_specs
from layerwood.sources.tables import read_blocks, write_blocks, write_layer_text


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_line_filter(spark):
    kept = keep_data_lines(lines(spark, "", "x", "|c", "1,2", "ab")).collect()
    assert sorted(r["value"] for r in kept) == ["1,2", "ab"]


def test_labels(spark):
    forest = parse_delimited(lines(spark, ",".join(["1"] * 54 + ["7"])), DATASETS["covertype"], numbers(54)).first()
    assert forest["label"] == 6.0 and len(forest["features"]) == 54
    watch = parse_delimited(lines(spark, "9,3,1,2,3,4"), DATASETS["watch_acc"], numbers(5)).first()
    assert watch["label"] == 2.0 and watch["features"] == [9, 1, 2, 3, 4]
    specs = numbers(13) + [FeatureSpec.parse("x, y")]
    for tail, label in ((" >50K", 1.0), (" <=50K.", 0.0)):
        row = parse_delimited(lines(spark, ",".join(["1"] * 13 + ["y", tail])), DATASETS["uci_adult"], specs).first()
        assert row["label"] == label and row["features"][-3:] == [0, 0, 1]
    later = parse_delimited(lines(spark, ",".join(["5"] * 30 + ["1"])), DATASETS["higgs"], numbers(30)).first()
    assert later["label"] == 1.0 and len(later["features"]) == 30


def test_bad_lines_fail(spark):
    with pytest.raises(Exception, match="fields, expected"):
        parse_delimited(lines(spark, "1,2,3"), DATASETS["susy"], numbers(18)).collect()
    with pytest.raises(Exception, match="encoded width"):
        parse_delimited(lines(spark, ",".join(["1"] * 21)), DATASETS["susy"], numbers(18)).collect()
    with pytest.raises(ValueError, match="unknown dataset"):
        dataset_spec("iris")


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name, low in (("b", 300), ("a", 0), ("c", 900)):
        (tmp_path / name).write_text("|junk\n\n" + "".join(f"{i},x\n" for i in range(low, low + 300)))
    got, kept = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got.append({r["value"]: r["instance"] for r in numbered_lines(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got[0] == got[1] == got[2] and sorted(got[0].values()) == list(range(900))
    assert got[0]["0,x"] == 0 and got[0]["300,x"] == 300 and got[0]["1199,x"] == 899


def test_job_reads_chosen_blocks_only(spark, tmp_path):
    (tmp_path / "spec").write_text("C\n" * 5)
    (tmp_path / "data").write_text("".join(f"{i % 50},{i % 2 + 1},{i % 7},2,3,{i % 2}\n" for i in range(600)))
    config = ForestConfig(num_classes=18, rf_num=1, crf_num=1, sub_rf_num=1, trees=1, max_depth=3, max_layers=1)
    path = str(tmp_path / "blocks")
    model = run_job(spark, "watch_acc", str(tmp_path / "data"), str(tmp_path / "spec"), config, 6, 3, blocks_path=path)
    assert {h["split"] for h in model.history} == {"train", "test"} and all(h["accuracy"] > 0.9 for h in model.history)
    plan = read_blocks(spark, path, [1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [block" in plan


def test_load_from_files(spark, tmp_path):
    (tmp_path / "spec").write_text("C\nC\nC\nC\nC\n")
    (tmp_path / "data").write_text("|junk\n" + "".join(f"{i},{i % 18 + 1},1,2,3,4\n" for i in range(500)))
    assert len(read_feature_specs(spark, str(tmp_path / "spec"))) == 5
    df = load_delimited(spark, "watch_acc", str(tmp_path / "data"), str(tmp_path / "spec"), partitions=3)
    assert df.columns == ["instance", "label", "features"]
    assert df.count() == 500 and df.select("instance").distinct().count() == 500
    assert df.rdd.getNumPartitions() == 3
    named = load_delimited(spark, "watch_acc", "train", str(tmp_path / "spec"), phases={"train": str(tmp_path / "data")})
    assert named.count() == 500


def test_layer_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(7, 2, 1.0, [0.1, 1e-9, 3.0]), (8, 3, 0.0, [1e12, 2.0, -4.5])],
                               "instance long, block long, label double, features array<double>")
    write_layer_text(df, str(tmp_path / "layer"))
    back = parse_layer_lines(spark.read.text(str(tmp_path / "layer")), True)
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())


def test_blocks_are_pruned_and_kept(spark, tmp_path):
    path = str(tmp_path / "blocks")
    # one block holds most rows
    df = spark.range(9000).select(F.col("id").alias("instance"), F.when(F.col("id") % 3 > 0, 1).otherwise(
        F.col("id") % 5).cast("long").alias("block"))
    write_blocks(df, path)
    chosen = read_blocks(spark, path, [1, 4])
    assert chosen.count() == df.filter("block in (1, 4)").count()
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "IN (1,4)" in plan.replace("block#", "").replace(" in", " IN") or "1,4" in plan
    write_blocks(df.limit(1), path, mode="ignore")
    assert spark.read.parquet(path).count() == 9000


def test_row_ids_are_contiguous(spark):
    ids = [r["instance"] for r in with_row_ids(spark.range(1000).repartition(7)).collect()]
    assert sorted(ids) == list(range(1000))
