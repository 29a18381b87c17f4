import math

import pytest

from layerwood.operators import metrics as M
from layerwood.operators import vectors as V


def frame(spark, pairs, classes):
    rows = [(float(label), [1.0 if k == p else 0.0 for k in range(classes)], float(p)) for label, p in pairs]
    return spark.createDataFrame(rows, "label double, features array<double>, prediction double")


def test_golden(spark):
    df = frame(spark, zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 0]), 3)
    counts = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in M.class_counts(M.confusion(df), 3).collect()}
    assert counts == {0: (1, 1, 1), 1: (2, 1, 0), 2: (0, 0, 1)}
    r = M.report(M.confusion(df), 3).first()
    assert r["accuracy"] == pytest.approx(0.6) and r["precision"] == pytest.approx(0.388889, abs=1e-6)
    assert r["recall"] == pytest.approx(0.5) and r["f1"] == pytest.approx(0.4375)
    assert r["kappa"] == pytest.approx(0.333333, abs=1e-6)
    assert M.accuracy(M.confusion(df, vector=None, prediction="prediction")).first()["accuracy"] == pytest.approx(0.6)


def test_undefined_values(spark):
    assert math.isnan(M.report(M.confusion(frame(spark, [(0, 1), (1, 0)], 2)), 2).first()["f1"])
    assert math.isnan(M.report(M.confusion(frame(spark, [(0, 0), (0, 0)], 2)), 2).first()["kappa"])
    assert M.accuracy(M.confusion(frame(spark, [], 2))).first()["accuracy"] == 0


def test_pooling_weighs_by_rows(spark):
    parts = spark.createDataFrame([(1, 1), (0, 9)], "n_right long, n_total long")
    assert M.pooled_accuracy(parts).first()["accuracy"] == pytest.approx(0.1)


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        M.confusion(spark.range(1))


def test_early_stop():
    accuracies, stopped = [], None
    for layer, a in enumerate([0.5, 0.7, 0.6, 0.65, 0.9], 1):
        accuracies.append(a)
        if M.should_stop(accuracies, rounds=2, max_layers=10):
            stopped = layer
            break
    assert stopped == 4 and M.best_layer(accuracies) == 2
    assert M.should_stop([0.1], rounds=9, max_layers=1)


def test_merge_and_stack(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0])], "instance long, block long, features array<double>")
    votes = spark.createDataFrame([(1, 0, 1, [0.4, 0.6]), (1, 0, 0, [0.8, 0.2])],
                                  "instance long, block long, forest int, features array<double>")
    assert V.concat_vectors(votes).first()["features"] == [0.8, 0.2, 0.4, 0.6]
    mean = V.stack_vectors(votes, 2)
    assert mean.first()["features"] == pytest.approx([0.6, 0.4])
    assert V.merge_features(df, mean).first()["features"] == pytest.approx([1, 2, 0.6, 0.4])
    assert V.merge_features(df, None).first()["features"] == [1, 2]
    with pytest.raises(ValueError):
        V.multi_grain_scan(df, "Img")
