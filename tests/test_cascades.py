"""Left-out folds, restarts and versions of models."""

import pytest
from pyspark.sql import functions as F

from layerwood import ForestConfig
from layerwood.plans import persist, store
from layerwood.plans.cascade import fit_block_cascade, fit_cascade, scored_rows
from layerwood.plans.persist import load_cascade, load_forest, save_cascade

CONFIG = ForestConfig(rf_num=1, crf_num=1, sub_rf_num=2, trees=2, max_depth=4, max_layers=2, seed=3)


@pytest.fixture(scope="module")
def rows(spark):
    """Labels are noise: only trees that saw a row can know its label."""
    noise = F.pmod(F.xxhash64("id"), F.lit(2)).cast("double")
    return spark.range(600).select(F.col("id").alias("instance"), (F.col("id") % 3).alias("block"), noise.alias("label"),
                                   F.array((F.col("id") * 7919 % 601).cast("double"), (F.col("id") * 31 % 97).cast("double")).alias("features"))


def accuracy(model):
    return next(h["accuracy"] for h in model.history if h["layer"] == 1 and h["split"] == "train")


def test_folds_left_out_do_not_know_the_labels(spark, rows, tmp_path):
    deep = CONFIG.replace(max_depth=20, sub_rf_num=3, max_layers=1)
    by_own_trees = accuracy(fit_block_cascade(rows, None, deep))
    model = fit_block_cascade(rows, None, deep, cv=3, progress_path=str(tmp_path / "cv"))
    assert by_own_trees > 0.62 and abs(accuracy(model) - 0.5) < 0.08
    out = scored_rows(spark, str(tmp_path / "cv"))
    assert out.count() == 600 and out.filter("fold NOT IN (0, 1, 2)").count() == 0
    with pytest.raises(ValueError, match="cv"):
        fit_block_cascade(rows, None, deep, cv=1)


def test_progress_of_another_fit_is_refused(spark, rows, tmp_path):
    path = str(tmp_path / "fit")
    whole = fit_block_cascade(rows, rows, CONFIG, progress_path=path)
    again = fit_block_cascade(rows, rows, CONFIG, progress_path=path, after_layer=lambda i: pytest.fail("fitted again"))
    assert again.history == whole.history and len(again.layers) == 2
    with pytest.raises(ValueError, match="another fit"):
        fit_block_cascade(rows, rows, CONFIG.replace(trees=3), progress_path=path)
    with pytest.raises(ValueError, match="no complete layer"):
        scored_rows(spark, str(tmp_path / "none"))


def test_a_layer_without_its_last_line_does_not_count(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "fit")
    real = store.publish

    def broken(spark, folder, facts):
        if folder.endswith("2"):
            raise OSError("lost")
        real(spark, folder, facts)

    monkeypatch.setattr(store, "publish", broken)
    with pytest.raises(OSError):
        fit_block_cascade(rows, rows, CONFIG, progress_path=path)
    monkeypatch.setattr(store, "publish", real)
    seen = []
    model = fit_block_cascade(rows, rows, CONFIG, progress_path=path, after_layer=seen.append)
    assert seen == [2] and model.history == fit_block_cascade(rows, rows, CONFIG).history


def probabilities(model, rows):
    return [[round(x, 9) for x in r["probability"]] for r in model.transform(rows).orderBy("instance").collect()]


@pytest.mark.parametrize("concat", [False, True])
def test_a_broken_save_leaves_the_model_before(spark, rows, tmp_path, monkeypatch, concat):
    path = str(tmp_path / "model")
    fit = (lambda c: fit_cascade(rows, c)) if concat else (lambda c: fit_block_cascade(rows, None, c))
    first, second = fit(CONFIG.replace(max_layers=1)), fit(CONFIG)
    save_cascade(first, path)
    monkeypatch.setattr(persist, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        save_cascade(second, path)
    monkeypatch.undo()
    assert probabilities(load_cascade(spark, path), rows) == probabilities(first, rows)
    for _ in range(3):
        save_cascade(second, path)
    loaded = load_cascade(spark, path)
    assert probabilities(loaded, rows) == probabilities(second, rows) and loaded.feed == second.feed
    assert len(store.numbers(spark, path, "version")) == persist.KEPT
    with pytest.raises(ValueError, match="holds a cascade"):
        load_forest(spark, path)
    with pytest.raises(ValueError, match="no complete version"):
        load_cascade(spark, str(tmp_path / "nothing"))
