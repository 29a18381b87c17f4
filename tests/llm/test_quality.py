"""The additive quality model: features against a plain count, tables against brute force, held-out accuracy."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerwood.llm import quality
from layerwood.llm.quality import FEATURES, QualityModel, best_cut, boost, describe, fit_quality, line_tree, plane_tree, quality_score, text_features
from layerwood.llm.queries_quality import op13_quality
from layerwood.llm.text import joined

DOCS = "doc_id long, text string, content long, features string, score double"
EDGE = [(1, "Good plain words. More of them here.\nAnd a line."), (1, "Good plain words. More of them here.\nAnd a line."), (2, None), (None, ""), (3, "A!! B!! C!!\nA!! B!! C!!"),
        (4, "x" * 50_000), (5, "\n\n\n"), (6, "é ü 12 $$$ $$$ ***"), (7, "same line\nsame line\nsame line")]


def features_of(texts):
    import pyarrow as pa

    return describe(*joined(pa.array(texts, pa.string())))


def slow_some(text):
    raw = (text or "").encode()
    words = [w for w in "".join(chr(b) if b < 128 else "\x80" for b in raw).split(" ") for w in w.replace("\n", " ").split()]
    words = [w for w in raw.replace(b"\n", b" ").split(b" ") if w]
    lines = [x for x in raw.split(b"\n") if x]
    n = collections.Counter(raw)
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in n.values()) if raw else 0.0
    pairs = list(zip(words, words[1:]))
    runs = list(zip(*(words[i:] for i in range(5))))
    again = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    return {"bytes": math.log1p(len(raw)), "words": math.log1p(len(words)), "lines": math.log1p(len(lines)), "byte_entropy": entropy,
            "words_again": again(words), "pairs_again": again(pairs), "runs_again": again(runs), "lines_again": again(lines),
            "top_word": max(collections.Counter(words).values()) / len(words) if words else 0.0,
            "capitals": sum(65 <= b < 91 for b in raw) / max(1, sum(65 <= b < 91 or 97 <= b < 123 for b in raw)),
            "digits": sum(48 <= b < 58 for b in raw) / max(1, len(raw)), "short_words": sum(len(w) <= 2 for w in words) / max(1, len(words))}


def test_features_equal_a_plain_count(monkeypatch):
    texts = [t for _, t in EDGE]
    for batch in (quality.BATCH, 7):
        monkeypatch.setattr(quality, "BATCH", batch)
        rows = features_of(texts)
        assert rows.shape == (len(texts), len(FEATURES)) and np.isfinite(rows).all()
        for row, t in zip(rows, texts):
            for name, want in slow_some(t).items():
                assert row[FEATURES.index(name)] == pytest.approx(want, abs=1e-9), (name, t)


def test_features_of_a_table(spark):
    df = spark.createDataFrame([(i, t, 0, "x", 0.5) for i, t in EDGE], DOCS)
    rows = text_features(df, into="features").collect()
    assert len(rows) == len(EDGE) and rows[0].asDict().keys() == {"doc_id", "text", "content", "score", "features"}
    assert text_features(df.limit(0)).count() == 0


def test_cuts_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=7), rng.uniform(0.5, 2, 7)
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        want = max((worth(0, c) + worth(c, 7) - worth(0, 7), c) for c in range(1, 7) if min(h[:c].sum(), h[c:].sum()) >= 1)
        got = best_cut(g, h, 1.0, 1.0)
        assert got == (pytest.approx(want[0]), want[1]) if want[0] > 0 else got == (0.0, 0)
        leaf = line_tree(g, h, 2, 1.0, 1.0)
        assert leaf[0] == pytest.approx(g[:want[1]].sum() / (h[:want[1]].sum() + 1)) if want[0] > 0 else len(set(leaf)) == 1


def test_planes_find_an_exclusive_or():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(4_000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = boost(x, y, np.arange(len(y)) % 6 == 0)
    assert model.pairs[0] == (0, 1)
    assert ((model.add_up(x) >= 0.5) == y).mean() > 0.9
    gain, values = plane_tree(np.array([[3.0, -3.0], [-3.0, 3.0]]), np.full((2, 2), 5.0), 1.0, 1.0)
    assert gain > 0 and (np.sign(values) == [[1, -1], [-1, 1]]).all()


def test_scores_are_sums_of_tables():
    model = QualityModel(0.5, (np.array([1.0]), np.array([])), (np.array([-1.0, 2.0]), np.array([0.25])), (np.array([1.0]), np.array([3.0])), ((0, 1),),
                         (np.array([[0.0, 1.0], [2.0, 4.0]]),))
    got = model.add_up(np.array([[0.0, 0.0], [1.0, 3.0]]))
    want = [0.5 - 1 + 0.25 + 0, 0.5 + 2 + 0.25 + 4]
    assert got == pytest.approx([1 / (1 + math.exp(-w)) for w in want])


def test_labels_of_one_class_or_none(spark):
    docs = text_features(spark.createDataFrame([(i, t, 0, "x", 0.5) for i, t in EDGE], DOCS).withColumn("content", F.xxhash64("text")))
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, want in (([], 0.5), ([(1, None), (None, 1), (99, 0)], 0.5), ([(1, 1), (3, 1)], 1.0), ([(1, 0), (3, 0)], 0.0)):
        model = fit_quality(docs, labels(rows))
        scores = [r["s"] for r in docs.select(quality_score(model, F.col("features")).alias("s")).collect()]
        assert len(scores) == len(EDGE) and scores == pytest.approx([want] * len(EDGE), abs=1e-4)
    assert docs.limit(0).select(quality_score(model, F.col("features"))).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op13_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["predicted"] == 0 for r in bad]) > 0.9


def test_empty_texts_have_a_score(spark, sf_dir):
    rows = op13_quality(spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
