"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram of ``ORDERS`` characters (A-Z lower-cased,
a blank before and behind each text).  From the labelled sample Spark counts in
how many texts of either class each n-gram stands; its log-count ratio is

    r = log((p1 + 1) / (n1 + 2)) - log((p0 + 1) / (n0 + 2)).

The n-grams that differ most surely between the classes (``max_features`` of
them, at least ``least_z`` standard errors; of those that stand in the same texts
``same_texts`` come first, the others after all the rest) carry the value r where present, and
a logistic regression with a quadratic penalty is fitted on them.

The model is fitted on a bounded sample: the ``fit_rows`` different labelled texts
with the smallest checksums; copies of a text count once.  Texts to be scored are read whole.

Defined cases: null texts count as empty; empty texts get the score of a text
without features; null labels and labels of unknown documents are left out; a
document with several labels is toxic if one of them says so; documents that
share an id share its label; a text is toxic if at least half of its labelled
documents are; without labels of both classes every score is the
share of toxic ones (0 without any label); further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, short_batches
from .text import mixed

ORDERS = (3, 4, 5)
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 19
BITS = 20


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes of n-grams in ascending order, what each adds, and the score of a text without any."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two blanks, and the n + 1 places where they begin."""
    flat = "".join(f" {t or ''} " for t in texts)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    return points, np.cumsum([0, *(len(t or "") + 2 for t in texts)])


def grams_of(points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams within texts, and where they begin; block by block, so memory is bounded."""
    for low in range(0, len(points), BLOCK):
        block = points[low:low + BLOCK + max(ORDERS) - 1].astype(np.uint64)
        rolled = np.zeros(len(block), np.uint64)
        ends = starts[np.searchsorted(starts, low, "right"):np.searchsorted(starts, low + len(block), "right")] - low
        for n in range(1, max(ORDERS) + 1):
            size = min(BLOCK, len(block) - n + 1)
            if size <= 0:
                break
            rolled = rolled[:len(block) - n + 1] * BASE + block[n - 1:]
            if n in ORDERS:
                inside = np.ones(size, bool)
                for back in range(1, n):
                    cut = ends - back
                    inside[cut[(cut >= 0) & (cut < size)]] = False
                place = np.flatnonzero(inside)
                yield rolled[:size][place] + np.uint64(n), place + low


def slices(texts: list[str | None], most: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` characters, one row at least."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if held > most:
            yield low, i
            low, held = i, 0
        held += len(t or "")
    if low < len(texts):
        yield low, len(texts)


def present(texts: list[str | None], keep: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct (row, n-gram of ``keep``) pairs: a first row, rows counted from it, and hashes."""
    seen = np.zeros(1 << BITS, bool)
    seen[(mixed(keep) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    for low, high in slices(texts):
        points, starts = characters(texts[low:high])
        found = []
        for gram, place in grams_of(points, starts):
            for narrow in (lambda g: seen[(mixed(g) >> np.uint64(64 - BITS)).astype(np.int64)], lambda g: np.isin(g, keep)):
                hit = np.flatnonzero(narrow(gram))
                gram, place = gram[hit], place[hit]
            found.append(np.stack([np.searchsorted(starts, place, "right") - 1, np.searchsorted(keep, gram)]))
        pairs = np.unique(np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1), axis=1).astype(np.int64)
        yield low, pairs[0], pairs[1]


def distinct_grams(text: str | None) -> np.ndarray:
    held = [g for g, _ in grams_of(*characters([text]))]
    return np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]))


def count_grams(sample: DataFrame) -> DataFrame:
    """Per n-gram of the sample (text, label, mark): in how many texts of class 0 and 1 it stands, and the sum of their marks.

    Summed within the tasks before the shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for low, high in slices(texts := batch.column(0).to_pylist()):
                each = [distinct_grams(t) for t in texts[low:high]]
                names, at = np.unique(np.concatenate(each), return_inverse=True)
                sizes = [len(g) for g in each]
                # sums of whole numbers below 2**53 are exact
                ones, marked = (np.bincount(at, np.repeat(x[low:high], sizes), len(names)).astype(np.int64) for x in (labels, marks))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, minlength=len(names)) - ones),
                                                  pa.array(ones), pa.array(marked)], ["gram", "n0", "n1", "mark"])

    parts = sample.select("text", "label", "mark").mapInArrow(counted, "gram long, n0 long, n1 long, mark long")
    return parts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "mark")))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the bias is not penalised."""
    n, f = x.shape
    z = np.random.default_rng(0).normal(size=f).astype(np.float32)
    for _ in range(20):
        z = x.T @ (x @ z)
        z /= max(np.linalg.norm(z), 1e-12)
    rate = 1.0 / (0.25 * (np.linalg.norm(x @ z) ** 2 / n + 1.0) + penalty)
    w, b = np.zeros(f), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        gap = 1.0 / (1.0 + np.exp(-np.clip(x @ v.astype(np.float32) + c, -30, 30))) - y
        nw, nb = v - rate * (x.T @ gap.astype(np.float32) / n + penalty * v), c - rate * gap.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 fit_rows: int = 12_000, max_features: int = 2_048, least_z: float = 4.5,
                 penalty: float = 1e-4, same_texts: int = 32) -> ToxicityModel:
    """Fit on the sample; only ids and hashes of the sample are broadcast, ``fit_rows`` at most."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("label"))
    rows = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("content", F.md5(F.col("text").cast("binary")))
    # texts are told apart by checksum, so only narrow rows are shuffled
    chosen = rows.select("_doc", "content").join(chosen, F.col("_doc") == F.col("_id")).groupBy("content").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label"), F.min("_id").alias("_id"))
    chosen = chosen.orderBy("content").limit(fit_rows)
    sample = rows.join(F.broadcast(chosen.withColumnRenamed("content", "_content")), (F.col("_doc") == F.col("_id")) & (F.col("content") == F.col("_content")))
    sample = sample.dropDuplicates(["content"]).select("_doc", "text", "label", F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).alias("mark"))
    sample = materialize(sample, "toxicity-sample")
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not n0 or not n1:
        return ToxicityModel(none.grams, none.weights, 40.0 if n1 else -40.0)
    p0, p1 = (F.col("n0") + 1) / (n0 + 2), (F.col("n1") + 1) / (n1 + 2)
    pooled = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    counted = count_grams(sample).select("gram", "n0", "n1", "mark", F.log(p1 / p0).alias("r"), F.abs((p1 - p0) / error).alias("z"))
    # n-grams of the same texts tell the same, so a text or its near copies cannot fill the list; what is beyond
    # max_features in its own group cannot be among the first, so this limit (applied in every task) drops nothing
    alike = Window.partitionBy("mark", "n0", "n1").orderBy(F.desc("z"), "gram")
    ranked = counted.filter(F.col("z") >= least_z).withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= max_features)
    with short_batches(docs.sparkSession):
        best = ranked.orderBy(F.col("nth") > same_texts, F.desc("z"), "gram").limit(max_features).collect()
    if not best:
        return ToxicityModel(none.grams, none.weights, float(np.log(n1 / n0)))
    grams = np.array([r["gram"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(grams)
    grams, ratio = grams[order], np.array([r["r"] for r in best])[order]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(grams)), bool)
            for low, rows, found in present(batch.column(1).to_pylist(), grams):
                bits[low + rows, found] = True
            packed = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2), packed], ["label", "bits"])

    with short_batches(docs.sparkSession):
        rows = sample.mapInArrow(marked, "label int, bits binary").toPandas()
    # a fixed order of rows, so that reruns give the same sums
    rows = rows.sort_values(["label", "bits"])
    bits = np.unpackbits(np.frombuffer(b"".join(map(bytes, rows["bits"])), np.uint8).reshape(len(rows), -1), axis=1)[:, :len(grams)]
    weights, bias = fit_linear(bits * ratio.astype(np.float32), rows["label"].to_numpy(float), penalty)
    return ToxicityModel(grams, weights * ratio, bias)


def score_texts(texts: list[str | None], model: ToxicityModel) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    if len(model.grams):
        for low, rows, grams in present(texts, model.grams):
            np.add.at(total, low + rows, model.weights[grams])
    return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.where(texts.notna(), None).tolist(), model))

    return scored(text)
