"""Evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..operators import metrics as M
from .registry import LINE_KEYS, LINE_SCORES_SQL, line_scores, query

CONFUSION_SQL = f"""
WITH {LINE_SCORES_SQL},
classes AS (SELECT unnest(range(3)) AS class),
counts AS (
  SELECT class, cast(sum(CASE WHEN label = class AND predicted = class THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         cast(sum(CASE WHEN label <> class AND predicted = class THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         cast(sum(CASE WHEN label = class AND predicted <> class THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM scores, classes GROUP BY class),
macro AS (
  SELECT avg(tp / greatest(tp + fp, 1)) AS p, avg(tp / greatest(tp + fn, 1)) AS r,
         sum(tp) / sum(tp + fp) AS p0,
         sum(cast(tp + fp AS DOUBLE) * (tp + fn)) / (cast(sum(tp + fp) AS DOUBLE) * sum(tp + fp)) AS pe
  FROM counts)
"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.report(M.confusion(line_scores(spark, sf_dir)), 3)


@query("argmax_match", f"""
WITH {LINE_SCORES_SQL}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(predicted AS INTEGER) AS predicted,
       predicted = label AS is_right FROM scores""")
def argmax_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = argmax("features")
    return line_scores(spark, sf_dir).select(*LINE_KEYS, top.alias("predicted"),
                                             (top == F.col("label").cast("int")).alias("is_right"))


@query("confusion_counts", f"""
WITH {LINE_SCORES_SQL}
SELECT cast(label AS INTEGER) AS label, cast(predicted AS INTEGER) AS predicted, count(*) AS n
FROM scores GROUP BY 1, 2""")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(line_scores(spark, sf_dir))


@query("class_outcomes", CONFUSION_SQL + "SELECT cast(class AS INTEGER) AS class, tp, fp, fn FROM counts")
def class_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_counts(M.confusion(line_scores(spark, sf_dir)), 3)


@query("accuracy", f"""
WITH {LINE_SCORES_SQL}
SELECT cast(sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_right, count(*) AS n_total,
       round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM scores""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.accuracy(M.confusion(line_scores(spark, sf_dir)))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query("accuracy_prediction", """
SELECT round(avg(CASE WHEN least(floor(l_discount * 30), 2) =
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy
FROM lineitem""")
def accuracy_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_scores(spark, sf_dir).withColumn(
        "prediction", F.least(F.floor(F.get("features", F.lit(0)) / 10 * 30), F.lit(2)).cast("double"))
    return M.accuracy(M.confusion(rows, vector=None, prediction="prediction")).select(
        F.round("accuracy", 9).alias("accuracy"))


@query("macro_precision", CONFUSION_SQL + "SELECT round(p, 9) AS macro_precision FROM macro")
def macro_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select(F.round("precision", 9).alias("macro_precision"))


@query("macro_f1", CONFUSION_SQL + "SELECT round(r, 9) AS macro_recall, round(2 * p * r / (p + r), 9) AS macro_f1 FROM macro")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select(F.round("recall", 9).alias("macro_recall"), F.round("f1", 9).alias("macro_f1"))


@query("cohen_kappa", CONFUSION_SQL + "SELECT round((p0 - pe) / (1 - pe), 9) AS kappa FROM macro")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select(F.round("kappa", 9).alias("kappa"))


SPLIT_SQL = """
WITH base AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         CASE WHEN l_discount * 10 >= l_tax * 12 AND l_discount * 10 >= l_quantity / 50 THEN 0
              WHEN l_tax * 12 >= l_quantity / 50 THEN 1 ELSE 2 END AS predicted FROM lineitem),
counts AS (
  SELECT split, class, sum(CASE WHEN label = class AND predicted = class THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label <> class AND predicted = class THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = class AND predicted <> class THEN 1 ELSE 0 END) AS fn
  FROM base, (SELECT unnest(range(3)) AS class) GROUP BY split, class),
macro AS (
  SELECT split, avg(tp / greatest(tp + fp, 1)) AS p, avg(tp / greatest(tp + fn, 1)) AS r,
         sum(tp) / sum(tp + fp) AS p0,
         sum(cast(tp + fp AS DOUBLE) * (tp + fn)) / (cast(sum(tp + fp) AS DOUBLE) * sum(tp + fp)) AS pe
  FROM counts GROUP BY split)
SELECT split, round(p0, 9) AS accuracy, round(p, 9) AS macro_precision, round(2 * p * r / (p + r), 9) AS macro_f1,
       round((p0 - pe) / (1 - pe), 9) AS kappa FROM macro"""


@query("metrics_report", SPLIT_SQL)
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four metrics for train and test from one pass."""
    split = F.when(F.col("l_linestatus") == "F", "train").otherwise("test")
    rows = line_scores(spark, sf_dir).withColumn("split", split)
    out = M.report(M.confusion(rows, by=("split",)), 3, by=("split",))
    return out.select("split", F.round("accuracy", 9).alias("accuracy"), F.round("precision", 9).alias("macro_precision"),
                      F.round("f1", 9).alias("macro_f1"), F.round("kappa", 9).alias("kappa"))


@query("pooled_accuracy", f"""
WITH {LINE_SCORES_SQL}
SELECT cast(sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_right, count(*) AS n_total,
       round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM scores""")
def pooled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each line number's rows, merged by adding the counters."""
    parts = M.accuracy(M.confusion(line_scores(spark, sf_dir), by=("l_linenumber",)), by=("l_linenumber",))
    return M.pooled_accuracy(parts).withColumn("accuracy", F.round("accuracy", 9))


@query("pooled_report", CONFUSION_SQL + """
SELECT round(p, 9) AS macro_precision, round(r, 9) AS macro_recall, round(2 * p * r / (p + r), 9) AS macro_f1,
       round((p0 - pe) / (1 - pe), 9) AS kappa FROM macro""")
def pooled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and kappa of all rows from the confusion tables of each line number's rows."""
    parts = M.confusion(line_scores(spark, sf_dir), by=("l_linenumber",))
    out = M.pooled_report(parts, 3)
    return out.select(F.round("precision", 9).alias("macro_precision"), F.round("recall", 9).alias("macro_recall"),
                      F.round("f1", 9).alias("macro_f1"), F.round("kappa", 9).alias("kappa"))


LAYER_SQL = """
layer_log AS (
  SELECT l_linenumber AS layer,
         round(avg(CASE WHEN l_discount * 10 > l_tax * 12 AND l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy
  FROM lineitem GROUP BY 1)
"""


def layer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of accuracy per layer, here the line number."""
    hit = (F.get("features", F.lit(0)) > F.get("features", F.lit(1))) & (F.col("label") == 0)
    return line_scores(spark, sf_dir).groupBy(F.col("l_linenumber").alias("layer")).agg(
        F.round(F.avg(hit.cast("double")), 9).alias("accuracy"))


@query("best_layer", f"""
WITH {LAYER_SQL}
SELECT layer, accuracy FROM layer_log ORDER BY accuracy DESC, layer LIMIT 1""")
def best_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = layer_log(spark, sf_dir).orderBy("layer").collect()  # one row per layer
    best = log[M.best_layer([r["accuracy"] for r in log]) - 1]
    return spark.createDataFrame([best], "layer int, accuracy double")


@query("early_stop", f"""
WITH {LAYER_SQL},
seen AS (
  SELECT a.layer, a.accuracy,
         (SELECT b.layer FROM layer_log b WHERE b.layer <= a.layer ORDER BY b.accuracy DESC, b.layer LIMIT 1) AS best
  FROM layer_log a)
SELECT layer, accuracy, best AS best_so_far, layer - best >= 2 OR layer = 7 AS stop FROM seen""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop when the best layer is two layers back or the last layer is reached."""
    log = layer_log(spark, sf_dir).orderBy("layer").collect()  # one row per layer
    seen = [r["accuracy"] for r in log]
    rows = [(r["layer"], r["accuracy"], log[M.best_layer(seen[:n]) - 1]["layer"], M.should_stop(seen[:n], 2, 7))
            for n, r in enumerate(log, 1)]
    return spark.createDataFrame(rows, "layer int, accuracy double, best_so_far int, stop boolean")
