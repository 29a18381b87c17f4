"""op2: score every document with a model learned from the training folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import score_documents
from .text import fold


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (fold("doc_id", 5) != 1).alias("train"))
    rows = score_documents(docs, F.col("train"))
    return rows.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
