"""op13: quality of whole texts, held out by checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .quality import fit_quality, quality_score, text_features
from .text import fold

#: Documents of this score or more are good.
GOOD = 0.5


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text")
    rows = materialize(text_features(rows, keep_text=False), "quality-features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(rows, labels.filter(fold("doc_id", 3) != 1))
    scored = rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), quality_score(model, F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
