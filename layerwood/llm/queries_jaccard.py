"""op4: near-duplicate documents and their numbers of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard import jaccard_join


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
