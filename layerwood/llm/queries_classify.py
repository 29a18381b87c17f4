"""op1 and op10: classifiers of whole texts, held out by checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import fit_languages, identify_languages
from .text import fold
from .toxicity import fit_toxicity, toxicity_score

#: Documents of this score or more are toxic.
TOXIC = 0.3


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5) == 0
    model = fit_languages(docs.filter(~held_out))
    rows = identify_languages(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def toxicity_model(docs: DataFrame, labels: DataFrame):
    learn = fold("doc_id", 4) != 2
    return fit_toxicity(docs, labels.filter(learn).select("doc_id", "toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
