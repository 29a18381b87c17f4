"""The corpus pipeline over ``documents``, and all queries of the llm subpackage.

toxicity, near duplicates, repeated passages, benchmark passages, mix.  Every
stage is written as Parquet and read again as the documents of the next one.

Defined cases are those of the operators.  Columns other than those of
``documents`` are dropped by the first stage; rows that repeat an id and text are
one document after the second; missing columns of ``documents`` are an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwood.llm.catalog import ORACLES as _ORACLES
from layerwood.llm.catalog import QUERIES as _QUERIES
from layerwood.llm.contamination import decontaminate, small
from layerwood.llm.jaccard import jaccard_join
from layerwood.llm.mixing import fair_queue_mix
from layerwood.llm.queries_classify import TOXIC, toxicity_model
from layerwood.llm.queries_contamination import contaminated
from layerwood.llm.repeats import remove_repeats
from layerwood.llm.toxicity import toxicity_score
from layerwood.session import materialize

#: Passages of over 50 words go: in the given texts 51 words take 232 bytes or more in 99 of 100 places of the language
#: with the shortest words.  The query of the operator itself takes 400 bytes.
PASSAGE_BYTES = 224
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    docs = docs.select(COLUMNS)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_score", toxicity_score(model, F.col("text"))).filter(F.col("_score") < TOXIC).select(COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id (and content hash); the rest is kept as it is."""
    docs = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("content")).alias("_row"))
    classes = materialize(jaccard_join(docs, key="_row"), "classes")
    stay = classes.filter(F.col("class_id").eqNullSafe(F.col("_row"))).groupBy("_row").agg((F.count("*") > 1).alias("again"))
    # joined by parts, as a null id is no missing key
    stay = materialize(stay.select(F.col("_row.doc_id").alias("_id"), F.col("_row.content").alias("_content"), "again"), "stay")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_row.content") == F.col("_content"))
    once = docs.join(small(stay.filter("NOT again")), same, "left_semi").select(COLUMNS)
    # rows that repeat one another are few; only they are shuffled
    again = docs.join(small(stay.filter("again")), same, "left_semi").dropDuplicates(["_row"]).select(COLUMNS)
    return once.unionByName(again)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of PASSAGE_BYTES or more; a document of which nothing is left goes.

    A character cut in two by the removal goes as well.
    """
    rows = remove_repeats(docs.select(COLUMNS), length=PASSAGE_BYTES)
    kept = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("�"), F.lit("")))
    # told by the spans, as a filter on kept runs its Python a second time, in workers of its own
    left = F.col("n_bytes") - F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = rows.filter(F.col("spans").isNull() | (left > 0))
    rows = rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(whole))
    return rows.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(
        F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves."""
    rows = decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.filter(~contaminated()).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with the number of copies and words."""
    return fair_queue_mix(docs.select(COLUMNS)).filter("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeats),
    ("benchmark_passages", without_benchmark),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Learned scores and similarity classes are beyond SQL; tests hold the stages against brute force and planted cases.
ORACLE_SQL = None

QUERIES = {**_QUERIES, "pipeline": run}
ORACLES = dict(_ORACLES)
