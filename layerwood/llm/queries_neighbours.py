"""op7: the 20 nearest vectors of every twentieth id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neighbours import nearest


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")
