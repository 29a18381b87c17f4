"""Where intermediate tables go, and how many tasks a stage should have."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/layerwood-intermediate").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage by writing a parquet table to the shared folder.

    Unlike a cached or locally checkpointed frame the table survives lost
    executors, and later scans prune columns.
    """
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is run meanwhile sends Python workers at most so many rows at once: whole texts fill both sides' memory otherwise."""
    before = spark.conf.get(ARROW_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def _stored(spark: SparkSession, path: str):
    """A path and its file system, in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    there, store = _stored(spark, path)
    return store.exists(there)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    there, store = _stored(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(there)) if store.exists(there) else []


def remove(spark: SparkSession, path: str) -> None:
    there, store = _stored(spark, path)
    store.delete(there, True)


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialize``; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        base = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        # only folders right below the shared one are ours
        if path.getParent().toUri().getPath() == base.toUri().getPath():
            remove(spark, folder)


def bytes_read(df: DataFrame) -> int:
    """Size of the sources under a frame, from their statistics; runs nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small table over all cores.

    A source with fewer splits than cores would leave cores idle.  Only sources
    below cores x split size are moved, so the shuffle is bounded; a larger one
    has enough splits and is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if bytes_read(df) >= cores * split:
        return df
    return df.repartition(cores, *keys)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
