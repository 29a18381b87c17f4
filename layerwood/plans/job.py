"""The whole job: a delimited file to a trained cascade and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForestConfig
from ..operators.sampling import choose_blocks, random_blocks, train_test_split
from ..session import new_path
from ..sources.delimited import load_delimited
from ..sources.tables import read_blocks, write_blocks, write_table
from .cascade import CascadeModel, fit_block_cascade


def prepare_blocks(spark: SparkSession, dataset: str, path: str, features_path: str, blocks: int, train_share: float,
                   seed: int, blocks_path: str, tables_path: str | None = None) -> DataFrame:
    """Write the training rows of a delimited file as ``blocks`` random-sample blocks; return the test rows.

    With ``tables_path`` the full training and test tables are written there as well,
    and the blocks and the test rows come from them.
    """
    rows = load_delimited(spark, dataset, path, features_path)
    rows = train_test_split(rows, train_share, seed, "instance")
    sides = {"train": rows.filter("is_train").drop("is_train"), "test": rows.filter("not is_train").drop("is_train")}
    if tables_path:
        for name, side in sides.items():
            write_table(side, f"{tables_path}/{name}")
            sides[name] = spark.read.parquet(f"{tables_path}/{name}")
    write_blocks(random_blocks(sides["train"], blocks, seed + 1, "instance"), blocks_path)
    return sides["test"]


def run_job(spark: SparkSession, dataset: str, path: str, features_path: str, config: ForestConfig, blocks: int,
            take: int, train_share: float = 0.7, seed: int = 7, blocks_path: str | None = None, tables_path: str | None = None) -> CascadeModel:
    """Load, split, write blocks, read ``take`` of them, train; ``history`` of the model is the report.

    Only the folders of the chosen blocks are read for training.
    """
    blocks_path = blocks_path or new_path(spark, "blocks")
    test = prepare_blocks(spark, dataset, path, features_path, blocks, train_share, seed, blocks_path, tables_path)
    train = read_blocks(spark, blocks_path, choose_blocks(blocks, take, seed + 2))
    return fit_block_cascade(train.select("instance", "block", "label", "features"), test, config)
