"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the edges (a, b).

    In each round every node hooks onto its smallest neighbour, chains are cut
    short by doubling, and the edges are carried over to the nodes that are left.
    Nodes with very many edges only meet in sums and in joins, which adaptive
    execution splits.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
                             .select("node", F.least("node", "root").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = materialize(parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "parents")
            parent = further.select("node", "root")
            if further.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialize(labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = {x: parent.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"}
        edges = edges.join(ends["a"], "a").join(ends["b"], "b").filter("a_root <> b_root")
        edges = materialize(edges.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
