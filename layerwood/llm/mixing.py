"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in an order shuffled by checksum.
A copy of it (first pass, second pass, ...) finishes at the virtual time at
which its source, served at the rate of its target, has sent all words up to the
end of that copy.  All copies are sorted by finish time, over all sources, and
taken until the budget is reached.

The budget is the sum of all sizes.  A source's target is its weighted share,
at most ``max_epochs`` times its size; what it cannot take is shared out again by
weight.  Both cuts are running sums over range-partitioned rows: each task sums
its own range, one sum per range gives the ranges their offsets.  No task sees
more than a range, whatever a source or a document id holds.

Defined cases: null texts have no words and are never taken; null sources are a
source of their own, the last one; copies of equal rows (id, source, size) are
interchangeable, so reruns agree on the rows as a bag; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text import WORDS


def running_sums(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of value over all rows up to and with this one, in the given order.

    The ranges are written once, so that sums and rows come from the same ranges.
    A row number makes equal keys separable, so no key can overfill a range.
    """
    schema = rows.schema.simpleString()[len("struct<"):-1]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_nth"]
    ranged = rows.withColumn("_nth", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_nth")
    at = rows.columns.index(value)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            run = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)) + total
            total = int(run[-1]) if len(run) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(run), pa.array(np.full(len(run), part, np.int32))],
                [*batch.schema.names, name, "_range"])

    held = materialize(ranged.mapInArrow(sums, f"{schema}, {name} long, _range int"), "ranges")
    # one row per range: as many as shuffle partitions
    totals = held.groupBy("_range").agg(F.max(name).alias("_total"))
    offset = F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select("_range", offset.alias("_offset")))
    return held.join(offsets, "_range").withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Per source: rank by code point (null last), source_size and target.

    Works on one row per source.  Sources fill up in the order of size / weight;
    the first that does not, and all behind it, share what is left by weight; the
    level is highest there.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", rank)
    rows = rows.withColumns({"weight": F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")),
                             "most": (F.col("source_size") * max_epochs).cast("double")})
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(behind))
    full = F.col("most") / F.col("weight") <= F.col("level")
    rows = rows.withColumn("open_level", F.max(F.when(~full, F.col("level"))).over(Window.partitionBy()))
    return rows.select("source", "rank", "source_size",
                       F.when(full, F.col("most")).otherwise(F.col("weight") * F.col("open_level")).alias("target"))


def fair_queue_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                   weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every row."""
    sizes = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes, "sizes")
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets")
    # one row per source; adaptive execution splits a frequent one, or broadcasts if small
    rows = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = rows.withColumn("shuffled", shuffled)
    queue = running_sums(rows, ["rank", "shuffled", "size"], "size", "served")
    # the sums run over all sources: take off what earlier sources hold
    earlier = F.sum("source_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    firsts = targets.select(F.col("rank").alias("_rank"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    queue = materialize(queue.join(firsts, F.col("rank") == F.col("_rank"))
                        .withColumn("served", F.col("served") - F.col("_earlier")).drop("_rank", "_earlier"), "queue")
    passes = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    copies = queue.filter("size > 0").select(
        F.explode(passes).alias("pass"), "rank", "served", "size",
        "source_size", "target")
    finish = (F.col("pass") * F.col("source_size") + F.col("served")) / F.col("target")
    copies = copies.select(finish.alias("finish"), "rank", "pass", "served", "size")
    line = running_sums(copies, ["finish", "rank", "pass", "served"], "size", "sent")
    # two rows reach the driver: the budget, and the first copy that no longer fits
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    place = F.struct("finish", "rank", "pass", "served")
    end = line.filter(F.col("sent") > budget).agg(F.min(place)).first()[0]
    # taken copies of a row: the passes that finish before that one
    rows = queue

    def taken(e: int) -> Column:
        finish = (F.lit(e) * F.col("source_size") + F.col("served")) / F.col("target")
        here = F.struct(finish.alias("finish"), F.col("rank").alias("rank"), F.lit(e).alias("pass"), F.col("served").alias("served"))
        bound = F.struct(*[F.lit(v).alias(n) for n, v in end.asDict().items()]) if end else None
        return F.lit(1) if bound is None else (here < bound).cast("int")

    before = [taken(e) for e in range(max_epochs)]
    copies_of = F.when(F.col("size") > 0, sum(before[1:], before[0])).otherwise(0)
    rows = rows.withColumn("copies", copies_of)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies",
                       (F.col("size") * F.col("copies")).alias("taken"))
