"""Centroid clustering on a VA-file: vectors on an integer grid, found again through few-bit cells.

Components become whole numbers (``floor(scale * x)``).  Every dimension is cut
into ``2**bits`` cells, and a vector's cells are packed into a few bytes that
stand beside it in one Parquet table, so a scan of the approximations reads these
bytes only.  For a centroid c a lookup table holds, per dimension and cell, the
least and the largest value of ``-2 * x * c``; their sums and ``|c|**2`` bound the
squared distance less ``|x|**2``, which is the same for all centroids.  A
centroid is out when its interval begins behind the end of another's.  Where one
centroid is left the vector is assigned by its cells alone.

* The first round needs all vectors for the sums and the last pass needs them for
  the distances, so both read cells and vectors side by side, without a join.
* The rounds between scan cells only.  Vectors are fetched, by row number, where
  intervals overlap or the centroid changed; sums are carried on by what came and
  what went.  A fetched list of at most ``send_bytes`` is broadcast, a longer one
  meets the vectors in a shuffle.

Sums, distances and means are exact whole numbers whatever ``bits`` is; cells are
fitted on at most ``sample_rows`` vectors (and the exact range of each dimension)
and decide only how much is fetched.  Each task sends one row of sums per centroid.

Defined cases: vectors that are null, of another length, or hold a null or a
component that is not finite are left out; rows that repeat are vectors of their
own; a null id is kept and starts no centroid before any other id; equal ids start
in the order of their components; with fewer vectors than centroids there are
fewer centroids, with none the result is empty; whole numbers of 2**27 or more are
an error, as distances would not fit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize
from .text import in_bytes

#: Whole numbers below this give distances that fit 64 bits; below the second, all sums are exact in doubles.
MOST, MOST_DOUBLE = 1 << 27, 1 << 22
#: Vectors looked at together in a task.
ROWS = 4_096


@dataclass(frozen=True)
class Clustering:
    """One row per vector (key, ``cluster``, ``distance``), the final centroids, and the vectors fetched in each middle round."""

    rows: DataFrame
    centroids: np.ndarray
    fetched: list[int]


@dataclass(frozen=True)
class Cells:
    """First whole number of each cell but the lowest, and the range of every cell, by dimension."""

    bits: int
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed cells of vectors, one row of bytes each."""
        cells = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            cells[:, d] = np.searchsorted(self.edges[d], x[:, d], "right")
        spread = cells[:, :, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8) & np.uint8(1)
        return np.packbits(spread.reshape(len(x), -1), axis=1)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        n, dims = len(packed), len(self.edges)
        spread = np.unpackbits(packed, axis=1, count=dims * self.bits).reshape(n, dims, self.bits)
        return spread @ (1 << np.arange(self.bits - 1, -1, -1)).astype(np.uint8)


def fit_cells(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> Cells:
    """Cells of about equal shares of a sample; the outermost reach to the exact ends of the data."""
    count = 1 << bits
    ranks = np.quantile(sample, np.arange(1, count) / count, axis=0, method="nearest").T if len(sample) else np.zeros((len(low), count - 1))
    edges = np.ascontiguousarray(np.maximum(ranks.astype(np.int64), low[:, None]))
    first = np.concatenate([low[:, None], edges], axis=1)
    last = np.concatenate([edges - 1, high[:, None]], axis=1)
    # an empty cell (two equal edges) bounds nothing, it must only not be upside down
    return Cells(bits, edges, first, np.maximum(first, last))


def bounds(cells: Cells, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables by (dimension, cell, centroid): least and largest part of the distance less |x|**2."""
    ends = [-2 * e[:, :, None] * centroids.T[:, None, :] for e in (cells.low, cells.high)]
    return np.minimum(*ends), np.maximum(*ends)


def candidates(packed: np.ndarray, cells: Cells, centroids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which centroids the intervals leave, as (vector, centroid) booleans."""
    at = cells.decode(packed)
    squares = (centroids ** 2).sum(axis=1)
    low, high = (np.broadcast_to(squares, (len(at), len(centroids))).copy() for _ in range(2))
    for d in range(at.shape[1]):
        low += tables[0][d][at[:, d]]
        high += tables[1][d][at[:, d]]
    return low <= high.min(axis=1, keepdims=True)


def distances(x: np.ndarray, centroids: np.ndarray, exact: type) -> np.ndarray:
    """Squared distances, without rounding in the number type ``exact``."""
    x, c = x.astype(exact), centroids.astype(exact)
    return ((x ** 2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c ** 2).sum(axis=1)).astype(np.int64)


def settle(x: np.ndarray, left: np.ndarray, centroids: np.ndarray, exact: type) -> np.ndarray:
    """The nearest of the centroids that are left; vectors are read only where there are several."""
    out = left.argmax(axis=1)
    open_ = np.flatnonzero(left.sum(axis=1) > 1)
    if len(open_):
        far = distances(x[open_], centroids, exact)
        far[~left[open_]] = np.iinfo(np.int64).max
        out[open_] = far.argmin(axis=1)
    return out


def binary_rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as a byte matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]].reshape(len(column), width)


def binary_column(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def gridded(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are kept, and their whole numbers as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok &= sizes == dims
    place = np.flatnonzero(ok)
    if not len(place):
        return place, np.zeros((0, dims))
    kept = column.take(pa.array(place)).flatten().cast(pa.float64())
    x = kept.to_numpy(zero_copy_only=False).reshape(len(place), dims)  # a null becomes NaN
    fine = np.isfinite(x).all(axis=1)
    return place[fine], np.floor(scale * x[fine])


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def value_ranges(df: DataFrame, dims: int, scale: float) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors are kept, and the exact least and largest whole number of each dimension."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = 0, np.full(dims, np.inf), np.full(dims, -np.inf)
        for batch in parts(batches):
            _, x = gridded(batch.column(0), dims, scale)
            if len(x):
                count, low, high = count + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, count)), pa.array(low), pa.array(high)], ["dim", "n", "low", "high"])

    ranges = df.mapInArrow(ranged, "dim long, n long, low double, high double").groupBy("dim").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    if not ranges:
        return 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    low, high = (np.array([r[c] for r in ranges]) for c in ("low", "high"))
    if max(-low.min(), high.max()) >= MOST:
        raise ValueError(f"whole numbers from {low.min()} to {high.max()}: distances would not fit 64 bits")
    return ranges[0]["n"], low.astype(np.int64), high.astype(np.int64)


def write_file(df: DataFrame, key: str, dims: int, scale: float, cells: Cells) -> DataFrame:
    """The VA-file: row number, key, packed cells and the vector (32-bit numbers) of each kept row."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            place, x = gridded(batch.column(1), dims, scale)
            x = x.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), binary_column(cells.encode(x)), binary_column(x.astype(np.int32))],
                                             [key, "cells", "vector"])

    kept = df.mapInArrow(coded, f"`{key}` {df.schema[key].dataType.simpleString()}, cells binary, vector binary")
    return materialize(kept.withColumn("row", F.monotonically_increasing_id()), "va-file")


def start_centroids(file: DataFrame, key: str, dims: int, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:key``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    # equal ids are told apart by their components, as numbers
    first = file.withColumn("_order", F.coalesce(order, F.lit("~")))
    last = first.select("_order").orderBy("_order").limit(count).agg(F.max("_order")).first()[0]
    below = first.filter(F.col("_order") < last).select("_order", "vector").collect()
    # the last hash may stand in any number of rows: of its vectors, counted by content, the smallest
    tied = first.filter(F.col("_order") == last).groupBy("_order", "vector").agg(F.count("*").alias("n"))
    tied = tied.withColumn("n", F.least("n", F.lit(count))).orderBy(sort_key(dims)).limit(count).collect()
    rows = [(r["_order"], np.frombuffer(r["vector"], np.int32).tolist()) for r in below]
    rows += [(r["_order"], np.frombuffer(r["vector"], np.int32).tolist()) for r in tied for _ in range(r["n"])]
    return np.array([v for _, v in sorted(rows)[:count]], np.int64).reshape(-1, dims)


def sort_key(dims: int):
    """32-bit little-endian numbers of a binary column in an order that sorts like the numbers."""

    @F.pandas_udf("binary")
    def ordered(vectors):
        return vectors.map(lambda v: (np.frombuffer(v, np.int32).astype(np.int64) + (1 << 31)).astype(">u4").tobytes())

    return ordered("vector")


#: Rows of a round: vectors have a row number, sums of a task have none.
STATE = "row long, cells binary, cluster int, sums binary, n long"


def state_batch(rows, cells, clusters) -> pa.RecordBatch:
    n = len(clusters)
    return pa.RecordBatch.from_arrays([rows, cells, pa.array(clusters.astype(np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())],
                                      ["row", "cells", "cluster", "sums", "n"])


def sums_batch(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    k = len(sums)
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), binary_column(sums), pa.array(counts)],
                                      ["row", "cells", "cluster", "sums", "n"])


def add_to(sums: np.ndarray, counts: np.ndarray, clusters: np.ndarray, x: np.ndarray, sign: int) -> None:
    for c in np.unique(clusters):
        inside = clusters == c
        sums[c] += sign * x[inside].sum(axis=0)
        counts[c] += sign * int(inside.sum())


def total_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the tasks sent, added by centroid in Spark; ``k * dims`` numbers come to the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            part = binary_rows(batch.column(1), 8 * dims).copy().view(np.int64)
            np.add.at(sums, at := batch.column(0).to_numpy(), part)
            np.add.at(counts, at, batch.column(2).to_numpy())
        for c in range(k):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, c)), pa.array(np.arange(dims)), pa.array(sums[c]), pa.array(np.full(dims, counts[c]))],
                                             ["cluster", "dim", "total", "n"])

    sent = state.filter(F.col("row").isNull()).select("cluster", "sums", "n")
    rows = sent.mapInArrow(added, "cluster long, dim long, total long, n long").groupBy("cluster", "dim").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in rows:
        sums[r["cluster"], r["dim"]], counts[r["cluster"]] = r["total"], r["n"]
    return sums, counts


def scan_all(cells: Cells, centroids: np.ndarray, exact: type, emit: Callable) -> Callable:
    """Assign vectors that are read beside their cells."""
    tables = bounds(cells, centroids)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in parts(batches):
            packed = batch.column(1)
            left = candidates(binary_rows(packed, (cells.bits * centroids.shape[1] + 7) // 8), cells, centroids, tables)
            x = binary_rows(batch.column(2), 4 * centroids.shape[1]).copy().view(np.int32).astype(np.int64)
            clusters = settle(x, left, centroids, exact)
            add_to(sums, counts, clusters, x, 1)
            yield emit(batch.column(0), packed, clusters, x)
        if emit is state_rows:
            yield sums_batch(sums, counts)

    return scanned


def state_rows(rows, cells, clusters, x) -> pa.RecordBatch:
    return state_batch(rows, cells, clusters)


def middle_round(file: DataFrame, state: DataFrame, cells: Cells, centroids: np.ndarray, exact: type, send_bytes: int) -> tuple[DataFrame, int]:
    """Assign by cells alone; fetch vectors where intervals overlap or the centroid changed."""
    tables, (k, dims) = bounds(cells, centroids), centroids.shape
    width = (k + 7) // 8

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            left = candidates(binary_rows(batch.column(1), (cells.bits * dims + 7) // 8), cells, centroids, tables)
            old = batch.column(2).to_numpy()
            loud = (left.sum(axis=1) > 1) | (left.argmax(axis=1) != old)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), binary_column(np.packbits(left, axis=1)), pa.array(loud)],
                                             ["row", "cells", "cluster", "left", "loud"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in parts(batches):
            x = binary_rows(batch.column(4), 4 * dims).copy().view(np.int32).astype(np.int64)
            left = np.unpackbits(binary_rows(batch.column(3), width), axis=1, count=k).astype(bool)
            old, new = batch.column(2).to_numpy(), settle(x, left, centroids, exact)
            moved = np.flatnonzero(old != new)
            add_to(sums, counts, old[moved], x[moved], -1)
            add_to(sums, counts, new[moved], x[moved], 1)
            yield state_batch(batch.column(0), batch.column(1), new)
        yield sums_batch(sums, counts)

    rows = state.filter(F.col("row").isNotNull()).select("row", "cells", "cluster")
    marks = materialize(rows.mapInArrow(marked, "row long, cells binary, cluster int, left binary, loud boolean"), "va-marks")
    loud = marks.filter("loud").select("row", "cells", "cluster", "left")
    count = loud.count()
    found = file.select("row", "vector").join(in_bytes(loud, count, 64 + (cells.bits * dims + 7) // 8 + width, send_bytes), "row")
    found = found.select("row", "cells", "cluster", "left", "vector").mapInArrow(fetched, STATE)
    quiet = marks.filter("NOT loud").select("row", "cells", "cluster", F.lit(None).cast("binary").alias("sums"), F.lit(None).cast("long").alias("n"))
    new = materialize(quiet.unionByName(found), "va-state")
    discard(marks)
    return new, count


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 64.0, clusters: int = 16,
                    rounds: int = 3, seed: int = 1, bits: int = 6, sample_rows: int = 4_096, send_bytes: int = 64 << 20) -> Clustering:
    """Lloyd's rounds on whole numbers: nearest centroid (ties: the smaller number), then componentwise floor of the mean."""
    if not 1 <= bits <= 8:
        raise ValueError("bits from 1 to 8")
    spark, narrow = df.sparkSession, df.select(key, vector)
    count, low, high = value_ranges(narrow.select(vector), dims, scale)
    none = f"`{key}` {df.schema[key].dataType.simpleString()}, cluster int, distance long"
    if not count:
        return Clustering(spark.createDataFrame([], none), np.zeros((0, dims), np.int64), [])
    exact = np.float64 if max(-low.min(), high.max()) < MOST_DOUBLE else np.int64
    # about four times the sample passes, and what is above sample_rows is cut
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(vector)), F.lit(1 << 40))
    sample = narrow.filter(chance < int(min(1.0, 4 * sample_rows / count) * (1 << 40))).limit(sample_rows).select(vector).toArrow().column(0)
    cells = fit_cells(gridded(sample, dims, scale)[1].astype(np.int64), low, high, bits)
    file = write_file(narrow, key, dims, scale, cells)
    centroids = start_centroids(file, key, dims, clusters, seed)
    fetched: list[int] = []
    state, sums, counts = None, np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        before = state
        if state is None:
            state = materialize(file.select("row", "cells", "vector").mapInArrow(scan_all(cells, centroids, exact, state_rows), STATE), "va-state")
        else:
            state, loud = middle_round(file, state, cells, centroids, exact, send_bytes)
            fetched.append(loud)
            discard(before)
        come, more = total_sums(state, len(centroids), dims)
        sums, counts = sums + come, counts + more
        # numpy's // is the floor, also below zero
        centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)

    def measured(ids, packed, found, x) -> pa.RecordBatch:
        each = np.empty(len(x), np.int64)
        for c in np.unique(found):
            each[found == c] = distances(x[found == c], centroids[c:c + 1], exact)[:, 0]
        return pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(each)], [key, "cluster", "distance"])

    rows = materialize(file.select(key, "cells", "vector").mapInArrow(scan_all(cells, centroids, exact, measured), none), "clusters")
    if state is not None:
        discard(state)
    discard(file)
    return Clustering(rows, centroids, fetched)


def with_inertia(spark: SparkSession, found: Clustering) -> DataFrame:
    """Distances added by cluster and over all, and the checksum of each final centroid; one broadcast row per centroid."""
    by = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    each = spark.createDataFrame([(c, by.get(c, 0), sum(by.values()), sha[c]) for c in range(len(sha))],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(each), "cluster")
