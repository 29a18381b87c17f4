"""Nearest neighbours by inner product: a forest of random-projection trees.

Equal vectors are one point of the index; a point keeps the k + 1 smallest ids of
its vectors, which is all that an answer can hold.  One more coordinate gives all
points the same length, so a large inner product is a small distance.  A tree
splits by the direction between two drawn points, at the median.

The trees are fitted on a bounded sample (``sample_rows`` points with the
smallest hashes), each in a task of its own; every point is then sorted into a
leaf of every tree.  A query has one priority queue for all trees: it goes down
the branch it belongs to and leaves the other one in the queue with the distance
to the split, until ``search_leaves`` leaves are collected, and all others
at the distance of the last.  As a leaf leaves the queue at the largest distance on its
way, the queues of some queries at a time are arrays of these distances.  The points of
the collected leaves are ranked by the exact inner product of the given vectors, in doubles.

Leaves meet queries in buckets of about ``BUCKET_POINTS`` points, many points or
queries a row.  With a query goes a floor, a score that k + 1 points of its leaves are
known to reach: of the points that the trees were fitted on, those with the best scores
are looked up in the leaves.  Products in single precision tell which points may reach
it, only their scores are made in doubles.  The floor decides about work only, never
about what is found; without one a bucket finds its own.  Each bucket hands on at most a
query's k + 1 best, so a query has at most as many lists as buckets or leaves.  At every
cut scores are exact and ties go to the smaller id; scores of a leaf are made for some
visitors at a time.

How many leaves a query needs depends on the data: on points without structure
it is a share of all leaves.  So it is measured (``leaves_needed``): ``PROBES``
asking points are compared with all points, and the leaves collected are raised
from ``search_leaves`` until ``recall`` of their true neighbours are among them, up
to all leaves.  ``sample_rows`` bounds the number of leaves, not what is read: on
larger tables leaves hold more points.

Defined cases: vectors that are null, zero, of another than the most frequent
width (the larger at ties) or hold a null or non-finite number take no part, nor
do rows without an id; rows equal in id and vector are one; a query never finds
rows of its own id; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


#: Points of leaves that meet their queries in one bucket.
BUCKET_POINTS = 50_000
#: Pairs that a bucket holds before it keeps each query's best.
PAIRS = 400_000
#: Numbers in a block of scores.
SCORES = 4_000_000
#: Queries whose queues are made at a time; that are sent in one row; that meet a bucket's leaves at a time.
QUEUES, SENT, VISITORS = 32, 2_048, 20_000
#: Asking points whose true neighbours are looked up to choose the number of leaves.
PROBES = 128


@dataclass(frozen=True)
class Tree:
    """Inner nodes; a child below zero is leaf -child - 1, counted over the whole forest."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray


def grow(points: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    draw = np.random.default_rng(seed)
    normals, cuts, children, leaves = [], [], [], 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        if len(rows) <= leaf_rows:
            me = -leaves - 1
            leaves += 1
        else:
            me = len(normals)
            a, b = draw.choice(rows, 2, replace=False)
            normal = points[a] - points[b]
            normal = normal / max(float(np.linalg.norm(normal)), 1e-30)
            along = points[rows] @ normal
            cut = float(np.median(along))
            right = along >= cut
            if right.all() or not right.any():
                right = np.arange(len(rows)) % 2 == 1
            normals.append(normal)
            cuts.append(cut)
            children.append([0, 0])
            todo += [(rows[~right], me, 0), (rows[right], me, 1)]
        if parent >= 0:
            children[parent][side] = me
    width = points.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, width), np.array(cuts, np.float32), np.array(children, np.int32).reshape(-1, 2))


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point, all points one level down at a time."""
    node = np.full(len(points), 0 if len(tree.cuts) else -1)
    while (inner := np.flatnonzero(node >= 0)).size:
        at = node[inner]
        right = np.einsum("ij,ij->i", points[inner], tree.normals[at]) >= tree.cuts[at]
        node[inner] = tree.children[at, right.astype(int)]
    return -node - 1


def distances(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Of each leaf (row) the distance at which the queue of each point (column) hands it on."""
    found = np.zeros((len(tree.cuts) + 1, len(points)), np.float32)
    side = tree.normals @ points.T - tree.cuts[:, None]
    nodes, held = np.zeros(min(len(side), 1), int), np.zeros((min(len(side), 1), len(points)), np.float32)
    while nodes.size:
        at, below = side[nodes], tree.children[nodes].T.ravel()
        both = np.empty((2, *held.shape), np.float32)
        # only the child that a point does not belong to is further away
        np.maximum(held, at, out=both[0])
        np.maximum(held, np.negative(at, out=at), out=both[1])
        held, leaf = both.reshape(len(below), -1), below < 0
        if leaf.all():
            found[-below - 1] = held
            break
        if leaf.any():
            found[-below[leaf] - 1] = held[leaf]
            below, held = below[~leaf], held[~leaf]
        nodes = below
    return found


def queues(forest: list[Tree], points: np.ndarray) -> np.ndarray:
    """Of each point (row) the distances of the leaves of all trees, by place."""
    ends = np.cumsum([len(tree.cuts) + 1 for tree in forest])
    far = np.empty((len(points), ends[-1]), np.float32)
    for tree, part in zip(forest, np.split(far, ends[:-1], axis=1)):
        part[:] = distances(tree, points).T
    return far


def places_of(forest: list[Tree], points: np.ndarray) -> np.ndarray:
    """The places of each point (column) in all trees (rows); leaves are counted over the whole forest."""
    start = np.cumsum([0] + [len(tree.cuts) + 1 for tree in forest])
    return np.stack([leaves_of(tree, points) + low for tree, low in zip(forest, start)])


def homes(forest: list[Tree], buckets: int) -> np.ndarray:
    """The bucket of each place; leaves that are near one another go to different ones."""
    return np.concatenate([(np.arange(len(tree.cuts) + 1) * 31 + t * 17) % buckets for t, tree in enumerate(forest)])


def usable(vector: Column) -> Column:
    """Finite numbers only, not all zero; null where the vector is."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & F.exists(vector, lambda x: x != 0)


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """uid, vector and the ``keep`` smallest ids of each distinct vector; ranks are limited in the tasks already."""
    order = Window.partitionBy("vector").orderBy("id")
    rows = rows.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep)
    points = rows.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return materialize(points.withColumn("uid", F.monotonically_increasing_id()), "points")


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def packed(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers of all rows of a binary column."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def lengths(x: np.ndarray) -> np.ndarray:
    """In doubles, whatever the size of the numbers; 1 for zero."""
    largest = np.abs(x).max(axis=1, initial=0).astype(np.float64)
    largest[largest == 0] = 1
    return largest * np.maximum(np.sqrt(((x / largest[:, None]) ** 2).sum(axis=1)), 1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in single precision, and the lengths."""
    length = lengths(x)
    return (x / length[:, None]).astype(np.float32), length


def raised(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """One more coordinate: what is missing to the greatest length; 0 for queries."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)


def best_pairs(kept: list[tuple], uid: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, member, exact score) the ``most`` best of each query, each point once; ties go to the smaller first id."""
    asker, member, score = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((uid[member], first[member], -score, asker))
    asker, member, score = asker[order], member[order], score[order]
    once = np.ones(len(asker), bool)
    once[1:] = (asker[1:] != asker[:-1]) | (uid[member[1:]] != uid[member[:-1]])
    asker, member, score = asker[once], member[once], score[once]
    best = np.arange(len(asker)) - np.searchsorted(asker, asker) < most
    return asker[best], member[best], score[best]


def best_of_leaf(q: np.ndarray, ways: tuple, x: np.ndarray, longest: float, who: np.ndarray, members: slice, floor: np.ndarray, most: int):
    """Of a leaf the members that reach their visitors' floors, some visitors at a time; at least the ``most`` best if that is many.

    The products are made in single precision, of vectors of length one at most (``ways``: the ``directions`` of q).
    So all members within a margin of the floor or the last place are scored one by one.
    """
    leaf = (x[members] / longest).astype(np.float32)
    size, step = len(leaf), max(1, SCORES // len(leaf))
    # twice the largest error of a product
    margin = (x.shape[1] + 8) * 2.0**-23
    for low in range(0, len(who), step):
        part = who[low:low + step]
        scores = ways[0][part] @ leaf.T
        least = floor[part] / ways[1][part] / longest - margin
        reach = np.flatnonzero(scores >= least.astype(np.float32)[:, None])
        if size > most and len(reach) > most * len(part):
            last = np.partition(scores, size - most, axis=1)[:, size - most]
            reach = np.flatnonzero(scores >= np.maximum(least, last - margin).astype(np.float32)[:, None])
        asker, member = part[reach // size], members.start + reach % size
        exact = exact_scores(q, x, asker, member)
        fine = exact >= floor[asker]
        yield asker[fine], member[fine], exact[fine]


def exact_scores(q: np.ndarray, x: np.ndarray, asker: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Inner products row by row, which do not depend on the other rows."""
    step = max(1, SCORES // (8 * x.shape[1]))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[asker[i:i + step]].astype(np.float64, copy=False), x[member[i:i + step]].astype(
        np.float64, copy=False)) for i in range(0, len(asker), step))])


def known_floor(q: np.ndarray, near: np.ndarray, sample: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """A score that ``most`` points of each query's leaves (``near``, by place) reach, by some points whose places are known; without them -inf."""
    some = min(4 * most, len(sample))
    if some < most:
        return np.full(len(q), -np.inf)
    way, length = directions(q)
    scores = way @ sample.T
    top = np.argpartition(scores, len(sample) - some, axis=1)[:, len(sample) - some:]
    found = exact_scores(q, sample, np.repeat(np.arange(len(q)), some), top.ravel()).reshape(top.shape)
    # the sample has single precision
    found -= 2.0**-23 * length[:, None] * lengths(sample[top.ravel()]).reshape(top.shape)
    inside = near[np.arange(len(q))[:, None, None], places.T[top]].any(axis=2)
    found[~(inside & np.isfinite(found))] = -np.inf
    return np.partition(found, some - most, axis=1)[:, some - most]


def fit_forest(points: DataFrame, longest: float, trees: int, leaf_rows: int, sample_rows: int, seed: int) -> tuple[list[Tree], np.ndarray, np.ndarray]:
    """The trees, and the points of the sample with their places."""
    total = points.count()
    sample = points.select("vector").orderBy(F.xxhash64("vector")).limit(sample_rows).toArrow().column(0)
    x = raised(matrix(sample.combine_chunks()), longest)
    leaf = max(8, leaf_rows * len(x) // max(total, 1))
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast(x)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tree = grow(sent.value, leaf, seed + t)
                yield pa.RecordBatch.from_arrays([pa.array([t]), *(pa.array([a.tobytes()], pa.binary()) for a in (
                    tree.normals, tree.cuts, tree.children, leaves_of(tree, sent.value).astype(np.int32)))], ["tree", "normals", "cuts", "children", "leaves"])

    rows = spark.range(trees).repartition(trees, "id").mapInArrow(
        grown, "tree long, normals binary, cuts binary, children binary, leaves binary").collect()
    rows = sorted(rows, key=lambda r: r["tree"])
    forest = [Tree(np.frombuffer(r["normals"], np.float32).reshape(-1, x.shape[1]), np.frombuffer(r["cuts"], np.float32),
                   np.frombuffer(r["children"], np.int32).reshape(-1, 2)) for r in rows]
    start = np.cumsum([0] + [len(tree.cuts) + 1 for tree in forest]).astype(np.int32)
    return forest, np.ascontiguousarray(x[:, :-1]), np.stack([np.frombuffer(r["leaves"], np.int32) + low for r, low in zip(rows, start)])


def true_neighbours(points: DataFrame, probes: np.ndarray, most: int) -> list:
    """Of each probe the ``most`` best points of the whole table, compared block by block; every task hands on its best."""
    sent = points.sparkSession.sparkContext.broadcast(probes)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, q.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            scores = q @ x.T
            top = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            new = (np.take_along_axis(scores, top, 1), batch.column(0).to_numpy()[top], batch.column(2).to_numpy()[top], x[top])
            best = tuple(np.concatenate(pair, axis=1) for pair in zip(best, new))
            top = np.argsort(-best[0], axis=1, kind="stable")[:, :most]
            best = tuple(np.take_along_axis(b, top if b.ndim == 2 else top[:, :, None], 1) for b in best)
        for i in range(len(q)):
            score, uid, copies, x = (b[i] for b in best)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(uid), pa.int32()), pa.array(uid), pa.array(copies, pa.int32()), pa.array(score),
                                              pa.array([v.tobytes() for v in x], pa.binary())], ["probe", "uid", "copies", "score", "vector"])

    found = points.select("uid", "vector", F.size("ids").alias("copies")).mapInArrow(
        compared, "probe int, uid long, copies int, score double, vector binary")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "uid")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).orderBy("probe", "nth").collect()


def leaves_needed(points: DataFrame, asking: DataFrame, forest: list[Tree], longest: float, k: int, recall: float) -> int:
    """The least number of leaves that finds ``recall`` of the true neighbours of ``PROBES`` asking points."""
    # drawn by another hash than the points that the trees are fitted on
    chosen = asking.select("uid", "vector").orderBy(F.xxhash64("vector", F.lit("probe")), "uid").limit(PROBES).toArrow()
    if not chosen.num_rows:
        return 0
    x, uid = matrix(chosen.column("vector").combine_chunks()), chosen.column("uid").to_numpy()
    rows = true_neighbours(points, x, k + 1)
    high = raised(x, longest, query=True)
    others = raised(np.stack([np.frombuffer(r["vector"], np.float64) for r in rows]), longest)
    at, far = places_of(forest, others), queues(forest, high)
    probe = np.array([r["probe"] for r in rows])
    places, weights = [], []
    for i in range(len(x)):
        mine = np.flatnonzero(probe == i)
        nearest_leaf = far[i][at[:, mine]].min(axis=0)
        places.append(np.searchsorted(np.sort(far[i]), nearest_leaf, "right"))
        # equal vectors are one point and several answers, the asking id is none
        copies = np.array([rows[j]["copies"] - (rows[j]["uid"] == uid[i]) for j in mine])
        weights.append(np.minimum(copies, np.maximum(k - (np.cumsum(copies) - copies), 0)))
    place, weight = np.concatenate(places), np.concatenate(weights)
    order = np.argsort(place)
    found = np.cumsum(weight[order])
    return int(place[order][np.searchsorted(found, recall * found[-1])]) if found[-1] else 0


def candidates(points: DataFrame, asking: DataFrame, forest: list[Tree], sample: np.ndarray, places: np.ndarray, longest: float,
               search_leaves: int, most: int) -> DataFrame:
    """query, uid, first id and score: of each bucket the ``most`` best points for each query, of those that may be among all its best.

    A point comes once from every bucket that it was found in.
    """
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast((forest, sample, places))
    buckets = -(-points.count() * len(forest) // BUCKET_POINTS)
    types = dict(points.dtypes)
    id_type = types["ids"].removeprefix("array<").removesuffix(">")
    kind = np.float32 if types["vector"] == "array<float>" else np.float64

    def row(bucket: int, **columns) -> pa.RecordBatch:
        columns = {k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else v for k, v in columns.items()}
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *columns.values()], ["bucket", *columns])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value[0]
        home = homes(forest, buckets)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, uid = matrix(batch.column(1)), batch.column(0).to_numpy()
            place = places_of(forest, raised(x, longest)).astype(np.int32).ravel()
            order = np.argsort(home[place], kind="stable")
            names, first = np.unique(home[place[order]], return_index=True)
            for bucket, here in zip(names, np.split(order, first[1:])):
                at = here % len(x)
                ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(2).take(pa.array(at)))
                yield row(bucket, places=place[here], uids=uid[at], first=ids, vectors=x[at].astype(kind))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sample, places = sent.value
        home = homes(forest, buckets)
        # each bucket's places fill whole bytes, with one that is never near
        by_home = [np.flatnonzero(home == b) for b in range(buckets)]
        slots = np.concatenate([np.append(p, [len(home)] * (-len(p) % 8)) for p in by_home]).astype(int)
        ends = np.cumsum([-(-len(p) // 8) for p in by_home])[:-1]
        taken = min(search_leaves, len(home)) - 1
        for batch in (b.slice(low, SENT) for b in batches for low in range(0, b.num_rows, SENT)):
            q, uid = matrix(batch.column(1)), batch.column(0).to_numpy()
            floor, bits = [], []
            for i in range(0, len(q), QUEUES):
                some = q[i:i + QUEUES]
                far = queues(forest, raised(some, longest, query=True))
                near = np.zeros((len(some), len(home) + 1), bool)
                # numbers beyond single precision have no distance; their leaves are near
                near[:, :-1] = ~(far > np.partition(far, taken, axis=1)[:, taken, None])
                floor.append(known_floor(some, near, sample, places, most))
                bits.append(np.packbits(np.take(near, slots, axis=1), axis=1))
            floor = np.concatenate(floor)
            for bucket, leaves in enumerate(np.split(np.concatenate(bits), ends, axis=1)):
                who = np.flatnonzero(leaves.any(axis=1))
                if len(who):
                    yield row(bucket, uids=uid[who], vectors=q[who].astype(kind), floor=floor[who], leaves=leaves[who])

    def ranked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "uid", "first", "score"]
        none = pa.table([pa.array([], pa.int64())] * 2 + [left.column("first").combine_chunks().flatten().slice(0, 0), pa.array([], pa.float64())], names)
        if not left.num_rows or not right.num_rows:
            return none
        place = packed(left, "places", np.int32)
        order = np.argsort(place, kind="stable")
        place, uid = place[order], packed(left, "uids", np.int64)[order]
        x = packed(left, "vectors", kind).reshape(len(order), -1)[order]
        ids = left.column("first").combine_chunks().flatten().take(pa.array(order))
        # places of ids in their order stand for them
        order_of = np.empty(len(ids), np.int64)
        order_of[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        values = ids.to_numpy(zero_copy_only=False)
        if values.dtype.kind in "iuf":
            order_of = np.unique(values, return_inverse=True)[1]
        here, first = np.unique(place, return_index=True)
        longest = np.maximum.reduceat(lengths(x), first)
        ends = np.append(first[1:], len(place))
        # bits of a query stand for the places of this bucket in their order
        bit = np.searchsorted(np.flatnonzero(homes(sent.value[0], buckets) == key[0].as_py()), here)
        asks = packed(right, "uids", np.int64)
        floors, vectors = packed(right, "floor", np.float64), packed(right, "vectors", kind).reshape(len(asks), -1)
        leaves = packed(right, "leaves", np.uint8).reshape(len(asks), -1)
        answers = [none]
        for start in range(0, len(asks), VISITORS):
            some = slice(start, start + VISITORS)
            q, floor = vectors[some].astype(np.float64), floors[some].copy()
            near = np.ascontiguousarray(np.unpackbits(leaves[some], axis=1)[:, bit].T)
            ways, kept, held = directions(q), [], 0
            for i, (low, high) in enumerate(zip(first, ends)):
                who = np.flatnonzero(near[i])
                for found in best_of_leaf(q, ways, x, longest[i], who, slice(low, high), floor, most):
                    kept.append(found)
                    held += len(found[0])
                    if held > PAIRS:
                        kept = [best_pairs(kept, uid, order_of, most)]
                        asker, _, score = kept[0]
                        held = len(asker)
                        # the last of a full list is a floor
                        full = (np.arange(held) - np.searchsorted(asker, asker) == most - 1) & np.isfinite(score)
                        floor[asker[full]] = np.maximum(floor[asker[full]], score[full])
            if kept:
                asker, member, score = best_pairs(kept, uid, order_of, most)
                answers.append(pa.table([asks[some][asker], uid[member], ids.take(pa.array(member)), score], names))
        return pa.concat_tables(answers)

    index = points.select("uid", "vector", F.col("ids")[0].alias("first")).mapInArrow(
        indexed, f"bucket int, places binary, uids binary, first array<{id_type}>, vectors binary")
    visits = asking.select("uid", "vector").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid").mapInArrow(
        visited, "bucket int, uids binary, vectors binary, floor binary, leaves binary")
    return index.groupBy("bucket").cogroup(visits.groupBy("bucket")).applyInArrow(ranked, f"query long, uid long, first {id_type}, score double")


def nearest(table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 12,
            leaf_rows: int = 64, search_leaves: int = 900, sample_rows: int = 65_536, seed: int = 7,
            recall: float = 0.95) -> DataFrame:
    """query_id, rank, id and score; ``queries`` says which rows of the table ask, ``search_leaves`` is the least number of leaves."""
    spark = table.sparkSession
    rows = table.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(vector).alias("vector"), queries.alias("asks"))
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.filter(F.size("vector") == (widths[0] if widths else 0))
    points = distinct_points(rows.select("id", "vector"), k + 1)
    schema = f"query_id {dict(rows.dtypes)['id']}, rank int, id {dict(rows.dtypes)['id']}, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = float(points.agg(F.sqrt(F.max(square))).first()[0])
    fitted = fit_forest(points, longest, trees, leaf_rows, sample_rows, seed)
    asked = materialize(rows.filter("asks").select(F.col("id").alias("query_id"), "vector").distinct()
                        .join(points.select("vector", "uid"), "vector").select("query_id", "uid"), "asked")
    asking = points.join(asked.select("uid").distinct(), "uid", "left_semi")
    if search_leaves < sum(len(tree.cuts) + 1 for tree in fitted[0]):
        search_leaves = max(search_leaves, leaves_needed(points, asking, fitted[0], longest, k, recall))
    found = candidates(points, asking, *fitted, longest, search_leaves, k + 1)
    # a point may come from several buckets; ranks are limited before the ids are looked up
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "uid")
    found = found.repartition("query").distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    found = found.select("query", "uid", "score").join(points.select("uid", "ids"), "uid")
    each = found.select("query", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    each = each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    answer = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("answer"))
    rows = asked.join(answer, F.col("uid") == F.col("query"))
    others = F.slice(F.filter("answer", lambda a: a["id"] != F.col("query_id")), 1, k)
    rows = rows.select("query_id", F.posexplode(others).alias("pos", "a"))
    return rows.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("a.id").alias("id"), F.col("a.score").alias("score"))
