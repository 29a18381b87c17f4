"""Centroid clustering: the VA-file against plain arithmetic, and its defined cases."""

import hashlib
import math

import numpy as np
import pytest

from layerwood.llm.centroids import Cells, bounds, candidates, cluster_vectors, distances, fit_cells, with_inertia

ROWS = "vec_id long, embedding array<float>, label int, cluster string, row long, cells int"


def slow_clusters(rows, dims, scale, k, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in order[:k]]

    def assigned():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        found = assigned()
        for c in range(len(centroids)):
            inside = [v for (_, v), (at, _) in zip(kept, found) if at == c]
            if inside:
                centroids[c] = [sum(col) // len(inside) for col in zip(*inside)]
    return sorted(((i is None, i), *f) for (i, _), f in zip(kept, assigned())), centroids


def vectors(n, dims, seed, steps=8):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.integers(-steps, steps, dims) / 8]) for i in range(n)]


ODD = [(500, None), (501, [0.5] * 3), (502, [None, 0.5, 0.5, 0.5]), (503, [float("nan")] * 4), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, []),
       (3, [0.25] * 4), (3, [0.25] * 4), (3, [-0.25] * 4), (None, [0.1] * 4), (None, [0.1] * 4), (506, [0.0] * 4), (507, [-0.001] * 4)]


@pytest.mark.parametrize("bits, send", [(1, 0), (3, 1 << 20), (6, 0), (8, 1 << 20)])
def test_clusters_equal_plain_arithmetic(spark, bits, send):
    rows = vectors(120, 4, 3) + ODD
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], ROWS).repartition(5)
    found = cluster_vectors(df, dims=4, clusters=5, rounds=3, bits=bits, send_bytes=send)
    want, centroids = slow_clusters(rows, 4, 64, 5, 3)
    got = sorted(((r["vec_id"] is None, r["vec_id"]), r["cluster"], r["distance"]) for r in found.rows.collect())
    assert got == want and found.centroids.tolist() == centroids
    assert len(found.fetched) == 2


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-3.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cluster_vectors(df, dims=2)
    assert len(found.centroids) == 3
    want, _ = slow_clusters(rows, 2, 64, 16, 3)
    assert sorted(((False, r["vec_id"]), r["cluster"], r["distance"]) for r in found.rows.collect()) == want
    none = with_inertia(spark, cluster_vectors(df.limit(0), dims=2))
    assert none.count() == 0 and none.columns[:3] == ["cluster", "vec_id", "distance"]


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).integers(-2**19, 2**19, (40, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((False, r["vec_id"]), r["cluster"], r["distance"]) for r in cluster_vectors(df, dims=3, clusters=4).rows.collect())
    assert got == slow_clusters(rows, 3, 64, 4, 3)[0]
    with pytest.raises(ValueError, match="64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [1e9, 0.0, 0.0])], df.schema), dims=3)


@pytest.mark.parametrize("bits", [1, 2, 4, 7])
def test_intervals_hold_the_distance(bits):
    rng = np.random.default_rng(bits)
    x, c = rng.integers(-40, 40, (300, 6)), rng.integers(-40, 40, (7, 6))
    cells = fit_cells(x[:50], x.min(axis=0), x.max(axis=0), bits)
    assert (cells.decode(cells.encode(x)) < 1 << bits).all()
    left = candidates(cells.encode(x), cells, c, bounds(cells, c))
    far = distances(x, c, np.int64)
    # every nearest centroid is left, ties included
    assert left[far == far.min(axis=1, keepdims=True)].all()


def test_cells_of_equal_numbers():
    x = np.zeros((10, 2), np.int64)
    cells = fit_cells(x, x.min(axis=0), x.max(axis=0), 3)
    assert isinstance(cells, Cells) and candidates(cells.encode(x), cells, x[:2], bounds(cells, x[:2])).all()
