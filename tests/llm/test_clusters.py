import hashlib

import numpy as np
import pytest

from panelwright.llm import clusters

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8, rounds=10, dims=64):
    """Lloyd's rounds in Python integers, every distance computed."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[near(v)[1]].append(v)
        at = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, at, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in last if c == j) for j in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for i, d, c in last), key=repr)


def made(rng, n, dims, spread):
    heart = rng.normal(0, 1, (5, dims))
    return [(k, [float(np.float32(x)) for x in heart[k % 5] + rng.normal(0, spread, dims)]) for k in range(n)]


def result(df, **more):
    return sorted((tuple(r) for r in clusters.cluster(df, **more).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_result_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(clusters, "BLOCK", 17)
    rows = made(np.random.default_rng(3), 160, 64, spread)
    rows += [(k, rows[0][1]) for k in range(500, 580)]  # a third of all vectors are alike
    rows += [(900, None), (901, rows[1][1][:63]), (902, [None, *rows[1][1][1:]]), (903, [float("nan"), *rows[1][1][1:]]), (904, [float("inf"), *rows[1][1][1:]])]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


@pytest.mark.parametrize("size", [3, 1000, 1 << 26])
def test_bounds_never_pass_the_exact_distance(size):
    rng = np.random.default_rng(8)
    points = rng.integers(-size, size + 1, (300, 64))
    points[100:150] = points[:50]
    points[150:160] = 0
    pivots, centroids = points[[0, 7, 20, 155]], points[[0, 3, 100, 155, 299]]
    near = np.stack([np.sqrt(clusters.squared(points, p).astype(np.float64)) for p in pivots], axis=1)
    low = clusters.Bounds(pivots, centroids).squared(near)
    exact = np.stack([clusters.squared(points, c) for c in centroids], axis=1)
    assert all(int(np.ceil(a)) <= b for a, b in zip(low.ravel().tolist(), exact.ravel().tolist(), strict=True))
    cluster, best, checked = clusters.nearest(points, near, centroids, clusters.Bounds(pivots, centroids))
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and checked <= exact.size


def test_bounds_prune():
    rng = np.random.default_rng(1)
    vectors = np.array([np.floor(1024 * np.array(v)).astype(np.int64) for _, v in made(rng, 1000, 64, 0.05)])
    centroids = vectors[:5]
    near = np.stack([np.sqrt(clusters.squared(vectors, p).astype(np.float64)) for p in centroids], axis=1)
    assert clusters.nearest(vectors, near, centroids, clusters.Bounds(centroids, centroids))[2] < 1.5 * len(vectors)


def test_edges(spark):
    two = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [3.0, 1.0]), (7, [-2.0, 0.1])]
    df = spark.createDataFrame(two, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as near", "4 as cluster", "5 as n")
    assert result(df, dims=2) == brute(two, dims=2)
    assert result(df, dims=2, k=2, rounds=3) == brute(two, k=2, rounds=3, dims=2)
    assert result(df) == [] and clusters.cluster(df).columns == clusters.cluster(df, dims=2).columns
    with pytest.raises(Exception, match="don't fit a long"):
        clusters.cluster(spark.createDataFrame([(1, [1e9, 0.0])], SCHEMA), dims=2).collect()
