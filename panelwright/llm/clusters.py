"""Integer centroid clustering whose assignments are pruned by Ptolemy's inequality over fixed pivot pairs.

For a vector x, a centroid c and pivots p and s, d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|. The
distances of every vector to the pivots are stored; those of the few centroids are computed anew in each round. Pivots
are the starting centroids, then, once they have moved for some rounds, the centroids of that time: near a pivot a bound
is almost the distance. The
largest bound over all pivot pairs is rounded down by more than the arithmetic can err, and a centroid is left out only
if its bound is above a distance already known exactly; all others are checked exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm.shared import stored, type_of

#: Pivots, the first different centroids; every two of them make a pair.
PIVOTS = 8
#: The round before which the pivots are fixed anew.
ANEW = 2
#: Relative slack of a bound; each of its few roundings errs by 2 ** -52 at most.
SLACK = 2.0**-44
#: Components below this leave squared distances of up to 64 components within a long.
LIMIT = 1 << 27
BLOCK = 8192


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 vectors to a point."""
    away = vectors - point
    return np.einsum("ij,ij->i", away, away)


class Bounds:
    """Lower bounds of squared distances to `centroids`, from distances to `pivots`."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray) -> None:
        between = np.stack([np.sqrt(squared(pivots, p).astype(np.float64)) for p in pivots])
        self.pairs = [(p, s, between[p, s]) for p in range(len(pivots)) for s in range(p) if between[p, s] > 0]
        self.to = np.stack([np.sqrt(squared(centroids, p).astype(np.float64)) for p in pivots])

    def squared(self, near: np.ndarray) -> np.ndarray:
        """For each row of distances to the pivots and each centroid; never above the exact value."""
        out = np.zeros((len(near), self.to.shape[1]))
        for p, s, apart in self.pairs:
            a, b = near[:, p, None] * self.to[s], near[:, s, None] * self.to[p]
            np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / (apart * (1 + SLACK)), out=out)
        return out * out * (1 - SLACK)


def nearest(vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller of equal ones), its squared distance, how many were computed exactly."""
    low = bounds.squared(near)
    first = low.argmin(axis=1)
    best, cluster = np.empty(len(vectors), np.int64), first.astype(np.int32)
    checked = len(vectors)
    for c, point in enumerate(centroids):
        own = np.flatnonzero(first == c)
        best[own] = squared(vectors[own], point)
    for c, point in enumerate(centroids):
        left = np.flatnonzero((first != c) & (low[:, c] <= best * (1 + SLACK)))
        exact = squared(vectors[left], point)
        closer = (exact < best[left]) | ((exact == best[left]) & (c < cluster[left]))
        best[left[closer]], cluster[left[closer]] = exact[closer], c
        checked += len(left)
    return cluster, best, checked


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), BLOCK):
            yield batch.slice(k, BLOCK)


def _cached(pivots: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            vectors = _matrix(batch.column(1), pivots.shape[1], np.int64)
            near = np.stack([np.sqrt(squared(vectors, p).astype(np.float64)) for p in pivots], axis=1)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], names)

    return run


def _assigned(pivots: np.ndarray, centroids: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(pivots, centroids)
        for batch in _blocks(batches):
            cluster, best, _ = nearest(_matrix(batch.column(1), centroids.shape[1], np.int64), _matrix(batch.column(2), len(pivots), np.float64), centroids, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(best)], names)

    return run


def _summed(pivots: np.ndarray, centroids: np.ndarray):
    """What one task's vectors add to each centroid: their number and the sum of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(pivots, centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in _blocks(batches):
            vectors = _matrix(batch.column(1), centroids.shape[1], np.int64)
            cluster, _, _ = nearest(vectors, _matrix(batch.column(2), len(pivots), np.float64), centroids, bounds)
            count += np.bincount(cluster, minlength=len(centroids))
            for c in range(len(centroids)):
                total[c] += vectors[cluster == c].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.arange(len(centroids), dtype=np.int32)), "n": pa.array(count), "total": pa.array(total.tolist(), pa.list_(pa.int64()))})

    return run


def integers(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v: floor(scale * x) of each vector of `dims` components, none null or not finite; the others are left out."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.when((F.size(v) == dims) & finite, F.transform(v, lambda x: F.floor(x * scale))).alias("v")).filter("v is not null")
    small = F.forall("v", lambda x: F.abs(x) < LIMIT)
    safe = F.when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more, squared distances don't fit a long")))
    return rows.select("id", safe.alias("v"))


def _pivoted(rows: DataFrame, centroids: np.ndarray, kind: str) -> tuple[np.ndarray, DataFrame]:
    """The different ones of `centroids` as pivots, and the vectors stored with their distances to them."""
    pivots = np.array(list(dict.fromkeys(map(tuple, centroids.tolist())))[:PIVOTS], np.int64)
    return pivots, stored(rows.select("id", "v").mapInArrow(T.tidied(_cached(pivots, ["id", "v", "near"])), f"id {kind}, v array<int>, near array<double>"), "vectors")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept by `integers`.

    Centroids start as the k vectors whose ids have the smallest SHA-256 of salt + id (null ids last; equal ids by their
    components). A round assigns each vector to its nearest centroid, equal ones to the smaller number, and replaces each
    centroid that has vectors by floor(sum / count) of their components, exactly; others stay. After the last round all are
    assigned once more. Fewer than k vectors make fewer centroids, none no rows; repeated rows count each; other columns
    are not read. Components of 2 ** 27 and more raise an error, as distances would not fit a long.

    A task adds up its own vectors, so k x dims sums a task are exchanged, however many vectors a cluster has; the driver
    holds k centroids. Vectors and their pivot distances are stored twice and read in every round.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, dims, scale, id_col, vector_col)
    start = rows.orderBy(F.col("id").isNull(), F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), "v").limit(k).collect()
    kind = type_of(vectors, id_col)
    if not start:
        return rows.selectExpr(f"id as `{id_col}`", "0 as cluster", *(f"0L as {c}" for c in ("distance", "cluster_inertia", "inertia")), "'' as centroid_sha256").limit(0)
    centroids = np.array([r.v for r in start], np.int64)
    cached = rows
    for r in range(rounds):
        if r in (0, ANEW):
            pivots, cached = _pivoted(cached, centroids, kind)
        sums = cached.mapInArrow(_summed(pivots, centroids), "cluster int, n long, total array<long>")
        each = sums.filter("n > 0").select("cluster", "n", F.posexplode("total").alias("at", "value"))
        for x in each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            centroids[x["cluster"], x["at"]] = int(x["value"]) // x["n"]
    if not rounds:
        pivots, cached = _pivoted(cached, centroids, kind)
    done = stored(cached.mapInArrow(_assigned(pivots, centroids, ["id", "cluster", "distance"]), f"id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    known = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return done.join(known, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
