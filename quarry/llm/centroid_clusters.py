"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm.

Every dimension keeps its centroids sorted by value. A vector walks each list outward from its own value, one step in
every dimension at a time. A centroid met for the first time gets its exact distance; the squared gaps at the
frontier add up to a lower bound for every centroid not met yet. A vector stops when that bound strictly exceeds its best
distance, so a tie still open is never lost and the smaller number wins. The walk is vectorised over an Arrow batch.

A round reads the staged vectors in place and sends one partial sum per task, cluster and dimension. Only the centroids
(`clusters` x `dimensions` integers) and their sums come to the driver.

Cases: a vector of another length, or with a null or non-finite component, is left out; a null vec_id hashes as null and
comes last among the starting vectors; equal hashes (repeated ids) are ordered by their components, and repeated rows
are vectors of their own; fewer vectors than clusters start fewer clusters; an empty table gives an empty result.
Components whose integer lies beyond +-2^27 count as that bound, so that a squared distance fits a long; a sum of
distances beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import prepare, stage

BOUND = 1 << 27


@dataclass(frozen=True)
class ClusterSettings:
    clusters: int = 8
    dimensions: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


def integer_vectors(df: DataFrame, s: ClusterSettings, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>) of the vectors that are kept."""
    x = F.col(f"`{embedding}`")
    # infinity and not-a-number leave no finite difference with themselves
    finite = F.forall(x, lambda c: c.isNotNull() & (c.cast("double") - c.cast("double") == 0.0))
    kept = df.where((F.size(x) == s.dimensions) & finite)
    whole = lambda c: F.least(F.greatest(F.floor(c.cast("double") * s.scale), F.lit(-BOUND)), F.lit(BOUND)).cast("int")
    return kept.select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(x, whole).alias("v"))


def starting_centroids(vectors: DataFrame, s: ClusterSettings) -> np.ndarray:
    """The vectors with the smallest hashes, in ascending order of hash."""
    order = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(s.clusters)
    return np.array([r.v for r in first.collect()], np.int64).reshape(-1, s.dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row, by the threshold algorithm."""
    n, k = len(x), len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    above = np.stack([np.searchsorted(values[:, d], x[:, d]) for d in range(x.shape[1])], axis=1)
    below = above - 1
    best, distance = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    met = np.zeros((n, k), bool)
    rows, dims = np.arange(n), np.arange(x.shape[1])
    far = np.int64(BOUND) * 4
    for _ in range(k):
        if not len(rows):
            break
        v, lo, hi = x[rows], below[rows], above[rows]
        down = np.where(lo >= 0, v - values[np.maximum(lo, 0), dims], far)
        up = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - v, far)
        step_down = down <= up
        seen = order[np.where(step_down, lo, hi), dims]
        frontier = np.where(step_down, down, up)
        below[rows], above[rows] = lo - step_down, hi + ~step_down
        fresh = np.zeros((len(rows), k), bool)
        np.put_along_axis(fresh, seen, True, axis=1)
        fresh &= ~met[rows]
        met[rows] |= fresh
        at, c = np.nonzero(fresh)
        gap = v[at] - centroids[c]
        exact = np.full((len(rows), k), np.iinfo(np.int64).max)
        exact[at, c] = (gap * gap).sum(axis=1)
        near = exact.argmin(axis=1)
        d = exact[np.arange(len(rows)), near]
        better = (d < distance[rows]) | ((d == distance[rows]) & (near < best[rows]))
        best[rows] = np.where(better, near, best[rows])
        distance[rows] = np.where(better, d, distance[rows])
        rows = rows[(frontier * frontier).sum(axis=1) <= distance[rows]]
    return best, distance


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise exact floor(sum / count) of every cluster; an empty cluster keeps its centroid."""
    dims = centroids.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = _matrix(b["v"], dims)
            best, _ = nearest(x, centroids)
            np.add.at(total, best, x)
            count += np.bincount(best, minlength=len(centroids))
        held = np.nonzero(count)[0]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(held, dims), pa.int32()), "d": pa.array(np.tile(np.arange(dims), len(held)), pa.int32()),
            "total": pa.array(total[held].ravel(), pa.int64()), "n": pa.array(np.repeat(count[held], dims), pa.int64()),
        })

    parts = vectors.select("v").mapInArrow(partial, "cluster int, d int, total long, n long")
    sums = parts.groupBy("cluster", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster, r.d] = int(r.total) // r.n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance = nearest(_matrix(b["v"], dims), centroids)
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def cluster(df: DataFrame, s: ClusterSettings = ClusterSettings(), vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) after the last round, and the final centroids."""
    prepare(df.sparkSession, rows=4096)
    vectors = stage(integer_vectors(df, s, vec_id, embedding), "vectors")
    centroids = starting_centroids(vectors, s)
    if len(centroids):
        for _ in range(s.rounds):
            centroids = next_centroids(vectors, centroids)
    return stage(assigned(vectors, centroids), "assigned"), centroids


def clustered(df: DataFrame, s: ClusterSettings = ClusterSettings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Every vector with its cluster, the inertia of that cluster and of all, and the digest of its centroid."""
    rows, centroids = cluster(df, s, vec_id, embedding)
    long = lambda c: c.try_cast("long")
    total: Column = F.sum(F.col("distance").cast("decimal(38,0)"))
    per_cluster = rows.groupBy("cluster").agg(total.alias("t"))
    inertia = {r.cluster: r.t for r in per_cluster.collect()}
    digests = [(i, ",".join(map(str, c.tolist())), inertia.get(i), sum(inertia.values())) for i, c in enumerate(centroids)]
    schema = "cluster int, components string, t decimal(38,0), all_t decimal(38,0)"
    named = df.sparkSession.createDataFrame(digests, schema).select(
        "cluster", long(F.col("t")).alias("cluster_inertia"), long(F.col("all_t")).alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
