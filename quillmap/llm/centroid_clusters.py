"""Centroid clustering: Lloyd's rounds over whole numbers with block-norm screening.

A vector is compressed to the norms of its consecutive segments. By the Cauchy-Schwarz inequality, segment by segment,
``sum (norm_b(v) - norm_b(c)) ** 2`` is at most the squared distance of v and c. The centroid of the least bound gets its
exact distance first; of the others only those whose bound does not exceed the best distance get theirs, in whole numbers.

Shape of the plan
-----------------
1. Quantised vectors and the squares of their segment norms are written once to the shared folder; each round reads them.
2. A round is one pass: tasks send a sum and a count for each centroid, so k rows a task are shuffled and a cluster that
   holds a third of all rows costs no more than another. The driver gets k rows of sums and holds k centroids.
3. The last pass writes cluster and distance; inertias are sums of k rows, joined as a broadcast of k rows.

Edge cases: vectors that are null, of another length, or with a null or non-finite component are dropped. A vector with
numbers beyond ``vectors.limit`` stays as a row with null cluster, distance, inertia of its cluster and centroid digest, and
no round sees it. With fewer vectors than k there are as many centroids as vectors. Repeated ids are rows of their own; in
the choice of first centroids equal ids go by their numbers, null ids come last. Equal centroids: the smaller number takes
all. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.vectors import lists, matrix, quantised
from quillmap.plans.storage import keep
from quillmap.session import workers_see_package

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEGMENTS = 8
SALT = "3"


def segment_squares(rows: np.ndarray, segments: int) -> np.ndarray:
    """Squared norms of ``segments`` consecutive runs of components, as equal as the length allows."""
    starts = np.linspace(0, rows.shape[1], segments, endpoint=False).astype(np.int64)
    return np.add.reduceat(rows * rows, starts, axis=1)


def nearest(rows: np.ndarray, squares: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), squared distance, and how many exact distances that took."""
    own, theirs = np.sqrt(squares.astype(np.float64)), np.sqrt(segment_squares(centroids, squares.shape[1]).astype(np.float64))
    total = (own * own).sum(1)[:, None] + (theirs * theirs).sum(1)[None, :]
    bounds = total - 2 * own @ theirs.T - 1e-9 * (total + 1)  # never above the true bound, whatever rounding did
    cluster = bounds.argmin(1)
    gap = rows - centroids[cluster]
    best = (gap * gap).sum(1)
    exact = len(rows)
    first = cluster.copy()
    for k in range(len(centroids)):
        open_ = np.flatnonzero((bounds[:, k] <= best) & (first != k))
        gap = rows[open_] - centroids[k]
        found = (gap * gap).sum(1)
        exact += len(open_)
        nearer = (found < best[open_]) | ((found == best[open_]) & (k < cluster[open_]))
        cluster[open_[nearer]], best[open_[nearer]] = k, found[nearer]
    return cluster, best, exact


def _screened(segments: int, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                squares = segment_squares(matrix(batch.column("q"), dimensions), segments)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), lists(squares)], names=["vec_id", "q", "squares"])

    return run


def _assigned(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            rows = matrix(batch.column("q"), centroids.shape[1])
            cluster, best, _ = nearest(rows, matrix(batch.column("squares"), segments), centroids)
            yield batch, rows, cluster, best

    return run


def _sums(centroids: np.ndarray, segments: int):
    """Tasks' part of a round: count and sum of the vectors of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, rows, cluster, _ in _assigned(centroids, segments)(batches):
            counts += np.bincount(cluster, minlength=len(centroids))
            for k in range(len(centroids)):
                sums[k] += rows[cluster == k].sum(0)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists(sums[used])], names=["k", "n", "s"])

    return run


def _clusters(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, best in _assigned(centroids, segments)(batches):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(fit: DataFrame, clusters: int, salt: str = SALT) -> np.ndarray:
    """Vectors of the smallest hashes of salt and id."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.q for r in fit.select("q", by.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, segments: int = SEGMENTS) -> tuple[DataFrame, np.ndarray]:
    """Kept rows ``(vec_id, cluster, distance)`` and the final centroids."""
    spark = df.sparkSession
    workers_see_package(spark)
    rows = quantised(df.where(F.size(vec_col) == dimensions), id_col, vec_col)
    beyond = rows.where("q is null").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    fit = keep(rows.where("q is not null").mapInArrow(_screened(segments, dimensions), "vec_id long, q array<int>, squares array<long>"), "vectors")
    centroids = first_centroids(fit, clusters)
    if not len(centroids):
        return beyond, centroids.reshape(0, dimensions)
    for _ in range(rounds):
        sums = fit.select("q", "squares").mapInArrow(_sums(centroids, segments), "k long, n long, s array<long>")
        sums = sums.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dimensions)]).alias("s"))
        after = centroids.copy()
        for r in sums.collect():
            after[r.k] = np.array(r.s, np.int64) // r.n
        if (after == centroids).all():
            break
        centroids = after
    found = fit.mapInArrow(_clusters(centroids, segments), "vec_id long, cluster int, distance long")
    return keep(found.unionByName(beyond), "clusters"), centroids


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, segments: int = SEGMENTS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that stays."""
    found, centroids = cluster(df, id_col, vec_col, dimensions, clusters, rounds, segments)
    sums = {r.cluster: r.s for r in found.where("cluster is not null").groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    of = [(k, sums.get(k), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = df.sparkSession.createDataFrame(of, "k int, cluster_inertia long, centroid_sha256 string")
    total = sum(s or 0 for s in sums.values())
    joined = found.join(F.broadcast(known), F.col("cluster") == F.col("k"), "left")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total if total < 2**63 else None).cast("long").alias("inertia"), "centroid_sha256")
