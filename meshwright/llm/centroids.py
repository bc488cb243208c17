"""Clusters of quantised vectors: Lloyd's rounds over distinct vectors that carry their multiplicities."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm import common

#: A vector with more than one row in so many meets its cluster by a broadcast: there are fewer such vectors than this.
HEAVY = 1024


def quantised(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """vec_id and point (array<long>: floor of each component times scale) of the rows that have `size` components, all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col("embedding")
    kept = vectors.filter((F.size(v) == size) & F.forall(v, lambda x: finite(x.cast("double"))))
    return kept.select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("point"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k rows with the smallest sha256 of seed and id, in that order: k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.orderBy(name.asc_nulls_last(), "point").limit(k).select("point").collect()
    return np.array([r.point for r in rows], np.int64)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (the smaller number among equal ones) and its squared distance, in whole numbers."""
    largest = max(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (points, centroids))
    if 4 * largest * largest * points.shape[1] >= 1 << 63:
        raise OverflowError("squared distances go beyond 64 bits")
    gaps = np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)
    cluster = gaps.argmin(1)
    return cluster, gaps[np.arange(len(points)), cluster]


def _points(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _summing(centroids: np.ndarray):
    size = centroids.shape[1]

    def add(batches):
        """For each cluster the task's weighted sums: whole numbers, so that their order doesn't matter."""
        sums, weights = [[0] * size for _ in centroids], [0] * len(centroids)
        for batch in batches:
            points, weight = _points(batch, size), batch.column("weight").to_numpy()
            cluster, _ = _nearest(points, centroids)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                here = points[own].astype(object) if _wide(points, weight) else points[own]
                for d, s in enumerate((here * weight[own, None]).sum(0).tolist()):
                    sums[c][d] += s
                weights[c] += int(weight[own].sum())
        rows = [c for c, w in enumerate(weights) if w]
        columns = [pa.array(rows, pa.int32()), pa.array([[str(s) for s in sums[c]] for c in rows], pa.list_(pa.string())), pa.array([weights[c] for c in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "sums", "weight"])

    return add


def _wide(points: np.ndarray, weight: np.ndarray) -> bool:
    """Whether weighted sums may go beyond 64 bits, so that Python's numbers are needed."""
    return int(np.abs(points).max(initial=0)) * int(weight.sum()) >= 1 << 63


def _assigning(centroids: np.ndarray):
    def assign(batches):
        for batch in batches:
            cluster, distance = _nearest(_points(batch, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("point"), batch.column("weight"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["point", "weight", "cluster", "distance"]
            )

    return assign


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds over distinct(point, weight): each becomes the floor of its points' weighted mean.

    Each task sends one row for each cluster that it has points of, added up in decimals of 38 digits; the driver gets k rows a round.
    """
    for _ in range(rounds):
        parts = distinct.mapInArrow(_summing(centroids), "cluster int, sums array<string>, weight long")
        each = parts.select("cluster", "weight", F.posexplode("sums").alias("dim", "value"))
        totals = each.groupBy("cluster", "dim").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("total"), F.sum("weight").alias("weight"))
        for r in totals.collect():
            centroids[r.cluster, r.dim] = int(r.total) // r.weight
    return centroids


def _back(points: DataFrame, assigned: DataFrame, n: int) -> DataFrame:
    """points with the columns of assigned, by equal vectors; a vector that many rows share doesn't gather them in one task."""
    columns = [F.col(c) for c in points.columns] + [F.col(c) for c in assigned.columns if c not in ("point", "weight")]
    heavy = assigned.filter(F.col("weight") * HEAVY > n)  # fewer than HEAVY rows
    light = assigned.filter(F.col("weight") * HEAVY <= n)
    far = points.join(F.broadcast(heavy.select("point")), "point", "left_anti").join(light, "point").select(*columns)
    return far.unionByName(points.join(F.broadcast(heavy), "point").select(*columns))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: str = "1:") -> DataFrame:
    """Clusters of vectors(vec_id, embedding): floor(scale * x) of each component, Lloyd's rounds in whole numbers, one assignment more.

    One row for each kept row: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. The first centroids are
    the k kept rows with the smallest sha256 of seed and vec_id, of all rows if there are fewer; equal distances go to the smaller number, so a centroid
    that repeats an earlier one stays empty and as it is.

    Equal quantised vectors are grouped once, with their number, before they are shuffled; rounds run over distinct vectors. The assignment comes
    back by a join on the vector. The driver holds k centroids.

    Rows whose vector is null, has another number of components, or holds a null, NaN or infinite one take no part. A null vec_id is kept, and comes last
    among the first centroids; rows that repeat are each counted and returned. Components so large that distances don't fit 64 bits
    raise an OverflowError. Empty table: no rows. Other columns are ignored.
    """
    points = quantised(vectors, scale, size)
    schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    distinct = common.checkpoint(points.groupBy("point").agg(F.count("*").alias("weight")))
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))))
    centroids = lloyd(distinct, centroids, rounds)
    assigned = common.checkpoint(distinct.mapInArrow(_assigning(centroids), "point array<long>, weight long, cluster int, distance long"))
    inertia = {r.cluster: (r.inertia, r.weight) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("weight")).alias("inertia"), F.sum("weight").alias("weight")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster: Column = F.col("cluster") + 1
    joined = _back(points, assigned, sum(w for _, w in inertia.values()))
    return joined.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*(F.lit(inertia.get(c, (0, 0))[0]).cast("long") for c in range(len(sha)))), by_cluster).alias("cluster_inertia"),
        F.lit(sum(i for i, _ in inertia.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, sha)), by_cluster).alias("centroid_sha256"),
    )
