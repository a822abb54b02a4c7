"""Centroid clustering in whole numbers, nearest centroids by partial-distance search.

Squared differences are added up over the dimensions of highest variance first, a block of dimensions at a time. After each block
a centroid is given up for every vector where its sum is strictly above the best whole distance so far; what is left after all
dimensions is compared, ties going to the smaller number. The first candidate of a vector is the centroid that was nearest over
the first block. The order of dimensions and the first candidate change what is added up, never the result.

A round is one pass over a written table of whole-number vectors: each task adds up its own vectors by centroid, so what is
shuffled is a row a centroid and task, and the driver holds the centroids alone.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; components are held
within 2^27, beyond which squared distances of 64 dimensions would leave 64 bits; a null vec_id counts as an empty string in the
choice of first centroids; equal ids are told apart by their components; fewer vectors than centroids give fewer centroids; repeated
rows are rows each; sums of distances stop at the largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, collected, tidy

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"

#: Components beyond it are held there.
MOST = 1 << 27

#: Dimensions added up between comparisons.
BLOCK = 8

#: Vectors that a task compares at a time.
ROWS = 8_192


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row of x, and how many squared differences were added up.
    order: dimensions, those of highest variance first."""
    cols, c = np.ascontiguousarray(x.T[order]), centroids[:, order]
    n, dims = len(x), len(order)

    def summed(k: int, rows: np.ndarray | slice, lo: int, hi: int) -> np.ndarray:
        d = cols[lo:hi, rows] - c[k, lo:hi, None]
        return np.einsum("ij,ij->j", d, d)

    first = np.stack([summed(k, slice(None), 0, block) for k in range(len(c))])
    best_at = first.argmin(0)
    best = first[best_at, np.arange(n)]
    for k in range(len(c)):
        rows = np.flatnonzero(best_at == k)
        best[rows] += summed(k, rows, block, dims)
    started, work = best_at.copy(), n * (len(c) * min(block, dims) + max(0, dims - block))
    for k in range(len(c)):
        rows = np.flatnonzero((started != k) & (first[k] <= best))
        part = first[k, rows]
        for lo in range(block, dims, block):
            if not len(rows):
                break
            part = part + summed(k, rows, lo, min(lo + block, dims))
            work += len(rows) * (min(lo + block, dims) - lo)
            alive = part <= best[rows]
            rows, part = rows[alive], part[alive]
        better = (part < best[rows]) | (k < best_at[rows])
        rows, part = rows[better], part[better]
        best[rows], best_at[rows] = part, k
    return best_at, best, work


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, whole numbers floor(scale * component), of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform("v", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(float(scale)) * x))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.size("v") == dimensions)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~odd).select("vec_id", whole.alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, part.column(batch.schema.get_field_index("v")).flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def _sums(centroids: np.ndarray, order: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _matrices(batches, dims):
            at, _, _ = nearest(x, centroids, order)
            by = np.argsort(at, kind="stable")
            here, starts = np.unique(at[by], return_index=True)
            total[here] += np.add.reduceat(x[by], starts, axis=0)
            n += np.bincount(at, minlength=k)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, centroids.shape[1]):
            at, distance, _ = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _first(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """Vectors of the k smallest hashes of `seed:vec_id`, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([*collected(vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k))["v"]], np.int64)


def _by_variance(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions, those of highest variance first."""
    x = [F.col("v")[i].cast("double") for i in range(dimensions)]
    row = vectors.agg(*(F.var_pop(c).alias(f"x{i}") for i, c in enumerate(x))).first()
    return np.argsort([-(v or 0.0) for v in row], kind="stable")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of vectors (vec_id, embedding), and the centroids."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clusters")
    schema = "vec_id bigint, cluster int, distance bigint"
    whole = scratch.keep(whole_vectors(vectors, dimensions, scale))
    centroids = _first(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema), np.zeros((0, dimensions), np.int64)
    order = _by_variance(whole, dimensions)
    totals = [F.sum(F.col("total")[i]).alias(f"x{i}") for i in range(dimensions)]
    for _ in range(rounds):
        sums = whole.select("v").mapInArrow(_sums(centroids, order), "cluster bigint, n bigint, total array<bigint>")
        centroids = centroids.copy()
        for row in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # a row a centroid
            centroids[row[0]] = [x // row[1] for x in row[2:]]
    return scratch.keep(whole.mapInArrow(_assigned(centroids, order), schema)), centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    found, centroids = clustered(vectors, k, rounds, dimensions, scale, seed)
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row a centroid
    most = (1 << 63) - 1

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1) if values else F.lit(None)

    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = of_cluster([min(most, sums.get(i, 0)) for i in range(len(centroids))]).cast("long")
    whole = F.lit(min(most, sum(sums.values()))).cast("long")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), whole.alias("inertia"), of_cluster(hashes).cast("string").alias("centroid_sha256"))
