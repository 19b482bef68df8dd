"""Clusters of integer vectors around exact integer centroids, each vector's centroid found by the threshold
algorithm.

For every dimension the centroids are listed in order of their value there. A vector walks all lists
outward from its own value, one centroid a step and list; a centroid met for the first time has its
distance computed. What the lists have reached last, squared and summed, is the least distance that a
centroid not yet met can have: the walk stops when that sum strictly exceeds the best distance found, so
ties are seen too and the smaller number wins. Whole Arrow batches walk at once.

Components become integers floor(scale * x) and stay integers: sums and distances are exact, so neither
partitions nor retries change a result. Vectors are written once to the shared folder; a round sends k
sums per task and brings k centroids to the driver.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left
out, and so are those whose squared distances might not fit into a long (squared norm over
2^62 / (2 k + 2), for k = 8 beyond 524,000 in one component at scale 1024); repeated rows count each; a null
vec_id starts a centroid only when too few other vectors are left; fewer vectors than k give as many
centroids; no vectors give no rows; an inertia beyond a long is null; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

_FAR = np.iinfo(np.int64).max


class Lists:
    """The centroids and, for every dimension, their values in order."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)


def nearest(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of ``x``, and how many distances it took."""
    (n, dim), k = x.shape, len(lists.centroids)
    up = np.stack([np.searchsorted(lists.values[:, d], x[:, d]) for d in range(dim)], axis=1) if n else np.zeros((0, dim), np.int64)
    down = up - 1  # the next places above and below in every list
    dims = np.arange(dim)
    met = np.zeros((n, k), bool)
    who, least = np.full(n, k), np.full(n, _FAR)
    live = np.arange(n)
    while len(live):
        at, u, d = x[live], up[live], down[live]
        above = np.where(u < k, lists.values[np.minimum(u, k - 1), dims] - at, _FAR)
        below = np.where(d >= 0, at - lists.values[np.maximum(d, 0), dims], _FAR)
        lower = below <= above
        reached = np.minimum(above, below)
        step = lists.order[np.where(lower, d, np.minimum(u, k - 1)), dims]
        down[live], up[live] = d - lower, u + ~lower
        new = np.zeros((len(live), k), bool)
        new[np.arange(len(live))[:, None], step] = True
        new &= ~met[live]
        met[live] |= new
        for c in range(k):  # in order of number, so that a tie stays with the smaller one
            rows = live[new[:, c]]
            distance = ((x[rows] - lists.centroids[c]) ** 2).sum(axis=1)
            better = (distance < least[rows]) | (distance == least[rows]) & (c < who[rows])
            least[rows[better]], who[rows[better]] = distance[better], c
        live = live[((reached ** 2).sum(axis=1) <= least[live]) & ~met[live].all(axis=1)]
    return who, least, met.sum(axis=1)


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, dim: int, scale: int, k: int) -> DataFrame:
    """vec_id, v (array of int) of the vectors that are kept."""
    limit = 2.0 ** 62 / (2 * k + 2)

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        right = np.asarray(lists.is_valid()) & (lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim)
        kept = batch.filter(pa.array(right))
        flat = kept.column(1).flatten()
        whole = np.asarray(flat.is_valid()).reshape(-1, dim).all(axis=1)
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        with np.errstate(all="ignore"):
            x = np.floor(scale * x)
            good = whole & np.isfinite(x).all(axis=1) & ((x * x).sum(axis=1) <= limit)
        v = pa.array(x[good].astype(np.int32).ravel())
        return pa.record_batch([kept.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(np.arange(good.sum() + 1) * dim, pa.int32()), v)], ["vec_id", "v"])

    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    return common.map_arrow(rows, convert, T.StructType([common.field(rows, "vec_id"), T.StructField("v", T.ArrayType(T.IntegerType()))]))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose ids, behind the seed, have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select(mark.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floored means of their vectors; those without vectors stay."""
    k, dim = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total = Lists(centroids), np.zeros((k, dim + 1), np.int64)  # below 2^31 times the rows of a task
        for batch in batches:
            x = matrix(batch.column(0), dim)
            who, _, _ = nearest(x, lists)
            np.add.at(total, who, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        c, d = np.nonzero(total)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d])], ["c", "d", "s"])

    rows = vectors.select("v").mapInArrow(sums, "c int, d int, s long").groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {(r["c"], r["d"]): int(r["s"]) for r in rows}
    return [[total.get((c, d), 0) // n for d in range(dim)] if (n := total.get((c, dim))) else old for c, old in enumerate(centroids)]


def clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector kept, and the centroids after ``rounds`` rounds."""
    kept = common.written(integer_vectors(vectors, vec_id, vector, dim, scale, k), "vectors")
    centroids = first_centroids(kept, k, seed)
    schema = T.StructType([common.field(kept, "vec_id"), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = moved(kept, centroids)

    def assign(batch: pa.RecordBatch, lists: Lists) -> pa.RecordBatch:
        who, least, _ = nearest(matrix(batch.column(1), dim), lists)
        return pa.record_batch([batch.column(0), pa.array(who, pa.int32()), pa.array(least)], schema.names)

    return common.map_arrow(kept, assign, schema, lambda: Lists(centroids)), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    rows, centroids = clusters(vectors, **options)
    rows = common.written(rows, "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def long(x: int):
        return F.lit(x if x < 2 ** 63 else None).cast("long")
    own = F.array(*[long(sums.get(c, 0)) for c in range(len(centroids))]).cast("array<long>")
    digests = F.array(*[F.lit(centroid_digest(c)) for c in centroids]).cast("array<string>")
    return rows.select("vec_id", "cluster", "distance", F.get(own, "cluster").alias("cluster_inertia"), long(sum(sums.values())).alias("inertia"),
                       F.get(digests, "cluster").alias("centroid_sha256"))
