"""K-means on integer vectors with block-norm screening: exact distances only to centroids that a bound leaves.

A vector is cut into segments; the norms of its segments are stored with it. By Cauchy-Schwarz the squared distance of x
and c is at least the squared distance of their vectors of norms, which has one component for each segment. A centroid
whose bound exceeds the exact distance to another one cannot win. What passes the driver is the k centroids and, of each
round, k sums: nothing that grows with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import column, written
from lakequill.llm.integer_vectors import MOST_DIMS, matrix, scaled, usable

#: Components of a segment.
SEGMENT = 8
#: k * dims of all centroids: they travel in closures.
MOST_NUMBERS = 1 << 20


def segment_norms(vectors: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The Euclidean norms of each row's segments."""
    starts = np.arange(0, vectors.shape[1], segment)
    return np.sqrt(np.add.reduceat(np.square(vectors.astype(np.float64)), starts, axis=1))


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance) of each row, ties to the smaller number, and how many distances were computed.

    The centroid of the least bound gives a first exact distance; every other one whose bound does not exceed the best
    distance so far is compared exactly. Bounds are lowered by far more than their rounding error.
    """
    own, other = np.square(norms).sum(axis=1)[:, None], np.square(centroid_norms).sum(axis=1)[None, :]
    bounds = own + other - 2 * norms @ centroid_norms.T
    bounds -= 1e-9 * (own + other)
    cluster = bounds.argmin(axis=1)
    best = np.square(vectors - centroids[cluster]).sum(axis=1)
    seen, computed = cluster.copy(), len(vectors)
    for c in range(len(centroids)):
        open_ = np.flatnonzero((bounds[:, c] <= best) & (seen != c))
        if not len(open_):
            continue
        distance = np.square(vectors[open_] - centroids[c]).sum(axis=1)
        computed += len(open_)
        wins = (distance < best[open_]) | ((distance == best[open_]) & (c < cluster[open_]))
        best[open_[wins]], cluster[open_[wins]] = distance[wins], c
    return cluster, best, computed


def _norms(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in source:
        norms = segment_norms(matrix(got.column("ints")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1]), pa.array(norms.ravel()))
        yield pa.RecordBatch.from_arrays([*got.columns, lists], [*got.schema.names, "norms"])


def _assigned(centroids: np.ndarray, source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    centroid_norms = segment_norms(centroids)
    for got in source:
        if got.num_rows:
            vectors = matrix(got.column("ints"))
            yield got, vectors, *nearest(vectors, matrix(got.column("norms"), np.float64), centroids, centroid_norms)[:2]


def _sums(centroids: np.ndarray, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cluster that has vectors in this task: cluster, n, sums."""
    n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _, vectors, cluster, _ in _assigned(centroids, source):
        n += np.bincount(cluster, minlength=len(n))
        order = np.argsort(cluster, kind="stable")
        present, starts = np.unique(cluster[order], return_index=True)
        sums[present] += np.add.reduceat(vectors[order], starts, axis=0)
    full = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _labelled(centroids: np.ndarray, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got, _, cluster, distance in _assigned(centroids, source):
        yield pa.RecordBatch.from_arrays([got.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])


def moved(centroids: np.ndarray, table: DataFrame) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; an empty cluster's centroid stays."""
    dims = centroids.shape[1]
    partial_sums = table.mapInArrow(partial(_sums, centroids), "cluster int, n bigint, sums array<bigint>")
    whole = partial_sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dims))).alias("sums"))
    out = centroids.copy()
    for row in whole.collect():  # a row for each centroid
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def _hash(id_: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dims: int = 64, factor: int = 64, rounds: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector with exactly `dims` finite components.

    Components become floor(factor * x), cut to +-2**24. The first centroids are the k vectors whose ids have the smallest
    sha256 of '1:<id>', ties by components, null ids as ''. Each round assigns every vector to the nearest centroid
    (squared distance, ties to the smaller number) and moves every centroid that has vectors to the floor of their mean;
    a last assignment follows. Fewer vectors than k give fewer centroids, none an empty result. Rows with equal ids are
    rows of their own. Columns other than these two are not read. Sums beyond 64 bits are cut to the largest bigint.

    The integers and their norms are written once and read in each round; no vector is shuffled, so a cluster may hold any
    share of the rows.
    """
    if dims < 1 or dims > MOST_DIMS or k < 1 or k * dims > MOST_NUMBERS:
        raise ValueError(f"dims must be 1 to {MOST_DIMS}, k * dims at most {MOST_NUMBERS}")
    spark, vec = vectors.sparkSession, column(vectors, vec_col)
    kind = vectors.select(column(vectors, id_col).alias("id")).schema["id"].dataType.simpleString()
    ints = vectors.where((F.size(vec) == dims) & usable(vec)).select(column(vectors, id_col).alias("id"), scaled(vec, factor).alias("ints"))
    table = written(ints.mapInArrow(_norms, f"id {kind}, ints array<int>, norms array<double>"), "integer-vectors")
    first = [r["ints"] for r in table.orderBy(_hash(F.col("id")), "ints").limit(k).select("ints").collect()]  # k rows
    centroids = np.array(first, np.int64).reshape(len(first), dims)
    for _ in range(rounds if first else 0):
        centroids = moved(centroids, table)
    labels = written(table.mapInArrow(partial(_labelled, centroids), f"id {kind}, cluster int, distance bigint"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    held = lambda s: min(s, (1 << 63) - 1)
    rows = [(c, held(s), held(sum(sums.values())), centroids[c].tolist()) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return labels.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
