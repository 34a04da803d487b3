"""Centroid clustering by sort-means, in exact integers.

Every round orders, for each centroid, all others by their distance from it. A vector starts at the centroid of its
previous assignment, at distance d, and scans the others in that order; it stops at the first that lies strictly beyond
2d from its start, since by the triangle inequality no centroid from there on is nearer than d. Equal distances go to the
smaller number, so a centroid at exactly 2d is still looked at.

A round is one pass over the vectors without a shuffle: each task scans its batches in numpy and writes vectors with
their assignment to the shared folder, from where the next round goes on, whatever executor is lost. New centroids are sums
by cluster with map-side aggregation, k rows whatever the table holds; only k centroids go to the tasks and back to the driver.

Defined results: rows without a vector of exactly dims finite entries are left out; rows that repeat an id are vectors
of their own; a null id counts as the empty text in the hash that picks the first centroids; of rows with one
hash the smaller vector comes first; with fewer than k vectors each is a centroid; an empty table gives an empty
result; further columns are not read. Entries whose scaled floor is beyond what squares in a long allow end the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, store, stored
from attestor.llm.vectors import scaled, whole


def entry_limit(dims: int) -> int:
    """Entries below it have squared distances of less than 2**60, so four times one of them is still a long."""
    return 1 << ((60 - max(1, dims - 1).bit_length()) // 2 - 1)


def scan(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row of x and its squared distance."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    cluster, distance = previous.copy(), np.zeros(len(x), np.int64)
    for start in np.unique(previous):
        rows = np.flatnonzero(previous == start)
        first = ((x[rows] - centroids[start]) ** 2).sum(1)
        order = np.argsort(-first, kind="stable")
        rows, first = rows[order], first[order]  # farthest first: those that still scan are always the leading ones
        best, nearest = first.copy(), np.full(len(rows), start)
        for other in np.argsort(apart[start], kind="stable"):
            if other == start:
                continue
            m = int(np.searchsorted(-4 * first, -apart[start, other], side="right"))
            if m == 0:
                break
            d = ((x[rows[:m]] - centroids[other]) ** 2).sum(1)
            better = (d < best[:m]) | ((d == best[:m]) & (other < nearest[:m]))
            best[:m][better], nearest[:m][better] = d[better], other
        cluster[rows], distance[rows] = nearest, best
    return cluster, distance


def assign(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """state (id, x, cluster) with each row's cluster among the centroids and its distance."""
    held = np.array(centroids, np.int64)
    fields = ", ".join(f"{c} {t}" for c, t in state.select("id", "x", "cluster").dtypes) + ", distance long"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            cluster, distance = scan(x, b.column("cluster").to_numpy(zero_copy_only=False), held)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "x", "cluster", "distance"])

    return state.select("id", "x", "cluster").mapInArrow(scanned, fields)


def moved(state: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Every non-empty centroid replaced by the exact floor of its vectors' mean."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    found = {r["cluster"]: [r[f"s{i}"] // r["n"] for i in range(dims)] for r in sums.collect()}
    return [found.get(j, c) for j, c in enumerate(centroids)]


def cluster_vectors(df: DataFrame, vector: str, id_column: str, k: int = 40, rounds: int = 5, dims: int = 64, factor: int = 256, salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """id, x (the entries as integers floor(factor * c)), cluster, distance of every kept vector, and the final centroids. The
    first centroids are the k vectors with the least SHA-256 of salt and id."""
    spark = df.sparkSession
    kept = df.where((F.size(vector) == dims) & whole(F.col(vector)))
    state, path = store(kept.select(F.col(id_column).alias("id"), scaled(F.col(vector), factor, entry_limit(dims)).alias("x"), F.lit(0).alias("cluster")), "vectors")
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["x"]) for r in state.orderBy(key, "x").limit(k).select("x").collect()]
    if not centroids:
        return state.withColumn("distance", F.lit(None).cast("long")), centroids
    for _ in range(rounds):
        after, written = store(assign(state, centroids), "assigned")
        centroids = moved(after, centroids, dims)
        discard(spark, path)
        state, path = after, written
    out = stored(assign(state, centroids), "clusters")
    discard(spark, path)
    return out, centroids


def clusters_with_inertia(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", **options) -> DataFrame:
    """id_column, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector. What joins is one row
    a cluster, so at most k rows are broadcast."""
    rows, centroids = cluster_vectors(df, vector, id_column, **options)
    spark = df.sparkSession
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = rows.agg(F.sum("distance").alias("inertia"))
    held = spark.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(centroids)], "cluster int, centroid string")
    known = sums.join(F.broadcast(total)).join(F.broadcast(held), "cluster").withColumn("centroid_sha256", F.sha2("centroid", 256))
    return rows.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
