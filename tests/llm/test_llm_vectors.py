"""Clustering and whitening against plain numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestor.llm import clustering, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, cluster string, distance string, id string, n string, component string"


def vectors(spark, dims=64, rows=300, seed=3):
    """Clustered vectors, some twice, with rows that have to go and columns whose names the operators use."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.2, (5, dims))
    held = [(i, [float(v) for v in middle[i % 5] + rng.normal(0, 0.05, dims)]) for i in range(rows)]
    held += [(rows + i, held[i][1]) for i in range(10)] + [(0, held[1][1]), (None, held[2][1])]
    odd = [(9001, None), (9002, []), (9003, held[0][1][:-1] + [math.nan]), (9004, held[0][1][:-1] + [math.inf]), (9005, held[0][1][:-1] + [None])]
    return spark.createDataFrame([(*r, *["?"] * 6) for r in held + odd], SCHEMA), held


def plain_clusters(held, k, rounds):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in held])
    order = sorted(range(len(held)), key=lambda i: (hashlib.sha256(f"2:{'' if held[i][0] is None else held[i][0]}".encode()).hexdigest(), list(x[i])))
    centroids = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        at = d.argmin(1)
        if r < rounds:
            for j in set(at):
                centroids[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(0)]
    return at, d.min(1), centroids


@pytest.mark.parametrize("k,rounds", [(1, 2), (7, 5), (40, 3), (500, 1)])
def test_clusters_equal_full_scans(spark, k, rounds):
    df, held = vectors(spark)
    at, distance, centroids = plain_clusters(held, k, rounds)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {j: int(distance[at == j].sum()) for j in set(at)}
    want = sorted((str(held[i][0]), int(at[i]), int(distance[i]), inertia[at[i]], int(distance.sum()), sha[at[i]]) for i in range(len(held)))
    assert sorted((str(r[0]), *r[1:]) for r in clustering.clusters_with_inertia(df, k=k, rounds=rounds).collect()) == want


def test_a_scan_stops_only_strictly_beyond_twice_the_distance():
    centroids = np.array([[4, 0], [0, 0], [100, 0]])  # the vector lies in the middle of 1 and 0: the smaller number wins
    cluster, distance = clustering.scan(np.array([[2, 0], [2, 0], [2, 0]]), np.array([0, 1, 2]), centroids)
    assert cluster.tolist() == [0, 0, 0] and distance.tolist() == [4, 4, 4]


def test_scans_skip_what_is_far():
    rng = np.random.default_rng(0)
    x, centroids = rng.integers(-50, 50, (400, 8)), rng.integers(-50, 50, (30, 8))
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    for previous in (np.zeros(400, np.int64), d.argmin(1), rng.integers(0, 30, 400)):
        cluster, distance = clustering.scan(x, previous, centroids)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_clusters_of_nothing(spark):
    df, _ = vectors(spark)
    assert clustering.clusters_with_inertia(df.limit(0)).collect() == []
    assert clustering.clusters_with_inertia(df.where("vec_id > 9000")).collect() == []


def test_entries_beyond_exact_squares_are_refused(spark):
    far = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(PySparkException):
        clustering.clusters_with_inertia(far).collect()


def plain_whitening(held):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in held])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    a = (n * distinct - sums) / n
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    return x, n, sums, v, e[::-1], u[:, ::-1]


def test_whitening_equals_the_full_eigenvectors(spark):
    df, held = vectors(spark)
    x, n, sums, v, e, u = plain_whitening(held)
    want = ((n * x - sums) / n) @ u[:, :16] / np.sqrt(e[:16])
    got = whitening.whiten(df).collect()
    assert len(got) == len(held) * 16 and {r["n"] for r in got} == {n}
    by: dict = {}
    for r in got:
        by.setdefault(r["component"], []).append((str(r["vec_id"]), round(r["whitened"], 7)))
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-9
    for c in range(1, 17):
        own = sorted((str(i), round(float(y), 7)) for (i, _), y in zip(held, want[:, c - 1], strict=True))
        turned = sorted((i, -y) for i, y in own)
        mine = sorted(by[c])
        assert min(max(abs(p[1] - q[1]) for p, q in zip(mine, side, strict=True)) for side in (own, turned)) < 1e-6
    deviations = sorted((str(i), int(((n * row.astype(object) - sums) ** 2).sum())) for (i, _), row in zip(held, x, strict=True))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == deviations


def test_residuals_decide_whether_the_block_is_expanded(spark):
    rng = np.random.default_rng(1)
    steep = (rng.normal(0, 1, (400, 64)) * np.array([10.0 ** -(i // 2) if i < 16 else 0 for i in range(64)])).tolist()
    flat = rng.normal(0, 1, (400, 64)).tolist()
    fits = []
    for rows in (steep, flat):
        x = spark.createDataFrame([([int(v * 1e6) for v in r],) for r in rows], "x array<long>")
        w = whitening.fit(x, 64)
        a = np.array([r["x"] for r in x.collect()], float)
        a -= a.mean(0)
        cov = a.T @ a / len(a)
        assert np.abs(cov @ w.components - w.components * w.eigenvalues).max() <= 1e-12 * w.eigenvalues[0]
        fits.append(w)
    assert not fits[0].expanded and fits[1].expanded


def test_whitening_without_variance_and_of_several_lengths(spark):
    df, held = vectors(spark)
    one = df.where("vec_id = 5")
    assert whitening.whiten(one).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    both = whitening.whiten(line.unionByName(df.select((F.col("vec_id") + 100_000).alias("vec_id"), "embedding"))).groupBy("n").count().collect()
    assert len(both) == 2


def test_deviations_beyond_a_long_are_null():
    n = 3 * 10**9
    x = np.array([[10**6 + 5, 10**6], [10**6, 10**6]])
    sums = (n * 10**6 + 7, n * 10**6)
    got = whitening.exact_deviation(x, n, sums)
    assert got == [None, 49] and whitening.exact_deviation(np.array([[10**6 + 1, 10**6]]), n, sums) == [(n - 7) ** 2]
