"""Whitening of embeddings: a randomised range finder with Rayleigh-Ritz over all centred rows.

The fit list holds each distinct vector once. A block of COMPONENTS + OVERSAMPLING random directions is multiplied by the
covariance again and again, one pass over the list each (every task multiplies its centred rows and hands on one sum),
and Rayleigh-Ritz turns the block into approximate eigenvectors with their residuals. Where the residuals of the wanted
components are not at the level of rounding after PASSES passes, or shrink too slowly to get there, the block is expanded to
full dimension, whose Rayleigh-Ritz is exact. What reaches the driver is bounded by the dimensions: a matrix of dims x block.

Entries are integers, so sums are exact, and a row is centred as (x - m) - r with m the integer part of the mean and r its
rest below one: no digit is lost however far the vectors lie from the origin.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; repeated vectors count once
in the fit and are all whitened; a null id stays; vectors of different lengths are spaces of their own, each fitted
alone; components without variance (an eigenvalue at the level of rounding) are left out, so that one vector alone, an empty vector or an
empty table gives no row; further columns are not read. An entry beyond LIMIT after scaling ends the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import stored
from attestor.llm.vectors import scaled, whole

COMPONENTS, OVERSAMPLING, PASSES = 16, 8, 4
#: Residuals below this share of the largest eigenvalue count as rounding.
TOLERANCE = 1e-14
#: Eigenvalues below this share of the trace are no variance.
FLAT = 1e-13
LIMIT = 1 << 31


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: n distinct vectors with the sums of their dimensions, components as columns by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    expanded: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n in doubles, each entry right to its last digit."""
    means = np.array([s // n for s in sums], np.int64)
    rests = np.array([(s % n) / n for s in sums])
    return (x - means) - rests


def matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all batches of make(x), an array of so many doubles: one array a task, then map-side sums by position."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += make(matrix(b)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    sums = rows.select("x").mapInArrow(totals, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r["at"]] = r["v"]
    return out


def ritz(q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), vectors and residuals of the covariance on the space of q, where z is the covariance times q."""
    t = q.T @ z
    e, u = np.linalg.eigh((t + t.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    vectors = q @ u
    return e, vectors, np.linalg.norm(z @ u - vectors * e, axis=0)


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 0) -> Whitening | None:
    """rows (x array<long> of so many entries), each distinct vector once, stored; None where there is no row."""
    n = rows.count()
    if not n or not dims:
        return None
    exact = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = tuple(int(s) for _, s in sorted((r["at"], r["s"]) for r in exact))

    def covariance_times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times q, and its trace."""

        def make(x: np.ndarray) -> np.ndarray:
            a = centred(x, n, sums)
            return np.append(a.T @ (a @ q), (a * a).sum())

        got = summed(rows, make, dims * q.shape[1] + 1) / n
        return got[:-1].reshape(q.shape), float(got[-1])

    random = np.random.default_rng(seed)
    block, wanted = min(dims, components + oversampling), min(dims, components)
    q = np.linalg.qr(random.standard_normal((dims, block)))[0]
    done, before = 0, np.inf
    while True:
        z, trace = covariance_times(q)
        done += 1
        e, vectors, residuals = ritz(q, z)
        worst = residuals[:wanted].max() / max(e[0], np.finfo(float).tiny)
        if trace == 0 or worst <= TOLERANCE or q.shape[1] == dims:
            return Whitening(n, sums, vectors[:, :wanted], e[:wanted], trace, done, q.shape[1] == dims > block)
        left = passes - done
        if left <= 0 or worst * (worst / before if np.isfinite(before) else 0) ** left > TOLERANCE:
            more = random.standard_normal((dims, dims - block))
            q = np.linalg.qr(np.hstack([vectors, more]))[0]
        else:
            q = np.linalg.qr(z)[0]
        before = worst


def exact_deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n * x - sum)^2 of each row; None where it is beyond a long."""
    means, rests = [s // n for s in sums], [s % n for s in sums]
    near = x - np.array(means, np.int64)
    rough = ((near.astype(float) - np.array(rests, float) / n) * n) ** 2
    out: list[int | None] = []
    small = rough.sum(1) < 2.0**62
    fast = np.zeros(len(x), np.int64)
    if small.any():
        fast[small] = ((near[small] * n - np.array(rests, np.int64)) ** 2).sum(1)
    for i, fits in enumerate(small):
        if fits:
            out.append(int(fast[i]))
        else:
            d = sum((int(v) * n - r) ** 2 for v, r in zip(near[i], rests, strict=True))
            out.append(d if d < 2**63 else None)
    return out


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """rows (id, x) with whitened, an array with an entry for each component that has variance, and deviation."""
    held = w.eigenvalues > FLAT * w.trace
    turn = w.components[:, held] / np.sqrt(w.eigenvalues[held])
    kind = dict(rows.dtypes)["id"]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                y = w.centred(x) @ turn
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), values, pa.array(exact_deviation(x, w.n, w.sums), pa.int64())], ["id", "whitened", "deviation"])

    return rows.select("id", "x").mapInArrow(turned, f"id {kind}, whitened array<double>, deviation long")


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity."""
    held = w.eigenvalues > FLAT * w.trace
    turn = w.components[:, held] / np.sqrt(w.eigenvalues[held])
    m = turn.shape[1]

    def make(x: np.ndarray) -> np.ndarray:
        y = centred(x, w.n, w.sums) @ turn
        return np.append((y.T @ y).ravel(), y.sum(0))

    got = summed(rows, make, m * m + m) / w.n
    means = got[m * m :]
    return float(np.abs(got[: m * m].reshape(m, m) - np.outer(means, means) - np.eye(m)).max(initial=0.0))


def whiten(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", factor: int = 64, shift: int = 1_000_000, components: int = COMPONENTS) -> DataFrame:
    """id_column, component (from 1), n, deviation, whitened, explained, identity_error of every row with a whole vector, a row for each
    component. The fit list and the scaled rows are stored: several passes read them."""
    rows = stored(df.where(whole(F.col(vector))).select(F.col(id_column).alias("id"), scaled(F.col(vector), factor, LIMIT, shift).alias("x")), "vectors")
    fit_list = stored(rows.select("x").distinct(), "fit-list")
    kind = dict(rows.dtypes)["id"]
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = []
    for dims in sorted(r["dims"] for r in fit_list.groupBy(F.size("x").alias("dims")).count().collect()):  # one for each length of a vector
        own = fit_list.where(F.size("x") == dims)
        w = fit(own, dims, components)
        if w is None or not (w.eigenvalues > FLAT * w.trace).any():
            continue
        shares = F.array(*[F.lit(float(e / w.trace)) for e in w.eigenvalues])
        turned = whitened(rows.where(F.size("x") == dims), w).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        out.append(turned.select(
            "id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
            F.lit(identity_error(own, w)).alias("identity_error"),
        ))
    nothing = df.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return (reduce(DataFrame.unionAll, out) if out else nothing).select(*names).withColumnRenamed("id", id_column)
