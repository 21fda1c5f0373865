"""Whitening of embeddings by one-sided Jacobi rotations of a blockwise QR factor.

Entries c become x = floor(64 c) + 1,000,000. The fit list is each distinct x vector once. Centred rows of the fit list
are compressed batch by batch to triangular factors (QR of the factor so far stacked on the next batch), factors of
partitions are stacked and compressed again in groups of FAN, so no task holds more than FAN factors of d x d and the
driver gets FAN factors at most. Plane rotations then make the last factor's columns orthogonal: the accumulated
rotations are the components, the columns' norms the standard deviations, accurate also where they are small, since no
covariance matrix is formed.

Rows whose vector is null or holds null or non-finite entries are left out. Vectors of another length than most have no
place in one matrix: they are left out too. Entries beyond 2^34 in magnitude count as 2^34. A component without variance
(a deviation under d * 2^-52 of the largest) has whitened null and does not enter identity_error, which is null where no
component has variance. deviation is null where it does not fit a long. Repeated rows and null keys each get their rows; an empty table
gives no rows; other columns are ignored. Zero vectors take part like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work

SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 34)
FAN, BATCH = 16, 2048
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integral(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    own = own.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & (F.size("v") > 0))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = own.where(F.size("v") == (size["n"] if size else 0))
    held = lambda c: F.least(F.greatest(c, F.lit(-MOST)), F.lit(MOST))
    return own.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * held(c)) + F.lit(SHIFT)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(frame: DataFrame, run, kind: str) -> list:
    """The entries of the arrays that run makes of each partition, summed by position."""
    made = frame.mapInArrow(run, f"s array<{kind}>").select(F.posexplode("s").alias("i", "v"))
    total = made.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")).alias("v"))
    return [r["v"] for r in total.orderBy("i").collect()]


class Centre:
    """The mean S / n as an integer and a fraction, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * (s // n) for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of every row, exactly; None beyond a long."""
        own = x - self.base
        most = (int(np.abs(own).max(initial=0)) + 1) * self.n
        if x.shape[1] * most * most < 1 << 63:
            return ((own * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((own.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in exact]


def factor(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r") if len(stack) else stack


def triangular(fit: DataFrame, centre: Centre, fan: int = FAN) -> np.ndarray:
    """R of the centred fit list: a factor a partition, then factors of groups of factors."""

    def compress(batch_iter):
        own = np.empty((0, len(centre.base)))
        for batch in work.batches(batch_iter, BATCH):
            own = factor(np.vstack([own, centre.centred(matrix(batch.column(0)))]))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(own), pa.int64()), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["part", "r"])

    def join(stack: pa.Table) -> pa.Table:
        own = factor(matrix(stack.column("r").combine_chunks()))
        return pa.table([pa.array([stack.column("part")[0].as_py() // fan] * len(own), pa.int64()), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["part", "r"])

    kind = "part long, r array<double>"
    rows = work.table(fit.select("x").mapInArrow(compress, kind), "factors")
    while (rows.agg(F.max("part")).first()[0] or 0) >= fan:
        rows = work.table(rows.groupBy(F.floor(F.col("part") / fan).alias("group")).applyInArrow(join, kind), "factors")
    return factor(np.array([r["r"] for r in rows.orderBy("part").collect()]))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(deviations times sqrt(n) in falling order, components as columns) of a factor, by one-sided rotations.

    The columns meet in a round robin of disjoint pairs, so one step rotates d / 2 pairs at once.
    """
    d = r.shape[1]
    even = d + d % 2
    u, v = np.zeros((r.shape[0], even)), np.eye(even)
    u[:, :d] = r
    ring = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            a, b = ring[: even // 2], ring[even // 2 :][::-1]
            ua, ub = u[:, a], u[:, b]
            aa, bb, ab = (ua * ua).sum(0), (ub * ub).sum(0), (ua * ub).sum(0)
            size = np.sqrt(aa) * np.sqrt(bb)
            turn = np.abs(ab) > 1e-16 * size
            worst = max(worst, float(np.max(np.abs(ab[turn]) / size[turn], initial=0.0)))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                z = (bb - aa) / (2 * ab)
                t = np.where(turn, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            u[:, a], u[:, b] = c * ua - s * ub, s * ua + c * ub
            va, vb = v[:, a], v[:, b]
            v[:, a], v[:, b] = c * va - s * vb, s * va + c * vb
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst < 1e-14:
            break
    norms = np.sqrt((u * u).sum(0))
    norms[d:] = -1.0  # the column that made the number even
    order = np.argsort(-norms, kind="stable")[:d]
    return norms[order], v[:d, order]


def whiten(rows: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding", fan: int = FAN) -> DataFrame:
    """One row per row that takes part and component, numbered from 1 by falling variance: see OUT."""
    spark = rows.sparkSession
    own = integral(rows, key, vector)
    with work.scratch(spark):
        fit = work.table(own.select("x").distinct(), "fit")
        n = fit.count()
        if not n:
            return spark.createDataFrame([], OUT)

        def totals(batch_iter):
            for batch in work.batches(batch_iter, BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([matrix(batch.column(0)).sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["s"])

        centre = Centre(n, [int(s) for s in summed(fit, totals, "long")])
        norms, vectors = jacobi(triangular(fit, centre, fan))
        k = min(components, len(norms))
        deviation = norms[:k] / np.sqrt(n)
        live = norms[:k] > len(norms) * 2.0**-52 * norms[0]
        weights = np.where(live, vectors[:, :k] / np.where(live, deviation, 1.0), 0.0)
        total = float((norms**2).sum())
        explained = (norms[:k] ** 2 / total if total else np.zeros(k)).tolist()

        def moments(batch_iter):
            for batch in work.batches(batch_iter, BATCH):
                z = centre.centred(matrix(batch.column(0))) @ weights
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([z.sum(0), (z.T @ z).ravel()]).tolist()], pa.list_(pa.float64()))], names=["s"])

        sums = np.array(summed(fit, moments, "double"))
    mean, second = sums[:k] / n, sums[k:].reshape(k, k) / n
    off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    error = float(off.max()) if live.any() else None
    alive = np.flatnonzero(live)

    def project(batch_iter):
        for batch in work.batches(batch_iter, BATCH):
            x = matrix(batch.column(1))
            z = (centre.centred(x) @ weights).ravel()
            dead = np.ones((len(x), k), bool)
            dead[:, alive] = False
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n, np.int64)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(z, mask=dead.ravel()), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.select("vec_id", "x").mapInArrow(project, OUT)
