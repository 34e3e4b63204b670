"""Whitening of embeddings by blockwise TSQR and one-sided Jacobi rotations.

1. One pass adds up every dimension exactly.
2. A second pass centres the rows and compresses them: each task stacks a batch under its triangle R and takes the
   R of that (``qr`` of a few thousand rows), so a task holds one batch and one d x d triangle.  The tasks' triangles
   are stacked in the same way, ``FAN`` at a time, in a tree of ``LEVELS`` shuffles; one d x d triangle is left (one for
   every ``FAN ** LEVELS`` tasks, to be exact).  No covariance is formed, so small deviations keep their digits.
3. On the driver plane rotations make the columns of R orthogonal (Hestenes): all pairs of columns are met once a sweep,
   d / 2 disjoint pairs at a time.  The accumulated rotations are the components, the lengths of the rotated columns the
   standard deviations times the root of n.  That is d x d work, whatever the number of rows.
4. A third pass measures the covariance of the whitened rows, a fourth one returns them.  Sums of a pass are added up by Spark.

Entries become ``floor(64 c) + 1000000``.  Rows are centred as ``n x - S`` in whole numbers before anything is divided.

Defined results.  Rows whose vector is null, empty, or holds a null or a non-finite entry are dropped, rows without id are
not.  All other vectors should have one length; of several, the commonest (the shortest of equally common ones) is
taken, and rows of other lengths are dropped.  Repeated rows count as often as they are there.  Components without variance (of a
deviation below the rounding of the largest one) cannot be whitened and are left out: with fewer rows than dimensions there
are fewer components, and one row, equal rows or an empty table give no rows.  A component's sign is that which makes its
largest entry (the first of equal ones) positive.  Entries of 2^46 and more become 2^46, deviations beyond a signed 64-bit
number the nearest such number.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
FAN, LEVELS = 64, 3
LARGEST = float(1 << 46)
TOP = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: the usable vectors, of any length, with whole entries."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable)
    return rows.select("id", F.transform("v", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)) * SCALE) + SHIFT).alias("x"))


@dataclass
class Sums:
    """Rows, length, sums of each dimension, and the largest entry by amount."""

    n: int
    dims: int
    sums: list[int]
    largest: int

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``n x - S``: whole numbers, objects of Python beyond 63 bits."""
        if self.largest * self.n * 2 < TOP:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        y = self.centred(rows)
        if y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * self.dims > TOP:
            y = y.astype(object)
            return np.array([min(TOP, int(d)) for d in (y * y).sum(1)], np.int64)
        return (y * y).sum(1)

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """``x - S / n``."""
        return self.centred(rows).astype(np.float64) / self.n


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def add_up(rows: DataFrame) -> Sums | None:
    """Sums of the vectors of the commonest length; ``None`` without any."""
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("largest"))
    found = lengths.orderBy(F.desc("n"), "dims").limit(1).collect()
    if not found:
        return None
    dims = found[0].dims

    def run(batches):
        total = None
        for b in batches:
            own = _rows(b, dims)
            safe = not own.size or int(np.abs(own).max()) * len(own) < TOP
            part = own.sum(0).astype(object) if safe else own.astype(object).sum(0)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(s) for s in total])], names=["at", "s"])

    # Decimals hold what a task's sum can be; as text they cross from Python exactly.
    sums = rows.where(F.size("x") == dims).select("x").mapInArrow(run, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    return Sums(found[0].n, dims, [int(r.s) for r in sorted(sums)], int(found[0].largest))


def _triangle(blocks, dims: int) -> np.ndarray:
    """R of all rows of ``blocks``, one block at a time under the R before."""
    r = np.zeros((0, dims))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


_R = "task long, r binary"


def compress(rows: DataFrame, sums: Sums, fan: int = FAN) -> np.ndarray:
    """R of all centred rows: R'R is n times their covariance."""
    dims = sums.dims

    def triangles(batches):
        r = _triangle((sums.scaled(_rows(b, dims)) for b in batches if b.num_rows), dims)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["task", "r"])

    def stack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["task"].to_numpy())
        raw = table["r"].to_pylist()
        r = _triangle((np.frombuffer(raw[i]).reshape(-1, dims) for i in order), dims)
        return pa.table({"task": pa.array([int(table["task"][int(order[0])].as_py()) // fan], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    found = rows.select("x").mapInArrow(triangles, _R)
    for _ in range(LEVELS):
        found = found.groupBy(F.expr(f"task div {fan}")).applyInArrow(stack, _R)
    return _triangle((np.frombuffer(r.r).reshape(-1, dims) for r in found.orderBy("task").collect()), dims)


def rotate(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the columns of ``r`` once rotations have made them orthogonal, falling, and the rotations: ``r v`` has those columns.

    A sweep meets all pairs of columns in rounds of disjoint pairs (the first column stays, the others go around it)."""
    dims = r.shape[1]
    a, v = np.array(r, np.float64), np.eye(dims)
    seats = list(range(dims)) + [-1] * (dims % 2)
    tiny = np.finfo(np.float64).eps
    least = float((a**2).sum()) * tiny**2  # columns shorter than this are none
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[:half], seats[:half - 1 : -1]) if x >= 0 and y >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            size = np.maximum(np.sqrt(alpha) * np.sqrt(beta), least)
            turn = np.abs(gamma) > tiny * size
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if worst <= 8 * tiny:
            break
    lengths = np.sqrt((a**2).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


@dataclass
class Whitening:
    """A fit: components as columns, their standard deviations, and the share of the whole variance of each."""

    sums: Sums
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.sums.scaled(rows) @ self.components / self.deviations


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``id, x``; ``None`` where nothing varies."""
    sums = add_up(rows)
    if sums is None:
        return None
    rows = rows.where(F.size("x") == sums.dims)
    lengths, turned = rotate(compress(rows, sums))
    if not lengths[0] > 0:
        return None
    kept = np.flatnonzero(lengths > lengths[0] * sums.dims * 8 * np.finfo(np.float64).eps)[:most]
    signs = np.sign(turned[np.abs(turned[:, kept]).argmax(0), kept])
    return Whitening(sums, turned[:, kept] * signs, lengths[kept] / np.sqrt(sums.n), lengths[kept] ** 2 / (lengths**2).sum())


def identity_error(rows: DataFrame, whitening: Whitening) -> float:
    """The largest entry, by amount, of the covariance of the whitened rows less the identity, from a pass over the rows."""
    dims, k = whitening.sums.dims, whitening.components.shape[1]

    def run(batches):
        total = None
        for b in batches:
            w = whitening.project(_rows(b, dims))
            w = np.hstack([w, np.ones((len(w), 1))])
            total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    cells = rows.where(F.size("x") == dims).select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # (k + 1) squared rows
    total = np.array([r.s for r in sorted(cells)]).reshape(k + 1, k + 1) / whitening.sums.n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, whitening: Whitening) -> DataFrame:
    """``id, deviation, whitened``: an array of one entry for each component."""
    dims = whitening.sums.dims

    def run(batches):
        for b in batches:
            own = _rows(b, dims)
            w = whitening.project(own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(whitening.sums.deviations(own), pa.int64()), lists], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where(F.size("x") == dims).mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """A row for each usable vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``; and the fit."""
    rows = whole_vectors(vectors, id_col, vector_col)
    found = fit(rows, most)
    if found is None:
        empty = rows.where("false").select(F.col("id").alias(id_col), F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
        return empty, None
    error = identity_error(rows, found)
    told = F.array(*(F.lit(float(e)) for e in found.explained))  # as many as components are asked for
    out = transform(rows, found).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(found.sums.n).cast("long").alias("n"), "deviation", "whitened", F.get(told, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")), found


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
