"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Method: the covariance is never formed. A pass over the fit list takes a block Q of a few orthonormal columns to
V Q = XᵀXQ / n, X centred: tasks multiply their blocks of vectors, Spark sums the dims x columns products. A Chebyshev
polynomial of V, a pass a degree, damps the spectrum below the block's least Ritz value; QR and Rayleigh-Ritz on what
is left give new Ritz pairs. It ends when every wanted pair is certified: its residual |V q - e q| is at most TOLERANCE of
the greatest eigenvalue, or as small as rounding lets it get. Guard columns beyond the wanted ones would show a
direction that was missed. Where gaps are too small to get there the block doubles, up to all dimensions, for which
Rayleigh-Ritz is exact after one pass.

Vectors become integers first (floor(256 * entry)); counts, sums and deviations are exact integers.

Defined cases: a null vector, or one with a null or non-finite entry, leaves. The length that most vectors have (of equally
frequent ones the greater) is the table's; vectors of other lengths leave too, as do empty ones. Null ids are passed
through and repeated rows return each; the fit list has every distinct vector once. Components whose eigenvalue
isn't above 1e-13 of the trace have no whitened values and no rows, so a table whose vectors are all equal, or an
empty one, gives no rows. deviation is null where it doesn't fit a long; deviation_exact has it. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import vectorblocks as vb
from cairnwork.llm.common import load, ship, store

SCALE, WANTED, GUARDS = 256, 4, 12
#: Residual of a certified pair, as a share of the greatest eigenvalue.
TOLERANCE = 1e-13
#: Where rounding stops residuals from falling, this much is accepted.
ROUNDED = 1e-12
DEGREES = (4, 24)
#: Matrices that one pass sends to the driver at most.
MOST_PARTS = 256


@dataclass(frozen=True)
class Whitening:
    """What apply() needs: exact count and sums, unit components as columns, eigenvalues, the trace, passes taken."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def length_of(rows: DataFrame) -> int:
    """The length that most vectors have; 0 without rows."""
    found = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect()
    return found[0]["d"] if found else 0


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Exact n, sums per dimension and sum of all squares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 2, object)
        for batch in batches:
            for x in vb.unpack(batch, dims):
                reach = max(1, -int(x.min()), int(x.max()))
                if reach * reach * x.size >= 1 << 62:
                    x = x.astype(object)
                total[:dims] += [int(s) for s in x.sum(0)]
                total[dims] += int((x * x).sum())
                total[dims + 1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 2), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["at", "s"])

    found = fit.mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()  # dims + 2 rows
    total = {r["at"]: int(r["s"]) for r in found}
    return total.get(dims + 1, 0), [total.get(k, 0) for k in range(dims)], total.get(dims, 0)


def summed(fit: DataFrame, dims: int, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of add(block of vectors), a matrix of this shape, over the fit list: one matrix a task, at most MOST_PARTS of them for the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in vb.unpack(batch, dims):
                total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1])
        for batch in batches:
            for part in batch.column("s"):
                total += part.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    parts = fit.mapInArrow(run, "s array<double>")
    if fit.rdd.getNumPartitions() > MOST_PARTS:
        parts = parts.repartition(MOST_PARTS // 4).mapInArrow(again, "s array<double>")
    found = parts.toArrow().column("s")
    return np.sum([x.values.to_numpy() for x in found], axis=0).reshape(shape) if len(found) else np.zeros(shape)


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Q -> V Q, a pass over the fit list; what comes back has dims x columns entries."""

    def product(q: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed(fit, len(mean), q.shape, add) / n

    return product


def filtered(product: Callable, x: np.ndarray, vx: np.ndarray, top: float, cut: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times x, small on [0, cut] and about 1 at top; vx = V x, so that it takes degree - 1 passes."""
    half = centre = cut / 2
    sigma = half / (top - centre)
    tau = 2 / sigma
    last, now = x, (vx - centre * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        last, now = now, (product(now) - centre * now) * (2 * after / half) - (sigma * after) * last
        sigma = after
    return now


def leading(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int = WANTED, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """Unit eigenvectors (columns) and eigenvalues, falling, of the wanted greatest; passes taken."""
    wanted = min(wanted, dims)
    width = min(dims, wanted + GUARDS)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dims, width)))[0]
    passes, stuck, best = 0, 0, math.inf
    while True:
        vq = product(q)
        passes += 1
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        if width == dims or top == 0 or residual <= TOLERANCE * top:
            return q[:, :wanted], values[:wanted], passes
        stuck = stuck + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if stuck >= 2 and residual <= ROUNDED * top:
            return q[:, :wanted], values[:wanted], passes
        if stuck >= 4 or passes > 40 * (1 + width // (wanted + GUARDS)) * DEGREES[1]:  # gaps are too small: a wider block
            wider = min(dims, 2 * width)
            q = np.linalg.qr(np.c_[q, rng.normal(size=(dims, wider - width))])[0]
            width, stuck, best = wider, 0, math.inf
            continue
        cut = float(values[-1])
        if cut <= 1e-13 * top:  # the block holds all of the spectrum that isn't rounding
            q = np.linalg.qr(vq)[0]
            continue
        ratio = max((float(values[wanted - 1]) - cut / 2) / (cut / 2), 1 + 1e-6)
        degree = int(min(max(math.ceil(math.acosh(1e6) / math.acosh(ratio)), DEGREES[0]), DEGREES[1]))
        q = np.linalg.qr(filtered(product, q, vq, top, cut, degree))[0]
        passes += degree - 1


def fit(rows: DataFrame, dims: int, wanted: int = WANTED) -> tuple[Whitening, DataFrame] | None:
    """The whitening of rows (vec_id, x), and the stored fit list; None where there is no component."""
    distinct, _ = store(vb.blocks(rows.select("x").distinct(), dims, with_ids=False), "fit")
    n, sums, squares = moments(distinct, dims)
    spread = n * squares - sum(s * s for s in sums)  # n^2 times the trace, exactly
    if not n or not spread:
        return None
    trace = spread / (n * n)
    mean = np.array([s / n for s in sums])
    components, values, passes = leading(covariance_times(distinct, mean, n), dims, wanted)
    there = values > 1e-13 * trace
    return Whitening(n, tuple(sums), components[:, there], values[there], trace, passes), distinct


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity: one pass."""
    mean, projection = w.mean, w.projection
    dims, k = projection.shape

    def add(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ projection
        return np.r_[white.T @ white, [white.sum(0)]]

    total = summed(distinct, dims, (k + 1, k), add) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_exact decimal(38,0)"


def apply(rows: DataFrame, w: Whitening) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, deviation_exact."""
    ship(rows.sparkSession)
    mean, projection, explained = w.mean, w.projection, w.values / w.trace
    dims, k = projection.shape
    most = max(map(abs, w.sums))

    def deviations(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
        reach = w.n * max(1, -int(x.min()), int(x.max())) + most
        if reach * reach * dims < 1 << 63:
            exact = ((w.n * x - np.array(w.sums, np.int64)) ** 2).sum(1)
            return pa.array(exact), pa.array(exact).cast(pa.decimal128(38, 0))
        exact = ((w.n * x.astype(object) - np.array(w.sums, object)) ** 2).sum(1).tolist()
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()), pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vb.matrix(batch.column("x"), dims)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            deviation, exact = deviations(x)
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n)), deviation.take(each),
                pa.array(((x - mean) @ projection).ravel()), pa.array(np.tile(explained, len(x))), exact.take(each),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in WHITE.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, WHITE)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, wanted: int = WANTED) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, deviation_exact, identity_error."""
    spark = df.sparkSession
    rows = vb.integers(df, id_col, vector_col, scale)
    dims = length_of(rows)
    rows = rows.where(F.size("x") == dims)
    found = fit(rows, dims, wanted) if dims else None
    if found is None:
        return spark.createDataFrame([], f"{WHITE}, identity_error double")
    w, distinct = found
    return apply(rows, w).withColumn("identity_error", F.lit(identity_error(distinct, w)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
