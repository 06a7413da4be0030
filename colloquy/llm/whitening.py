"""Whitening of embeddings by LOBPCG.

The covariance is never formed: each iteration multiplies it by a block of directions, in one pass over the centred rows (partial sums in
tasks, added pairwise). In the space of the iterate, its residual and the previous direction the best block follows from a small
eigenproblem (Rayleigh-Ritz). The driver holds blocks of dimensions × components only, whatever the number of rows.

Iterations end when the residuals, of a product made anew for that, certify each component."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, prepare

#: Components at most; extra directions carried along, so that those asked for converge faster.
COMPONENTS, GUARD = 32, 8
#: Residual of a certified component, and what is accepted where rounding lets it fall no further, as parts of the largest eigenvalue.
CERTIFIED, ACCEPTED = 1e-13, 1e-10
#: Iterations at most; with none of them certified the fit fails.
MOST = 1000
#: Components whose variance is a smaller part of the largest are none.
NOTHING = 1e-12
#: Longs of a vector lie within this, so that differences of two are longs too.
LIMIT = 1 << 61
#: What is added to each scaled entry, and the scale.
SHIFT, SCALE = 1_000_000, 64


def entries(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of each entry, c as double; beyond LIMIT it stands at LIMIT."""

    def one(c: Column) -> Column:
        within = F.least(F.greatest(c.cast("double") * float(SCALE), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
        return F.floor(within).cast("long") + SHIFT

    return F.transform(vector, one)


def usable(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """vec_id, x of the vectors without null or non-finite entries, of the commonest length (the greater of equally common ones)."""
    v = F.col(vector)
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    rows = rows.where(fine).select(F.col(name).cast("long").alias("vec_id"), entries(v).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    first = sizes.first()
    return rows.where(F.size("x") == (first["d"] if first else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _added(rows: DataFrame, d: int, columns: int, kind: type, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of`` (a block of vectors) → an array of ``columns`` values; added in tasks, then by a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns, kind)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                total += of(_matrix(batch.slice(i, 4096), d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns, kind)
        for part in parts:
            for s in part.column("s").to_pylist():
                total += np.frombuffer(s, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    parts = rows.select("x").mapInArrow(run, "s binary")
    n = rows.rdd.getNumPartitions()
    while n > 64:  # no task and no driver meets all tasks' sums
        n = -(-n // 16)
        parts = parts.repartition(n).mapInArrow(merge, "s binary")
    return np.sum([np.frombuffer(r.s, kind) for r in parts.collect()], axis=0, dtype=kind)


@dataclass(frozen=True)
class Centre:
    """n, and the sums S of each dimension as S = n * base + rest, 0 <= rest < n: exact, and differences stay small."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n*x - S)^2, exact; the greatest long where it holds no more."""
        small = x - self.base
        if self.n * float(np.abs(small).max(initial=0) + 1) < 2.0**31 / np.sqrt(max(x.shape[1], 1)):
            return np.square(self.n * small - self.rest).sum(1)
        far = np.square(np.abs(small).astype(float) * self.n + self.n).sum(1) >= 2.0**62
        whole = self.n * np.where(far[:, None], 0, small) - self.rest
        out = np.square(whole).sum(1)
        if far.any():
            exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in small[far].tolist()]
            out[far] = [min(v, (1 << 63) - 1) for v in exact]
        return out


def centre(rows: DataFrame, d: int) -> Centre:
    """Sums by halves of 32 bits, so that they are exact up to 2**31 rows of any longs."""

    def of(x: np.ndarray) -> np.ndarray:
        return np.concatenate(((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), [len(x)]))

    total = _added(rows, d, 2 * d + 1, np.int64, of).tolist()
    n = total[-1]
    sums = [(h << 32) + low for h, low in zip(total[:d], total[d : 2 * d], strict=True)]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


@dataclass(frozen=True)
class Components:
    centre: Centre
    vectors: np.ndarray  # dimensions × components
    values: np.ndarray
    trace: float
    residuals: np.ndarray  # of each component: the length of V u - e u
    iterations: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.off(x) @ (self.vectors / np.sqrt(self.values))


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``against`` (orthonormal); directions that add nothing are left out."""
    for _ in range(2):  # twice is enough for full precision
        if against is not None and against.shape[1]:
            block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-300] / size[size > 1e-300]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    if against is not None and against.shape[1]:  # rounding noise of directions that lie in ``against``
        block = block - against @ (against.T @ block)
        block = block[:, np.linalg.norm(block, axis=0) > 0.5]
        block = np.linalg.qr(block)[0] if block.shape[1] else block
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, most: int = MOST, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k greatest eigenvalues (falling) of a symmetric positive matrix with their vectors, the length of each residual, and the
    iterations. product: a block of vectors → the matrix times it. Raises ArithmeticError if they aren't certified after ``most``."""
    m = min(d, k + guard)
    x = orthonormal(np.random.default_rng(seed).standard_normal((d, m)))
    vx = product(x)
    p, best, still = np.zeros((d, 0)), np.inf, 0
    for iteration in range(1, most + 1):
        values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        order = np.argsort(-values, kind="stable")
        values, x, vx = values[order], x @ turn[:, order], vx @ turn[:, order]
        residual = vx - x * values
        size, largest = np.linalg.norm(residual, axis=0), max(values[0], 0.0)
        worst = size[:k].max()
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        if worst <= CERTIFIED * largest or largest == 0 or still >= 8 and worst <= ACCEPTED * largest:
            # certified by a product of these very vectors, not by what the iterations carried along
            x = np.linalg.qr(x)[0]
            vx = product(x)
            values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
            order = np.argsort(-values, kind="stable")[:k]
            values, x, vx = values[order], x @ turn[:, order], vx @ turn[:, order]
            size = np.linalg.norm(vx - x * values, axis=0)
            if size.max() <= ACCEPTED * largest or largest == 0:
                return x, values, size, iteration
            raise ArithmeticError(f"residual {size.max():g} of a largest eigenvalue {largest:g}")
        w = orthonormal(residual[:, size > 1e-15 * largest], x)
        q = orthonormal(p, np.hstack((x, w)))
        new = np.hstack((w, q))
        image = np.hstack((vx, product(new))) if new.shape[1] else vx
        basis = np.hstack((x, new))
        _, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turn = turn[:, ::-1][:, :m]
        past = turn.copy()
        past[: x.shape[1]] = 0  # the step: what the new block has beyond the old one
        x, vx, p = basis @ turn, image @ turn, basis @ past
    raise ArithmeticError(f"no component certified in {most} iterations")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Components | None:
    """The components of rows (see :func:`usable`), by passes over them; None if there are none: no row, or no variance."""
    first = rows.first()
    d = len(first["x"]) if first else 0
    if not d:
        return None
    middle = centre(rows, d)

    def product(block: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast((middle, block))  # dimensions × directions

        def of(x: np.ndarray) -> np.ndarray:
            own, b = sent.value
            off = own.off(x)
            return off.T @ (off @ b)

        out = _added(rows, d, block.size, np.float64, of).reshape(block.shape) / middle.n
        sent.destroy()
        return out

    trace = float(_added(rows, d, 1, np.float64, lambda x: np.array([np.square(middle.off(x)).sum()]))[0]) / middle.n
    if trace <= 0:
        return None
    vectors, values, residuals, iterations = lobpcg(product, d, min(components, d))
    real = values > NOTHING * values[0]
    vectors, values = vectors[:, real], values[real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])  # either sign would do; the greatest entry is positive
    return Components(middle, vectors, values, trace, residuals[real], iterations)


def identity_error(rows: DataFrame, c: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the whitened rows themselves."""
    d, k = c.vectors.shape

    def of(x: np.ndarray) -> np.ndarray:
        w = c.whitened(x)
        return np.concatenate((w.sum(0), (w.T @ w).ravel()))

    total = _added(rows, d, k + k * k, np.float64, of) / c.centre.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


_WHITE = "vec_id long, n long, deviation long, whitened array<double>"


def whiten(vectors: DataFrame, vector: str = "embedding", name: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold null or non-finite entries, take no part, nor do those of another length than the commonest. The fit list
    is all others, repeated rows as often as they come. Entries that no long can hold once scaled stand at ±2**61. A component without variance can't
    be whitened and isn't returned, so a single row, equal rows and empty vectors give no rows, as an empty table does; null vec_ids
    stay. Equal eigenvalues have an arbitrary basis, the same for all rows. Other columns are ignored."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = cut(usable(vectors, vector, name))
    found = fit(rows, components)
    if found is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, found)
    d = len(found.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.vectors.shape[1]), pa.array(found.whitened(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.full(len(x), found.centre.n)), pa.array(found.centre.deviation(x)), white], ["vec_id", "n", "deviation", "whitened"])
        give_back()

    out = rows.mapInArrow(run, _WHITE).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
