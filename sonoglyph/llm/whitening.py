"""Operator 13, embedding whitening: spectral divide and conquer on the covariance by QDWH polar decompositions.

Sums and centred products of all vectors are made by Spark: each task folds its rows into one d x d matrix, and a few tasks
fold those, so that what reaches the driver has a size of its own, whatever the number of vectors. The driver splits
the covariance (d x d): the unitary polar factor of A - s I has the eigenvalues' signs, so that (U + I) / 2 projects on the
space of those above s; bases of both spaces part the matrix in two smaller ones, until each is a number. The
factor comes from dynamically weighted Halley steps by QR factorisations. The components go to the tasks in their code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.llm.store import cut, table

#: Components that are returned at most.
COMPONENTS = 8
#: Entries c become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Tasks that fold the partial matrices of all others.
FOLDERS = 16
#: Part of the largest eigenvalue below which a direction counts as one without variance.
LEAST_VARIANCE = 1e-12
#: Entries beyond this size have no exact long of their own.
MOST = 1 << 52

_EPS = np.finfo(float).eps
Batches = Iterator[pa.RecordBatch]


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by dynamically weighted Halley steps, each from a QR factorisation."""
    n = len(a)
    x = a / np.linalg.norm(a)
    r = np.linalg.qr(x, mode="r")
    # 1 / |R^-1| in the Frobenius norm is at most the smallest singular value
    low = max(0.9 / np.linalg.norm(np.linalg.inv(r)), _EPS / 8) if np.abs(np.diag(r)).min() > _EPS / 8 else _EPS / 8
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        u = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, np.eye(n)]))
        y = v / w * x + (u - v / w) / np.sqrt(w) * q[:n] @ q[n:].T
        y = (y + y.T) / 2
        low = min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        done = np.linalg.norm(y - x) <= 1e-15 * n
        x = y
        if done and 1 - low < 1e-14:
            break
    return x


def spectral_split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant spaces of a symmetric matrix for its eigenvalues above and below ``shift``."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return np.eye(n)[:, :rank], np.eye(n)[:, rank:]
    rest, picked = projector.copy(), []
    for _ in range(rank):  # columns that span the space, the longest of what is left first
        k = int(np.argmax((rest**2).sum(0)))
        picked.append(k)
        q = rest[:, k] / np.linalg.norm(rest[:, k])
        rest -= np.outer(q, q @ rest)
    q = np.linalg.qr(projector[:, picked])[0]
    q = np.linalg.qr(projector @ q, mode="complete")[0]
    return q[:, :rank], q[:, rank:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, by spectral divide and conquer."""
    values, vectors = _divided((a + a.T) / 2, _EPS * max(np.linalg.norm(a), 1e-300))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _divided(a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    if n == 1:
        return a[0].copy(), np.eye(1)
    middle = np.trace(a) / n
    off = np.linalg.norm(a - middle * np.eye(n))
    if off <= 4 * n * tiny:  # one eigenvalue, as far as numbers of this size can tell
        return np.diag(a).copy(), np.eye(n)
    # eigenvalues lie on both sides of their mean, and off is at least the distance of the farthest one
    for shift in (float(np.median(np.diag(a))), middle, middle + off / (4 * n), middle - off / (4 * n)):
        above, below = spectral_split(a, shift)
        if above.shape[1] and below.shape[1] and np.linalg.norm(above.T @ a @ below) <= 64 * n * tiny:
            break
    else:
        return _rotated(a)
    parts = [(q, *_divided((q.T @ a @ q + q.T @ a.T @ q) / 2, tiny)) for q in (above, below)]
    return np.concatenate([e for _, e, _ in parts]), np.hstack([q @ v for q, _, v in parts])


def _rotated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi rotations, for a block whose eigenvalues stand too close for any of the shifts."""
    a, v, n = a.copy(), np.eye(len(a)), len(a)
    for _ in range(30):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= _EPS * np.linalg.norm(a):
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if a[i, j]:
                    angle = 0.5 * np.arctan2(2 * a[i, j], a[j, j] - a[i, i])
                    turn = np.eye(n)
                    turn[[i, j], [i, j]] = np.cos(angle)
                    turn[i, j], turn[j, i] = np.sin(angle), -np.sin(angle)
                    a, v = turn.T @ a @ turn, v @ turn
    return np.diag(a).copy(), v


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors without null and non-finite entries, x the entries as longs. Entries whose long would not
    be exact (beyond 2^52) make a vector unusable as well."""
    scaled = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    fits = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < MOST))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & fits).select("vec_id", scaled.alias("x"))


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from the exact n * x - sums."""
    if len(x) and n * int(np.abs(x).max()) < 1 << 61:
        return (n * x - sums) / n
    return np.array([[(n * int(v) - int(s)) / n for v, s in zip(row, sums, strict=True)] for row in x]).reshape(x.shape)


def _folded(rows: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of what ``fold`` makes of each batch, arrays of ``size`` doubles: one for each task, then one for each folder."""

    def each(batches: Batches) -> Batches:
        total = np.zeros(size)
        for b in batches:
            total += fold(b)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def again(batches: Batches) -> Batches:
        total = np.zeros(size)
        for b in batches:
            total += b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    made = rows.mapInArrow(each, "v array<double>").repartition(FOLDERS).mapInArrow(again, "v array<double>").collect()
    return np.sum([np.array(r["v"]) for r in made], axis=0) if made else np.zeros(size)


def _sums(batches: Batches) -> Batches:
    """(d, k, c, s): the vectors of length d that a task has, and the exact sum of their entries k."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        sizes = np.diff(b.column("x").offsets.to_numpy())
        for d in np.unique(sizes).tolist():
            x = _matrix(b.filter(pa.array(sizes == d)), "x", d)
            halves = (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            counts[d], sums[d] = counts.get(d, 0) + len(x), sums.get(d, 0) + halves
    rows = [(d, k, counts[d], Decimal(int(s))) for d in sums for k, s in enumerate(sums[d])]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)))], names=["d", "k", "c", "s"])


def _fit_list(x: DataFrame) -> tuple[int, int, np.ndarray]:
    """The most frequent length of the vectors (ties: the smallest), how many have it, and their exact sums by dimension."""
    sums = cut(x.select("x").mapInArrow(_sums, "d long, k long, c long, s decimal(38,0)"), "vector-sums")
    known = sums.where("k = 0").groupBy("d").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "d").first()
    if not known:
        return 0, 0, np.zeros(0, object)
    rows = sums.where(F.col("d") == known["d"]).groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    return known["d"], known["n"], np.array([int(r["s"]) for r in rows], object)


def whiten(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding) and component: vec_id, component, n, deviation, whitened,
    explained and identity_error.

    Usable are vectors without null, non-finite or inexact entries (see ``usable``) of the most frequent length; all of them
    are the fit list, n in number, repeated rows each for itself. Components without variance are left out, so that one
    vector, or equal ones, give no rows. deviation is null where it exceeds a long. A null vec_id stays null. Other columns
    are not read; no rows, no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = usable(vectors)
    dims, n, exact = _fit_list(x)
    if not n:
        return x.sparkSession.createDataFrame([], schema)
    x = x.where(F.size("x") == dims)
    sums = exact if max(abs(s) for s in exact) >= 1 << 61 else exact.astype(np.int64)

    def products(b: pa.RecordBatch) -> np.ndarray:
        c = _centred(_matrix(b, "x", dims), n, sums)
        return (c.T @ c).ravel()

    covariance = _folded(x, products, dims * dims).reshape(dims, dims) / n
    e, v = eigen(covariance)
    keep = int((e > LEAST_VARIANCE * max(e[0], 0)).sum()) if e[0] > 0 else 0
    keep = min(keep, components)
    if not keep:
        return x.sparkSession.createDataFrame([], schema)
    into = v[:, :keep] / np.sqrt(e[:keep])
    explained = e[:keep] / np.trace(covariance)

    def whitened(b: pa.RecordBatch) -> np.ndarray:
        return _centred(_matrix(b, "x", dims), n, sums) @ into

    mean = _folded(x, lambda b: whitened(b).sum(0), keep) / n

    def again(b: pa.RecordBatch) -> np.ndarray:
        y = whitened(b) - mean
        return (y.T @ y).ravel()

    error = float(np.abs(_folded(x, again, keep * keep).reshape(keep, keep) / n - np.eye(keep)).max())

    def deviation(rows: np.ndarray) -> list[int | None]:
        if n * int(np.abs(rows).max(initial=0)) < 1 << 61:
            far = n * rows - sums
            if dims * float(np.abs(far).max(initial=0)) ** 2 < 1 << 62:
                return (far * far).sum(1).tolist()
        found = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in rows]
        return [d if d < 1 << 63 else None for d in found]

    def rows_of(batches: Batches) -> Batches:
        for b in batches:
            m, y = b.num_rows, whitened(b)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(np.repeat(np.arange(m), keep))), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)), pa.array(np.full(m * keep, n)),
                pa.array(deviation(_matrix(b, "x", dims)), pa.int64()).take(pa.array(np.repeat(np.arange(m), keep))), pa.array(y.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * keep, error))], names=[c.split()[0] for c in schema.split(", ")])

    return x.mapInArrow(rows_of, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
