"""Whitening of embeddings by spectral divide and conquer with polar
decompositions (QDWH).

Components become integers, so the vectors' sums and the centred products that
make up the covariance are exact whatever the partitioning: tasks add them up,
one aggregate sums the tasks' numbers, and the driver sees dimensions x
dimensions of them. There the covariance is taken apart: the polar factor of
the covariance less a shift is the matrix sign, half of it plus the identity
projects on the subspace of the eigenvalues above the shift, and the two
subspaces are treated alike until each holds one component. The polar factor
comes from the QR-based dynamically weighted Halley iteration. The whitening
matrix (dimensions x components) goes with the tasks, which apply it without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvox.llm.common import unused
from sparkvox.llm.dense import floored, slices, usable
from sparkvox.session import ship_package

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Largest integer of a component: sums of its products with itself are exact in pieces.
LIMIT = 1 << 45

_EPS = np.finfo(np.float64).eps
_EXACT = pa.decimal128(38, 0)


# --- the spectral decomposition, on one matrix ---

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, its sign. The weights
    follow a lower bound of the singular values, so that even values near
    rounding come to one in a few steps: steps with large weights go through a
    QR factorisation, the others through a Cholesky factorisation."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    with np.errstate(all="ignore"):
        try:
            least = 1 / np.linalg.norm(np.linalg.inv(x)) / 2
        except np.linalg.LinAlgError:
            least = _EPS
    least = min(max(least if np.isfinite(least) else _EPS, _EPS), 1.0)
    for _ in range(30):
        squared = least * least
        d = np.cbrt(4 * (1 - squared) / (squared * squared))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - squared) / (squared * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            low = np.linalg.cholesky(eye + wc * x.T @ x)
            y = wb / wc * x + (wa - wb / wc) * np.linalg.solve(low.T, np.linalg.solve(low, x.T)).T
        y = (y + y.T) / 2
        moved = np.linalg.norm(y - x)
        x, least = y, min(least * (wa + wb * squared) / (1 + wc * squared), 1.0)
        if moved < 1e-7 and 1 - least < 10 * _EPS * n:  # the iteration is cubic: the next step would not move it
            break
    return x


def _bases(sign: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the two subspaces of a matrix sign; None if one is empty."""
    n = len(sign)
    above = (sign + np.eye(n)) / 2
    k = int(round(float(np.trace(above))))
    if not 0 < k < n:
        return None
    q = np.hstack([above @ rng.standard_normal((n, k)), rng.standard_normal((n, n - k)) - above @ rng.standard_normal((n, n - k))])
    q[:, k:] -= above @ q[:, k:]
    for _ in range(2):  # the second pass leaves only rounding between the subspaces
        q, _ = np.linalg.qr(q)
        q = np.hstack([above @ q[:, :k], q[:, k:] - above @ q[:, k:]])
    q, _ = np.linalg.qr(q)
    return q[:, :k], q[:, k:]


def _divided(a: np.ndarray, norm: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    diagonal = np.diag(a).copy()
    if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= 4 * _EPS * norm:
        return diagonal, np.eye(n)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    best = None
    # Median and mean of the diagonal lie between the extreme eigenvalues. A shift that
    # hits an eigenvalue has no sign there, so the next one is tried.
    for shift in (np.median(diagonal), np.trace(a) / n, *(np.trace(a) / n + spread * f for f in (0.37, -0.41, 0.73, -0.79, 0.05, -0.07))):
        shifted = a - shift * np.eye(n)
        if not np.linalg.norm(shifted) > 4 * _EPS * norm:
            continue
        found = _bases(polar_factor(shifted), rng)
        if found is None:
            continue
        left = np.linalg.norm(found[1].T @ a @ found[0])
        if best is None or left < best[0]:
            best = left, found
        if left <= 8 * n * _EPS * norm:
            break
    if best is None:  # all eigenvalues equal up to rounding
        return diagonal, np.eye(n)
    values, vectors = [], []
    for basis in best[1]:
        part = basis.T @ a @ basis
        e, v = _divided((part + part.T) / 2, norm, rng)
        values.append(e)
        vectors.append(basis @ v)
    return np.concatenate(values), np.hstack(vectors)


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and a correction of nearly right eigenvectors, all in
    extended precision: the nearest orthogonal matrix to first order, then
    first-order perturbation of what is left of it and of the off-diagonal."""
    eye = np.eye(len(a), dtype=np.longdouble)
    x = x + x @ (eye - x.T @ x) / 2
    r = eye - x.T @ x
    s = x.T @ a @ x
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    least = 2 * (np.linalg.norm((s - np.diag(e)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = np.abs(gap) > least
    return e, x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    matrix; of each vector the entry of the largest size is positive."""
    norm = float(np.linalg.norm(a))
    if not len(a) or norm == 0:
        return np.zeros(len(a)), np.eye(len(a))
    # Divided in units of a power of two, so that no size of the numbers matters.
    unit = 2.0 ** np.floor(np.log2(norm))
    _, vectors = _divided(a / unit, norm / unit, np.random.default_rng(0))
    fine, vectors = (a / unit).astype(np.longdouble), vectors.astype(np.longdouble)
    for _ in range(3):
        values, vectors = _refined(fine, vectors)
    vectors = vectors + vectors @ (np.eye(len(a)) - vectors.T @ vectors) / 2
    values, vectors = values.astype(np.float64), vectors.astype(np.float64)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    largest = np.abs(vectors).argmax(axis=0)
    return values[order] * unit, vectors * np.where(vectors[largest, np.arange(len(a))] < 0, -1, 1)


# --- exact sums ---

def _total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if len(x) * LIMIT < 2**62:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y``: by floating-point products where all sums fit into
    53 bits, else in Python's integers."""
    if len(y) * int(np.abs(y).max(initial=0)) ** 2 < 1 << 53:
        f = y.astype(np.float64)
        return np.rint(f.T @ f).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _summed(dims: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            for piece in slices(batch, dims):
                x = floored(piece.column(at), dims, SCALE, LIMIT) + OFFSET
                n += len(x)
                total = [a + b for a, b in zip(total, _total(x), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims), pa.int32()), pa.array([Decimal(t) for t in total], _EXACT),
                 pa.array(np.full(dims, n))], names=["i", "s", "n"])

    return run


def _multiplied(middle: np.ndarray, at: int):
    dims = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        seen = False
        for batch in batches:
            for piece in slices(batch, dims):
                total = total + _products(floored(piece.column(at), dims, SCALE, LIMIT) + OFFSET - middle)
                seen = True
        if seen:
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(p)) for p in total[i, j]], _EXACT)],
                names=["i", "j", "p"])

    return run


@dataclass
class Whitening:
    """``n`` vectors fitted; ``middle`` the integers next to their means and
    ``rest`` the exact sums of what the vectors are off these; eigenvalues,
    eigenvectors (columns) and share of the variance of the components kept."""

    n: int
    middle: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def varies(self) -> np.ndarray:
        """Which components have variance beyond rounding; others cannot be whitened."""
        floor = len(self.middle) * _EPS * max(float(self.values[0]), 0.0) if len(self.values) else 0.0
        return self.values > floor

    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.varies, self.values, np.inf))

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of integers less ``middle``, whitened; 0 in components without variance."""
        shift = np.array([r / self.n for r in self.rest])
        return (y - shift) @ self.matrix()

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S) squared."""
        own = [r.tolist() for r in y]
        if len(self.middle) * int(np.abs(y).max(initial=0)) * max((abs(r) for r in self.rest), default=0) < 1 << 62 \
                and len(self.middle) * int(np.abs(y).max(initial=0)) ** 2 < 1 << 62:
            squares, cross = (y * y).sum(axis=1).tolist(), (y @ np.array(self.rest, np.int64)).tolist()
        else:
            squares = [sum(v * v for v in r) for r in own]
            cross = [sum(v * t for v, t in zip(r, self.rest, strict=True)) for r in own]
        c = sum(t * t for t in self.rest)
        return [self.n * self.n * a - 2 * self.n * b + c for a, b in zip(squares, cross, strict=True)]


def _covered(model: Whitening, at: int):
    """Sums and products of the whitened rows of a task."""
    dims, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for piece in slices(batch, dims):
                w = model.whitened(floored(piece.column(at), dims, SCALE, LIMIT) + OFFSET - model.middle)
                sums += w.sum(axis=0)
                products += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(k)], pa.int32()), pa.array(np.r_[j, np.full(k, -1)], pa.int32()),
             pa.array(np.r_[products[i, j], sums])], names=["i", "j", "s"])

    return run


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors (see `whiten`), at most
    ``components`` of its components. Three aggregates: exact sums, exact
    centred products, and the covariance of the whitened rows, which says how
    far it is from the identity. The driver holds dimensions x dimensions numbers."""
    spark = vectors.sparkSession
    ship_package(spark)
    kept = vectors.where(usable(F.col(vector_col))).select(F.col(vector_col).alias("v"))
    first = kept.first()
    if first is None:
        return Whitening(0, np.zeros(0, np.int64), [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    dims = len(first["v"])
    found = (kept.mapInArrow(_summed(dims, 0), "i int, s decimal(38,0), n long").groupBy("i")
             .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect())
    n, total = found[0]["n"], [int(r["s"]) for r in found]
    middle = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    middle = np.array(middle, np.int64)
    covariance = np.zeros((dims, dims))
    for r in (kept.mapInArrow(_multiplied(middle, 0), "i int, j int, p decimal(38,0)").groupBy("i", "j")
              .agg(F.sum("p").alias("p")).collect()):
        i, j = r["i"], r["j"]
        # n times the products less the sums' product is n * n times the covariance, exactly; one rounding.
        covariance[i, j] = covariance[j, i] = (n * int(r["p"]) - rest[i] * rest[j]) / (n * n)
    values, every = spectrum(covariance)
    k, trace = min(components, dims), float(np.trace(covariance))
    model = Whitening(n, middle, rest, values[:k], every[:, :k], values[:k] / trace if trace else np.zeros(k))
    sums, products = np.zeros(k), np.zeros((k, k))
    for r in (kept.mapInArrow(_covered(model, 0), "i int, j int, s double").groupBy("i", "j")
              .agg(F.sum("s").alias("s")).collect()):
        if r["j"] < 0:
            sums[r["i"]] = r["s"]
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["s"]
    off = products / n - np.outer(sums / n, sums / n) - np.diag(model.varies.astype(float))
    model.identity_error = float(np.abs(off).max(initial=0))
    return model


def _whitened(model: Whitening, at: int, names: list[str]):
    dims, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, dims):
                y = floored(piece.column(at), dims, SCALE, LIMIT) + OFFSET - model.middle
                w = model.whitened(y)
                flat = pa.array(w.ravel(), mask=~np.tile(model.varies, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
                deviation = pa.array([Decimal(d) for d in model.deviations(y)], _EXACT)
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(piece.columns) if i != at), lists, deviation], names=names)

    return run


def whiten(vectors: DataFrame, model: Whitening, *, vector_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``whitened`` (an array, one number a
    component) and ``deviation`` (decimal, exact) in place of the vector.

    Usable: not null, not empty, all entries finite numbers; other rows go. A
    component whose eigenvalue is nil up to rounding (constant or dependent
    dimensions, a single vector) cannot be whitened: it is null. Repeated rows
    count and stay as often as they occur. Equal eigenvalues have any
    orthonormal basis of theirs, the same for all rows. Other columns pass
    through; where one is named like an added column, the added one gets
    underscores. An empty table stays empty. Vectors of different lengths are
    errors, as are entries beyond 5e11."""
    ship_package(vectors.sparkSession)
    at = vectors.columns.index(vector_col)
    rest = [f for k, f in enumerate(vectors.schema.fields) if k != at]
    white, deviation = unused(vectors.drop(vector_col), "whitened", "deviation")
    schema = T.StructType([*rest, T.StructField(white, T.ArrayType(T.DoubleType())),
                           T.StructField(deviation, T.DecimalType(38, 0))])
    return vectors.where(usable(F.col(vector_col))).mapInArrow(_whitened(model, at, schema.names), schema)


def components(rows: DataFrame, model: Whitening, *, id_col: str = "vec_id") -> DataFrame:
    """A row per vector and component: the id, ``component`` (from 1), ``n``,
    ``deviation`` as long (an error where it does not fit), ``whitened``,
    ``explained`` and ``identity_error``. A narrow ``posexplode``."""
    share = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.explained) else F.lit(None).cast("array<double>")
    return (rows.select(F.col(id_col), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
            .select(id_col, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
