"""Operator 13: whitening of embeddings by QDWH spectral divide-and-conquer.

Vectors become integers, x = floor(scale * c) + shift, so sums and centred products are
exact and don't depend on how Spark deals the rows. The fit list is each distinct x once.
Three passes over it give, as sums that every task makes for its own rows: the sums per
dimension, the covariance V, and last the covariance of the whitened fit list, whose
distance from the identity is reported. What reaches the driver is d x d numbers for
vectors of d dimensions, whatever the number of rows.

V is taken apart on the driver without an eigenvalue routine. The polar factor U of
V - sI (dynamically weighted Halley iterations, each by a QR decomposition) is +1 on the
eigenvectors above s and -1 on those below, so (I + U) / 2 projects onto an invariant
subspace; orthonormal bases of it and of its complement split V into two smaller
matrices, and so on down to single components. They are broadcast with the mean (d x 16
numbers), and every row is projected where it lies.

Cases: vectors that are null or hold null or non-finite entries give no rows; vectors
that can't be in the fit list (another length than the commonest among distinct ones, the
larger of equals; an entry whose x no long holds) keep their rows, with nulls; so does a
component without variance (whitened null, explained 0); ``deviation`` is null where no
long holds it; null and repeated ids keep their rows; equal vectors get equal rows; extra
columns are ignored; an empty table, or one without a vector of a dimension, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lean, prepare, table

EPS = float(np.finfo(float).eps)
LARGEST = (1 << 63) - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x, low = a / np.linalg.norm(a), EPS / 10  # the norm bounds the largest singular value; a bound below the smallest that counts
    for _ in range(12):
        gap = max(0.0, 4 * (1 - low * low)) / low**4
        root = np.sqrt(1 + np.cbrt(gap))
        h = root + np.sqrt(max(0.0, 8 - 4 * np.cbrt(gap) + 8 * (2 - low * low) / (low * low * root))) / 2
        p = (h - 1) ** 2 / 4
        q = h + p - 1
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(q) * x, np.eye(n)]))
        new = p / q * x + (h - p / q) / np.sqrt(q) * (basis[:n] @ basis[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (h + p * low * low) / (1 + q * low * low))
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """An orthonormal basis whose first k vectors span the eigenvectors of ``a`` above ``shift``, and k."""
    n = len(a)
    above = (np.eye(n) + polar(a - shift * np.eye(n))) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < n:
        return np.eye(n), k
    basis = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0]
    for _ in range(2):
        basis, _ = np.linalg.qr(np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]]))
    return basis, k


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by divide-and-conquer over spectral projectors."""
    v = (v + v.T) / 2
    size = np.linalg.norm(v)

    def part(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, own = len(a), np.diagonal(a)
        if n == 1 or np.linalg.norm(a - np.diag(own)) <= EPS * size:  # single, or no difference that double precision tells
            return own.copy(), np.eye(n)
        spread = np.abs(a).sum(axis=1) - np.abs(own)
        low, high, shift = (own - spread).min(), (own + spread).max(), float(np.median(own))
        best, best_left = None, np.inf
        for _ in range(60):
            basis, k = _split(a, shift)
            if 0 < k < n:
                b = basis.T @ a @ basis
                left = np.linalg.norm(b[k:, :k])  # large if an eigenvalue lies at the shift
                if left < best_left:
                    best, best_left = (basis, k, b), left
                if left <= 4 * EPS * n * size:
                    break
                shift += (high - low) * 0.01 * (1 if shift < (low + high) / 2 else -1)
            else:
                low, high = (low, shift) if k == 0 else (shift, high)
                shift = (low + high) / 2
        if best is None:
            return own.copy(), np.eye(n)
        basis, k, b = best
        (e1, q1), (e2, q2) = part((b[:k, :k] + b[:k, :k].T) / 2), part((b[k:, k:] + b[k:, k:].T) / 2)
        return np.concatenate([e1, e2]), np.hstack([basis[:, :k] @ q1, basis[:, k:] @ q2])

    if not len(v) or not size:
        return np.zeros(len(v)), np.eye(len(v))
    _, q = part(v)
    q = np.linalg.qr(q)[0]
    t = q.T @ v @ q  # nearly diagonal: one first-order correction takes the rounding of the recursion out
    e = np.diagonal(t)
    gap = e[None, :] - e[:, None]
    turn = np.where(np.abs(gap) > 1e3 * EPS * size, t / np.where(gap == 0, 1, gap), 0)
    np.fill_diagonal(turn, 0)
    q = np.linalg.qr(q + q @ turn)[0]
    e = np.einsum("ik,ij,jk->k", q, v, q)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    """Per task and dimension: rows, and the sums of the high and low halves of x, each of which a long holds."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    return run


def _products(d: int, of):
    """Per task, the rows of the sum of ``y y'`` over the vectors y that ``of`` makes of each batch, and the sum of y as a last row."""

    def run(batches):
        total = None
        for batch in batches:
            y = of(_matrix(batch.column(0), d))
            part = np.vstack([y.T @ y, y.sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _summed(fit: DataFrame, d: int, width: int, of) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``y y'`` and of y over the fit list."""
    rows = fit.mapInArrow(lean(_products(d, of)), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((width + 1, width))
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["x"].to_numpy()
    return out[:-1], out[-1]


class Whitening:
    """A fitted whitening: integer centre, rest of the mean, components, eigenvalues."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums = n, sums
        self.centre = np.array([round(s / n) if abs(s) < 1 << 53 else s // n for s in sums], dtype=np.int64)
        self.rest = [s - n * c for s, c in zip(sums, self.centre.tolist())]
        self.mean = np.array([r / n for r in self.rest])
        self.values, self.vectors, self.trace = values, vectors, trace
        self.real = values > len(sums) * EPS * trace
        self.scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, values, 1)), 0)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(float) - self.mean

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows; 0 in components without variance."""
        return self.centred(x) @ self.vectors * self.scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - sum)^2; None where no long holds it."""
        y, most = x - self.centre, max((abs(r) for r in self.rest), default=0)
        bound = int(max(abs(int(y.min())), abs(int(y.max())))) * self.n + most if y.size else 0
        if len(self.rest) * bound * bound <= LARGEST:
            return ((self.n * y - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        every = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in y.tolist()]
        return [None if x > LARGEST else x for x in every]


def integers(vectors: DataFrame, *, scale: float = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries; x is null where no long holds an entry."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")
    most = float(1 << 61)
    held = F.forall("v", lambda c: F.abs(c * F.lit(float(scale))) < most)
    return rows.select("vec_id", F.when(held, F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))).alias("x"))


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors x of the commonest length; None if there is none with a dimension."""
    distinct = durable(rows.where("x is not null and size(x) > 0").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    fit = distinct.where(F.size("x") == d)
    sums = fit.mapInArrow(lean(_sums(d)), "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).orderBy("dim").collect()
    n, total = sums[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sums]
    plain = Whitening(n, total, np.zeros(0), np.zeros((d, 0)), 0.0)
    centre, mean = plain.centre, plain.mean
    products, _ = _summed(fit, d, d, lambda x: (x - centre).astype(float))  # whole numbers, exact below 2^53
    v = products / n - np.outer(mean, mean)
    values, vectors = eigen(v)
    out = Whitening(n, total, values[:components], vectors[:, :components], float(np.trace(v)))
    real = out.real
    if real.any():
        shared = rows.sparkSession.sparkContext.broadcast(out)
        again, first = _summed(fit, d, len(real), lambda x: shared.value.apply(x))
        off = (again / n - np.outer(first / n, first / n))[np.ix_(real, real)] - np.eye(int(real.sum()))
        out.identity_error = float(np.abs(off).max())
    return out


def _project(shared):
    def run(batches):
        fitted: Whitening = shared.value
        d, k = len(fitted.sums), len(fitted.values)
        for batch in batches:
            for some in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                sizes = np.array([-1 if x is None else x for x in some.column(2).to_pylist()])
                fine, m = sizes == d, some.num_rows
                x = _matrix(some.column(1).filter(pa.array(fine)), d)
                white, deviation = np.zeros((m, k)), np.full(m, None, dtype=object)
                white[fine] = fitted.apply(x)
                deviation[fine] = fitted.deviation(x)
                mask = np.repeat(~fine, k) | np.tile(~fitted.real, m)
                at = pa.array(np.repeat(np.arange(m), k))
                values = [
                    some.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)), pa.array(deviation.tolist(), pa.int64()).take(at),
                    pa.array(white.ravel(), mask=mask), pa.array(np.tile(np.where(fitted.real, fitted.values / (fitted.trace or 1), 0.0), m)), pa.array(np.full(m * k, fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(values, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def whiten(vectors: DataFrame, *, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """A row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = integers(vectors, id_col=id_col, vector_col=vector_col, **options)
    fitted = fit_whitening(rows, components)
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(fitted)
    return rows.select("vec_id", "x", F.size("x").alias("d")).mapInArrow(lean(_project(shared)), SCHEMA)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
