"""Embedding whitening by spectral divide and conquer.

Entries become whole numbers x = floor(``scale`` * c).  The fit list is each
distinct x vector once: its exact sums S, then its covariance V (centred
before multiplying, divisor n) are added up over the tasks.  The driver gets V
alone, as many numbers as the dimension squared.

V is split by the polar factor of V - shift I: an iteration of QR and Cholesky
steps with dynamic weights (QDWH) gives the factor U, (U + I) / 2 projects on
the eigenvectors above the shift, and orthonormal bases of its range and of the
rest split V into two smaller problems, until each is one component or a
multiple of the identity.  Only subspaces that hold wanted components are
split.  Mean, components and eigenvalues go to the tasks, which whiten rows.

Defined results: null vectors and those with null or non-finite entries, or
entries too large for a 64-bit whole number, are dropped, as are empty ones and
those whose length isn't the most frequent (the greater of equally frequent
ones).  Repeated rows and null ids each get their rows.  Directions without
variance (to rounding) give no component, so a table of one distinct vector
gives no rows, nor does an empty one.  A deviation beyond 64 bits is an error.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.store import saved

LONG = float(1 << 63)
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- spectrum


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by the QDWH iteration."""
    size = np.linalg.norm(a)
    x, low, eye = a / size, EPS, np.eye(len(a))  # low: below every singular value
    for _ in range(60):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        r = np.sqrt(1 + d)
        wa = r + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * r)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[: len(a)] @ q[len(a) :].T)
        else:
            z = np.linalg.inv(np.linalg.cholesky(eye + wc * (x.T @ x)))
            new = wb / wc * x + (wa - wb / wc) * (x @ z.T @ z)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if low > 1 - 1e-12 and moved < np.cbrt(5 * EPS):
            return x
    return x


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``;
    None if all is on one side or an eigenvalue is too near the shift."""
    n, eye = len(a), np.eye(len(a))
    p = (polar(a - shift * eye) + eye) / 2
    k = int(round(np.trace(p)))
    if not 0 < k < n or np.linalg.norm(p @ p - p) > 1e-8:
        return None
    up = np.linalg.qr(p @ np.linalg.qr(p @ rng.standard_normal((n, k)))[0])[0]
    down = rng.standard_normal((n, n - k))
    for _ in range(3):
        down = np.linalg.qr(down - up @ (up.T @ down))[0]
    return (up, down) if np.linalg.norm(up.T @ a @ down) <= 1e-11 * np.linalg.norm(a) else None


def spectrum(v: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, the
    ``count`` greatest or all, by falling eigenvalue."""
    rng, size, found = np.random.default_rng(0), np.linalg.norm(v), []
    todo = [(v, np.eye(len(v)))]  # the last is the subspace of the greatest eigenvalues
    while todo and (count is None or sum(len(e) for e, _ in found) < count):
        a, basis = todo.pop()
        level = np.trace(a) / len(a)
        if len(a) == 1 or np.linalg.norm(a - level * np.eye(len(a))) <= len(a) * EPS * size:
            found.append((np.full(len(a), level), basis))
            continue
        spread = np.linalg.norm(a - level * np.eye(len(a))) / np.sqrt(len(a))
        shifts = [np.median(np.diag(a)), level, *(level + spread * x for x in (0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.7, -0.7))]
        parts = next((p for s in shifts if (p := split(a, s, rng)) is not None), None)
        if parts is None:
            raise ArithmeticError("no shift splits the spectrum")
        for part in reversed(parts):
            b = part.T @ a @ part
            todo.append(((b + b.T) / 2, basis @ part))
    e, w = np.concatenate([e for e, _ in found]), np.hstack([b for _, b in found])
    order = np.argsort(-e, kind="stable")[:count]
    w = w[:, order]
    return np.einsum("ij,ij->j", w, v @ w), w


# ---------------------------------------------------------------- fit list


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, or null if the vector is to be dropped."""
    times = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    fits = F.forall(times, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LONG)))
    return F.when(F.coalesce(fits, F.lit(False)) & (F.size(vector) > 0), F.transform(times, lambda c: F.floor(c)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(n, S) of the fit list, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                wide = float(np.abs(x.astype(float)).max()) * len(x) >= LONG / 2
                total = [t + int(s) for t, s in zip(total, x.astype(object).sum(0) if wide else x.sum(0))]
                n += len(x)
        if n:
            rows = [(-1, n), *enumerate(total)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([str(s) for _, s in rows])], names=["at", "s"])

    rows = fit.select("x").mapInArrow(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r["at"]: int(r["s"]) for r in rows.collect()}  # a row per dimension
    return by.get(-1, 0), [by[i] for i in range(dims)] if by else []


def covariance(rows: DataFrame, centre: "Centre", n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the centred rows, or of ``weights`` applied to them:
    tasks give products about their own mean, which are moved to the common one."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, m = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                y = centre.of(_matrix(batch.column(0)))
                y = y if weights is None else y @ weights
                own = y.mean(0)
                y -= own
                m, apart = m + y.T @ y, own - mean
                m, mean = m + np.outer(apart, apart) * (count * len(y) / (count + len(y))), mean + apart * (len(y) / (count + len(y)))
                count += len(y)
        if count:
            i, j = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j]), pa.array(mean[i] * count), pa.array(mean[j] * count), pa.array(mean[i] * mean[j] * count)], names=["i", "j", "m", "si", "sj", "sij"])

    parts = rows.select("x").mapInArrow(products, "i int, j int, m double, si double, sj double, sij double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("m", "si", "sj", "sij")))
    out = total.toPandas()  # a row per pair of dimensions
    d = int(out["j"].max()) + 1
    v = np.zeros((d, d))
    i, j = out["i"].to_numpy(), out["j"].to_numpy()
    v[i, j] = v[j, i] = (out["m"] + out["sij"] - out["si"] * out["sj"] / n).to_numpy() / n
    return v


@dataclass(frozen=True)
class Centre:
    n: int
    s: tuple[int, ...]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit where that holds it, else Python's whole numbers."""
        most = max(map(abs, self.s), default=0) + self.n * max(1.0, float(np.abs(x.astype(float)).max(initial=0)))
        if most**2 * max(1, x.shape[1]) < LONG:
            return x * self.n - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    def of(self, x: np.ndarray) -> np.ndarray:
        """x - S / n"""
        return self.apart(x).astype(float) / self.n


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    components: np.ndarray  # columns
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows that stay, written once."""
    x = rows.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), scale).alias("x")).filter("x is not null")
    x = saved(x, "scaled")
    common = x.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dims")).alias("m")).first()["m"]
    return x.filter(F.size("x") == (common["dims"] if common else 0))


def fit(x: DataFrame, count: int | None = 4) -> Whitening | None:
    """The whitening of rows of ``scaled``; None if they don't vary."""
    distinct = saved(x.select("x").distinct(), "fit")
    first = distinct.first()
    if first is None:
        return None
    n, s = sums(distinct, len(first["x"]))
    centre = Centre(n, tuple(s))
    v = covariance(distinct, centre, n)
    trace = float(np.trace(v))
    if not trace > 0:
        return None
    e, w = spectrum(v, count)
    real = e > len(v) * EPS * trace
    e, w = e[real], w[:, real]
    whitened = covariance(distinct, centre, n, w / np.sqrt(e))
    return Whitening(centre, w, e, trace, float(np.abs(whitened - np.eye(len(e))).max()))


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    of every row of ``scaled`` and component."""
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    held = x.sparkSession.sparkContext.broadcast(model)  # dimension times components

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        c, names = len(m.eigenvalues), ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            if not len(batch):
                continue
            apart = m.centre.apart(_matrix(batch.column(1)))
            deviation = (apart * apart).sum(1)
            y = (apart.astype(float) / m.centre.n) @ m.weights
            at = pa.array(np.repeat(np.arange(len(batch)), c))
            columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(at), m.centre.n)), pa.array(deviation.tolist(), pa.int64()).take(at)]
            columns += [pa.array(y.ravel()), pa.array(np.tile(m.eigenvalues / m.trace, len(batch))), pa.array(np.full(len(at), m.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return x.select("vec_id", "x").mapInArrow(rows, schema)
