"""Whitening of vectors by an incremental eigendecomposition.

Every partition keeps a spectrum (count, mean, eigenvalues, eigenvectors of the centred scatter) and takes its vectors as
rank-one updates, each solved by the secular equation with deflation. Spectra of partitions are combined, some at a
time, by taking one's eigenpairs as rank-one updates of the other. A distributed Rayleigh-Ritz step over all vectors then
brings the components to double precision, and another pass measures how far the result is from white.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, usual_length

EPS = float(np.finfo(float).eps)
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows with an entry of this size or more have no exact x and take no part; vectors taken at a time; spectra combined in one task.
TOO_LARGE, BLOCK, FAN = 2.0**40, 2048, 16
#: Rayleigh-Ritz steps at most, and the deviation from white that needs no further one.
STEPS, WHITE = 3, 1e-9


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)), one above each of the ascending, distinct d.

    Returns the differences root_i - d_j as a matrix and the roots. Each root is sought as a distance from its nearest pole, by
    the rational interpolation through the two poles about it, with bisection where that leaves the bracket.
    """
    k = len(d)
    reach = rho * z2.sum()
    width = np.r_[d[1:], d[-1] + reach] - d
    last = np.arange(k) == k - 1
    at_mid = 1 + rho * (z2 / (d - d[:, None] - width[:, None] / 2)).sum(1)
    left = (at_mid >= 0) | last
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    poles = d - d[origin][:, None]
    lo = np.where(left, np.where(at_mid >= 0, 0.0, width / 2), -width / 2)
    hi = np.where(left, np.where(at_mid >= 0, width / 2, width), 0.0)
    x = (lo + hi) / 2
    low = np.minimum(np.arange(k), max(k - 2, 0))  # the last root lies above its two poles, the others between them
    below = np.arange(k) <= low[:, None]
    one, two = poles[np.arange(k), low], poles[np.arange(k), np.minimum(low + 1, k - 1)]
    for _ in range(80):
        gap = poles - x[:, None]
        part = rho * z2 / gap
        f = 1 + part.sum(1)
        found = (np.abs(f) <= 4 * EPS * (1 + np.abs(part).sum(1))) | (hi - lo <= 2 * EPS * np.abs(x))
        if found.all():
            break
        lo, hi = np.where(f < 0, x, lo), np.where(f > 0, x, hi)
        slopes = part / gap
        d1, d2, slope = one - x, two - x, slopes.sum(1)
        under = np.where(below, slopes, 0).sum(1)
        a, b, c = (d1 + d2) * f - d1 * d2 * slope, d1 * d2 * f, f - d1 * under - d2 * (slope - under)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            root = np.where(last, -root, root)
            step = np.where((a <= 0) != last, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
            x = np.where(found, x, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return x[:, None] - poles, d[origin] + x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of ``vectors diag(values) vectors' + rho v v'`` for ascending ``values`` and rho > 0.

    Deflation: pairs that v hardly touches stay as they are, and of (nearly) equal eigenvalues v is rotated into one. What is
    left is solved by the secular equation; its eigenvectors come from the weights that fit the computed roots exactly, so that they stay
    orthogonal.
    """
    z = vectors.T @ v
    size = np.sqrt(z @ z)
    if rho * size * size == 0:
        return values, vectors
    tolerance = 8 * EPS * max(np.abs(values).max(), rho * size * size)
    touched = np.flatnonzero(rho * np.abs(z) * size > tolerance)
    if len(touched) == 0:
        return values, vectors
    vectors = vectors.copy()
    d = values[touched]
    if len(touched) > 1 and (np.diff(d) * np.abs(z[touched[:-1]] * z[touched[1:]]) <= tolerance * (z[touched[:-1]] ** 2 + z[touched[1:]] ** 2)).any():
        kept, i = [], touched[0]
        for j in touched[1:]:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if (values[j] - values[i]) * abs(c * s) <= tolerance:
                vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
                z[i], z[j] = 0.0, r
            else:
                kept.append(i)
            i = j
        touched = np.array([*kept, i])
        d = values[touched]
    apart, roots = secular_roots(d, z[touched] ** 2, rho)
    gaps = d[:, None] - d
    np.fill_diagonal(gaps, 1.0)
    weight = np.sqrt(np.abs(np.prod(apart / gaps, axis=0) / rho)) * np.where(z[touched] < 0, -1.0, 1.0)
    w = weight / apart
    w /= np.sqrt((w * w).sum(1, keepdims=True))
    vectors[:, touched] = vectors[:, touched] @ w.T
    values = values.copy()
    values[touched] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, sums of x, mean of x - SHIFT, and eigenpairs of the centred scatter."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, np.int64), np.zeros(dim), np.zeros(dim), np.eye(dim))

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """The update by which two centred scatters become one about the joint mean."""
        both = self.n + n
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, mean - self.mean, self.n * n / both)
        self.mean = self.mean + (mean - self.mean) * (n / both)
        self.n = both

    def add(self, x: np.ndarray) -> None:
        """Takes rows: those of a block are first folded into at most as many rows as there are dimensions, of the same scatter."""
        y = (x - SHIFT).astype(float)
        mean = y.mean(0)
        for row in np.linalg.qr(y - mean, mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, row, 1.0)
        self._shift(len(x), mean)
        self.sums = self.sums + x.sum(0)

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self._shift(other.n, other.mean)
        self.sums = self.sums + other.sums


@dataclass
class Whitening:
    """What is fitted: rows, sums of x, components as columns by falling eigenvalue (their variances in ``values``), the
    trace of the covariance, and the measured deviation from white of the first ``kept`` components."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    kept: int
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean, from exact integers."""
        return (self.n * (x - SHIFT) - (self.sums - self.n * SHIFT)) / self.n

    @property
    def live(self) -> np.ndarray:
        """Which of the kept components have variance beyond rounding."""
        e = self.values[: self.kept]
        return e > len(self.values) * EPS * max(self.values[0], 0.0) if len(e) else np.zeros(0, bool)

    def white(self, x: np.ndarray) -> np.ndarray:
        """Rows by kept components; NaN where a component has no variance."""
        scale = np.where(self.live, np.sqrt(np.maximum(self.values[: self.kept], EPS**4)), np.nan)
        return self.centred(x) @ self.vectors[:, : self.kept] / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - sums)^2) of each row, exact; None beyond 64 bits."""
        rough = self.centred(x) * float(self.n)
        fits = (rough * rough).sum(1) < 9.2e18
        y = np.where(fits[:, None], self.n * (x - SHIFT) - (self.sums - self.n * SHIFT), 0)
        return [int(s) if ok else None for s, ok in zip((y * y).sum(1), fits)]


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows whose vector is neither null nor empty and holds no null, non-finite or too large entry."""
    fine = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists of floats -> rows of x."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def gathered(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value out of ``parts(part, data binary)``: ``FAN`` neighbours at a time are combined in a task, round by round."""
    parts = checkpointed(parts)
    top = parts.agg(F.max("part")).first()[0]

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "data": [combine([bytes(b) for b in frame.sort_values("part")["data"]])]})

    while top:
        parts = parts.groupBy(F.expr(f"part div {FAN}").alias("part")).applyInPandas(one, "part long, data binary")
        top //= FAN
    row = parts.first()
    return bytes(row["data"]) if row else None


def _sum(parts: list[bytes]) -> bytes:
    return sum(np.frombuffer(b) for b in parts).tobytes()


def _partials(vectors: DataFrame, dim: int, of: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """(part, data) with ``of(blocks of x)`` of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (x[at : at + BLOCK] for b in batches if b.num_rows for x in [integers(b.column(0), dim)] for at in range(0, len(x), BLOCK))
        data = of(blocks)
        if data is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "data": pa.array([data], pa.binary())})

    return vectors.select("v").mapInArrow(run, "part long, data binary")


def _packed(s: Spectrum) -> bytes:
    return np.r_[np.array([s.n], np.int64).view(float), s.sums.view(float), s.mean, s.values, s.vectors.ravel()].tobytes()


def _unpacked(data: bytes, dim: int) -> Spectrum:
    a = np.frombuffer(data)
    n, sums, mean, values, vectors = np.split(a, np.cumsum([1, dim, dim, dim]))
    return Spectrum(int(n.view(np.int64)[0]), sums.view(np.int64), mean, values, vectors.reshape(dim, dim))


def spectrum(vectors: DataFrame, dim: int) -> Spectrum | None:
    """The spectrum of all ``vectors(v)`` by rank-one updates in partitions and between them; None without rows."""

    def of(blocks: Iterator[np.ndarray]) -> bytes | None:
        s = Spectrum.empty(dim)
        for x in blocks:
            s.add(x)
        return _packed(s) if s.n else None

    def combine(parts: list[bytes]) -> bytes:
        first, *others = (_unpacked(b, dim) for b in parts)
        for s in others:
            first.combine(s)
        return _packed(first)

    data = gathered(_partials(vectors, dim, of), combine)
    return _unpacked(data, dim) if data else None


def fit(vectors: DataFrame, dim: int, components: int) -> Whitening | None:
    """Fits ``vectors(v)`` of length ``dim``: spectrum, then Rayleigh-Ritz steps over all rows until the measured result is white."""
    s = spectrum(vectors, dim)
    if s is None:
        return None
    basis = np.linalg.qr(s.vectors)[0]
    done = Whitening(s.n, s.sums, np.zeros(dim), basis, 0.0, min(components, dim), None)
    for _ in range(STEPS):
        done.vectors = np.linalg.qr(done.vectors)[0]

        def projected(blocks: Iterator[np.ndarray], w: Whitening = done) -> bytes:
            total = np.zeros((dim, dim))
            for x in blocks:
                y = w.centred(x) @ w.vectors
                total += y.T @ y
            return total.tobytes()

        h = np.frombuffer(gathered(_partials(vectors, dim, projected), _sum)).reshape(dim, dim) / s.n
        e, turn = np.linalg.eigh((h + h.T) / 2)
        done = Whitening(s.n, s.sums, np.maximum(e[::-1], 0.0), done.vectors @ turn[:, ::-1], float(np.trace(h)), done.kept, None)
        live = np.flatnonzero(done.live)
        if not len(live):
            break

        def whitened(blocks: Iterator[np.ndarray], w: Whitening = done, live: np.ndarray = live) -> bytes:
            total = np.zeros((len(live) + 1, len(live) + 1))
            for x in blocks:
                z = np.c_[np.ones(len(x)), w.white(x)[:, live]]
                total += z.T @ z
            return total.tobytes()

        m = np.frombuffer(gathered(_partials(vectors, dim, whitened), _sum)).reshape(len(live) + 1, -1) / s.n
        done.identity_error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(live))).max())
        if done.identity_error <= WHITE:
            break
    return done


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for every usable vector and component.

    Left out are rows whose vector is null or empty, holds null or non-finite entries or one of 2^40 or more, or hasn't the
    commonest length (the larger of equally common ones); without any row left the result is empty. Repeated rows and equal or null ids count and are
    returned each. Vectors of fewer dimensions than ``components`` have as many components as dimensions. A component without variance has a
    null ``whitened`` (with a single row or equal rows all have; then ``explained`` is 0 and ``identity_error`` null), and a
    ``deviation`` that exceeds 64 bits is null. Other columns don't matter, whatever their names.

    What reaches the driver or one task are spectra and sums of dim x dim cells, ``FAN`` of them at a time.
    """
    usable = usable_vectors(df, id_col, vec_col)
    dim = usual_length(usable)
    usable = usable.where(F.size("v") == dim)
    id_type = usable.schema["id"].dataType.simpleString()
    columns = f"id {id_type}, deviation long, w array<double>"
    fitted = fit(usable, dim, components) if dim else None
    if fitted is None:
        made = df.sparkSession.createDataFrame([], columns)
        n, shares, error = 0, [], None
    else:
        n, error = fitted.n, fitted.identity_error
        shares = [float(e / fitted.trace) if fitted.trace > 0 else 0.0 for e in fitted.values[: fitted.kept]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    x = integers(part.column(1), dim)
                    w = fitted.white(x)
                    values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * fitted.kept, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fitted.deviation(x), pa.int64()), lists], ["id", "deviation", "w"])

        made = usable.mapInArrow(run, columns)
    rows = made.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.lit(shares).cast("array<double>") if shares else F.array().cast("array<double>"), F.col("at") + 1)
    return rows.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
