"""Embedding whitening by a bidiagonal qd solver.

Tasks reduce the centred rows block by block to a triangle (:mod:`hearth.operators.tsqr`).
The triangle is bidiagonalised by Householder reflections, dqds transforms find its
singular values to high relative accuracy, and twisted factorisations of the bidiagonal
recover the directions. A last pass projects every row.

Entries are fixed-point integers, so centring is exact: with ``n`` rows and sums ``S`` the
integer ``n x - S`` is ``n`` times the centred entry, however far the mean lies from zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearth.operators import tsqr

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0 ** 31  # entries whose scaled size is this or more count as not finite
COMPONENTS = 32
EPS = float(np.finfo(float).eps)
TINY = 1e-300
CLUSTER = 1e-3  # neighbouring values within this share of each other are made orthogonal


# --- small dense matrices, on the driver -------------------------------------------------

def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and ``V`` of ``A = U B V^T`` by Householder reflections."""
    a, d = a.copy(), len(a)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        u = x / size
        u[0] += math.copysign(1.0, u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        if (u := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2 and (u := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform; None if the shift is above the least value."""
    qq, ee, d = [], [], q[0] - shift
    for i, x in enumerate(e):
        if not d > 0:
            return None
        y = d + x
        t = q[i + 1] / y
        qq.append(y)
        ee.append(x * t)
        d = d * t - shift
    if not d >= 0:
        return None
    return [*qq, d], ee


def _safe_shift(q: list[float], e: list[float]) -> float:
    """A lower bound of the least eigenvalue: one over the trace of the inverse, which is the
    sum of squares of ``B^-1``, row by row from the last."""
    if min(q) <= 0:
        return 0.0
    total = row = 1 / q[-1]
    for x, y in zip(reversed(q[:-1]), reversed(e)):
        row = (1 + y * row) / x
        total += row
    return 0.999 / total if math.isfinite(total) else 0.0


def singular_values(diag: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an unreduced upper bidiagonal, falling, by dqds with deflation.

    The shift tried first is the lesser eigenvalue of the last 2 x 2 block; where it is
    above the least value, a lower bound from the trace of the inverse takes its place.
    """
    q, e = [float(x) ** 2 for x in diag], [float(x) ** 2 for x in above]
    found, moved = [], 0.0
    while q:
        if len(q) == 1 or e[-1] <= (10 * EPS) ** 2 * (moved + q[-1]):
            found.append(moved + q.pop())
            del e[-1:]
            continue
        small = [i for i in range(len(e)) if e[i] <= (EPS * EPS) * (moved + min(q[i], q[i + 1]))]
        if small:  # the matrix falls apart: the lower part goes on, the upper part for itself
            i = small[-1]
            found += [moved + x for x in _plain(q[:i + 1], e[:i])]
            q, e = q[i + 1:], e[i + 1:]
            continue
        a, b, c = q[-2] + e[-2] if len(e) > 1 else q[-2], q[-1] + e[-1], math.sqrt(q[-2] * e[-1])
        gap = (a - b) / 2
        least = b - c * c / (gap + math.copysign(math.hypot(gap, c), gap)) if c else min(a, b)
        for shift in (min(least, q[-1]) * (1 - 1e-6), _safe_shift(q, e), 0.0):
            made = _dqds(q, e, shift) if shift >= 0 else None
            if made:
                break
        q, e = made
        moved += shift
    return np.sqrt(np.sort(np.array(found))[::-1])


def _plain(q: list[float], e: list[float]) -> list[float]:
    return [float(x) ** 2 for x in singular_values(np.sqrt(q), np.sqrt(e))]


def direction(diag: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The right singular vector of a bidiagonal for one singular value: the twisted
    factorisation of ``B^T B - value^2`` whose pivot is least, solved from the twist outward."""
    m, lam = len(diag), value * value
    d, low = diag * diag, above / diag[:-1]
    plus, s = np.zeros(max(m - 1, 0)), np.zeros(m)
    s[0] = -lam
    for i in range(m - 1):
        piv = s[i] + d[i]
        piv = piv if abs(piv) > TINY else math.copysign(TINY, piv)
        plus[i] = d[i] * low[i] / piv
        s[i + 1] = plus[i] * low[i] * s[i] - lam
    minus, p = np.zeros(max(m - 1, 0)), np.zeros(m)
    p[-1] = d[-1] - lam
    for i in range(m - 2, -1, -1):
        piv = d[i] * low[i] ** 2 + p[i + 1]
        piv = piv if abs(piv) > TINY else math.copysign(TINY, piv)
        minus[i] = low[i] * d[i] / piv
        p[i] = p[i + 1] * d[i] / piv - lam
    with np.errstate(all="ignore"):
        pivot = np.abs(s + p + lam)
    k = int(np.nanargmin(np.where(np.isfinite(pivot), pivot, np.inf)))
    z = np.zeros(m)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, m - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _orthogonal(values: np.ndarray, z: np.ndarray, diag: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Directions of values close together, made orthogonal within their cluster. One that
    the others already span is found again by inverse iteration on what they leave."""
    t = np.diag(diag) + np.diag(above, 1)
    t = t.T @ t
    size = float(values[0]) ** 2
    start = 0
    rng = np.random.default_rng(0)
    for k in range(1, len(values)):
        if values[k - 1] - values[k] > CLUSTER * values[k - 1]:
            start = k
            continue
        near, lam = z[:, start:k], float(values[k]) ** 2

        def apart(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                x = x - near @ (near.T @ x)
                x = x / max(np.linalg.norm(x), TINY)
            return x

        x = z[:, k] - near @ (near.T @ z[:, k])
        lost = np.linalg.norm(x) < 0.5
        x = apart(x)
        if lost or np.linalg.norm(t @ x - lam * x) > 1e-13 * size * len(diag):
            shifted = t - (lam + 4 * EPS * size) * np.eye(len(diag))
            x = apart(rng.normal(size=len(diag)))
            for _ in range(4):
                x = apart(np.linalg.solve(shifted, x))
        z[:, k] = x
    return z


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a square matrix, falling, and its right singular vectors as columns."""
    diag, above, v = bidiagonalise(r)
    scale = max(np.abs(diag).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(r)), v
    diag, above = diag / scale, above / scale
    diag = np.where(np.abs(diag) < EPS, EPS, diag)  # no zero pivot; a change of rounding's size
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS) + 1).tolist(), len(diag)]
    values, vectors = [], []
    for a, b in zip(cuts, cuts[1:]):
        d, u = diag[a:b], above[a:b - 1]
        found = singular_values(d, u)
        z = _orthogonal(found, np.stack([direction(d, u, x) for x in found], axis=1), d, u)
        values.append(found)
        vectors.append(v[:, a:b] @ z)
    values, vectors = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, vectors[:, order]


# --- the table -----------------------------------------------------------------------------

def _fixed(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point entries of the whole vectors, and the mask of their rows."""
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    ok = size == width
    flat = col.filter(pa.array(ok)).flatten()
    c = SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    good = (np.abs(c) < LIMIT).all(axis=1)  # a null is NaN here and fails as well
    at = np.flatnonzero(ok)
    ok[at[~good]] = False
    return np.floor(c[good]).astype(np.int64) + SHIFT, ok


@dataclass
class Whitening:
    """What whitens a table: parameter-sized, whatever the number of rows."""

    n: int
    sums: np.ndarray  # of each dimension, exact
    total: float  # trace of the covariance
    values: np.ndarray  # eigenvalues of the components, falling
    axes: np.ndarray  # a column for each component
    identity_error: float = math.nan

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.total


def _sums(src: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for b in batches:
            x, _ = _fixed(b.column(0), width)
            total += np.append(x.sum(axis=0), len(x))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["part"])

    rows = src.mapInArrow(partial, "part array<bigint>").select(F.posexplode("part").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    found = np.zeros(width + 1, np.int64)
    for r in rows.collect():
        found[r["i"]] = r["x"]
    return int(found[-1]), found[:-1]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all whole vectors of ``df``; None where there is none or no two differ.

    Whole vectors have the length that most vectors have (the least such length on ties) and
    no null or non-finite entry, and none of ``LIMIT / SCALE`` or more. Components whose
    spread is rounding alone are left out, so a table of rank r gives at most r.
    """
    src = df.select(F.col(vector).cast("array<double>").alias("v"))
    size = src.where("size(v) > 0").groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").head()
    if not size:
        return None
    width = size["width"]
    n, sums = _sums(src, width)
    if not n:
        return None
    r = tsqr.collected(tsqr.triangles(src, lambda b: [("all", (n * _fixed(b.column(0), width)[0] - sums) / n)]))
    sigma, axes = right_singular(r)
    keep = int((sigma > 16 * width * EPS * max(sigma[0], TINY)).sum())
    k = min(components, keep)
    if not k:
        return None
    found = Whitening(n, sums, float((r * r).sum() / n), sigma[:k] ** 2 / n, axes[:, :k])

    def whitened(b: pa.RecordBatch):
        w = project(found, _fixed(b.column(0), width)[0])
        yield "all", np.concatenate([np.ones((len(w), 1)), w], axis=1)

    # the triangle of [1 | W] holds that of the centred W behind its first row and column
    t = tsqr.collected(tsqr.triangles(src, whitened))[1:, 1:]
    found.identity_error = float(np.abs(t.T @ t / n - np.eye(k)).max())
    return found


def project(fitted: Whitening, x: np.ndarray) -> np.ndarray:
    return ((fitted.n * x - fitted.sums) / fitted.n) @ (fitted.axes / np.sqrt(fitted.values))


def _deviation(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it is beyond 64 bits."""
    if len(y) and float(np.abs(y).max()) ** 2 * y.shape[1] < 2 ** 62:
        return (y * y).sum(axis=1).tolist()
    sums = [sum(v * v for v in row) for row in y.tolist()]
    return [s if s < 2 ** 63 else None for s in sums]


def transform(df: DataFrame, fitted: Whitening | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(key, deviation, whitened)`` of every whole vector, a whitened entry a component;
    without a fit no rows. Repeated rows and repeated or null keys each give their row."""
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType([T.StructField(key, kind), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType(), False))])
    src = df.select(F.col(key), F.col(vector).cast("array<double>"))
    if fitted is None:
        return src.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = _fixed(b.column(1), len(fitted.sums))
            w = project(fitted, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1)), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)).cast(arrow), pa.array(_deviation(fitted.n * x - fitted.sums), pa.int64()), lists],
                names=schema.names)

    return src.mapInArrow(run, schema)


def components(df: DataFrame, vector: str = "embedding", key: str = "vec_id", limit: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component, with the fit's figures beside it.

    Vectors that are null, of another length, or hold null, non-finite or huge entries give
    no rows, as do tables in which no two vectors differ. Other columns are left out.
    """
    fitted = fit(df, vector, limit)
    share = [float(x) for x in fitted.explained] if fitted else [0.0]
    out = transform(df, fitted, vector, key).select(key, "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select(key, (F.col("i") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"),
                      "deviation", "whitened", F.element_at(F.array(*map(F.lit, share)), F.col("i") + 1).alias("explained"),
                      F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"))
