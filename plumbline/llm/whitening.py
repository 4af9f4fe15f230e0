"""Embedding whitening by a bidiagonal qd solver.

Every vector becomes integers, ``floor(256 * c)``; the *fit list* holds each distinct integer vector once. Its centred
rows are reduced to one triangular factor R by QR, block by block within each task and then factor by factor, so that no
task or driver holds more than a few d x d matrices. Householder reflections bring R to bidiagonal form, dqds (the
differential quotient-difference algorithm with shifts) gives the squares of its singular values, and for each of the
leading ones a twisted factorisation of B'B - e I gives the direction. Only d x d matrices are worked on by the driver.

Eigenvalues that coincide leave their directions open; within such a cluster they are made orthogonal by inverse
iteration on the same factorisation. Signs are fixed: the largest entry of a direction is positive.

Defined cases: a null vector, or one that holds a null, NaN or infinite entry, is left out, as is an empty one; rows are
treated one by one, so repeated rows and null ids come out as often as they are given; vectors of different lengths are
an error; a component without variance has a null ``whitened`` and takes no part in ``identity_error``, which is null if
no component has any; without any variance ``explained`` is null too; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, landed, map_arrow

COMPONENTS = 4
SCALE = 256
#: Rows that one QR step adds to a factor.
BLOCK = 4096
#: Factors that one task, or the driver in the end, puts together.
FAN = 32
_EPS = float(np.finfo(np.float64).eps)


class Whitening(NamedTuple):
    """The fitted map: rows of the fit list, sums by dimension, directions by column, eigenvalues, and their total."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def varied(self) -> np.ndarray:
        return self.values > self.trace * len(self.sums) * _EPS

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of the varied components, rows by component."""
        centred = x - self.sums / self.n
        return centred @ self.directions[:, self.varied] / np.sqrt(self.values[self.varied])


# ---- the factor R


def _matrix(lists: pa.Array, kind=np.float64) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), -1)


def _reduced(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def _factor_rows(number: int, factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(factor), pa.int64()), pa.array(list(factor), pa.list_(pa.float64()))], names=["part", "r"])


def triangular(fit_list: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows of ``fit_list(x)``."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        factor = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                factor = _reduced(factor, _matrix(batch.column("x").slice(at, BLOCK)) - mean)
        if factor is not None:
            yield _factor_rows(TaskContext.get().partitionId(), factor)

    def merged(key, table: pa.Table) -> pa.Table:
        factor = None
        for at in range(0, table.num_rows, BLOCK):
            factor = _reduced(factor, _matrix(table.column("r").slice(at, BLOCK)))
        return pa.Table.from_batches([_factor_rows(key[0].as_py(), factor)])

    factors = landed(map_arrow(fit_list.select("x"), first, "part long, r array<double>"), "factors")
    while factors.select("part").distinct().count() > FAN:
        joined = factors.withColumn("part", F.col("part").cast("long") / F.lit(FAN)).withColumn("part", F.floor("part"))
        factors = landed(joined.groupBy("part").applyInArrow(merged, "part long, r array<double>"), "factors")
    rows = factors.orderBy("part").collect()  # at most FAN factors of d rows
    return _reduced(None, np.array([r["r"] for r in rows]))


# ---- bidiagonal form


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U' R W, and the vectors of the reflections that make up W, first one first."""
    rows, d = r.shape
    a = np.vstack([r, np.zeros((max(d - rows, 0), d))])
    turns = []
    for k in range(d):
        v = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        w = np.zeros(d)
        w[k + 1 :] = _reflector(a[k, k + 1 :])
        a[k:, :] -= 2 * np.outer(a[k:, :] @ w, w)
        turns.append(w)
    return np.diag(a)[:d].copy(), np.diag(a, 1)[: d - 1].copy(), turns


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector of the reflection that takes x to a multiple of the first axis; zeros if it is one already."""
    v = x.astype(np.float64)
    if len(v) < 2 or not v[1:].any():
        return np.zeros(len(v))
    v = v / np.abs(v).max()
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


# ---- dqds


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One dqds step, and the place where it became negative (-1: nowhere)."""
    last = len(q) - 1
    new_q, new_e = [0.0] * (last + 1), [0.0] * last
    d = q[0] - shift
    for i in range(last):
        if d < 0:
            return new_q, new_e, i
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    new_q[last] = d
    return new_q, new_e, last if d < 0 else -1


def _pair(q: list[float], e: list[float]) -> tuple[float, float]:
    """Both eigenvalues of a 2 x 2 block, larger first, without cancellation."""
    gap = q[0] + e[0] - q[1]
    high = (q[0] + e[0] + q[1] + (gap * gap + 4 * e[0] * q[1]) ** 0.5) / 2
    return high, (q[0] / high) * q[1] if high else 0.0


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first."""
    norm = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if norm == 0:
        return np.zeros(len(diagonal))
    small, none = _EPS * _EPS, 1e-290  # of a square, beside its neighbour and at all
    todo = [([float(x / norm) ** 2 for x in diagonal], [float(x / norm) ** 2 for x in above], 0.0)]
    found: list[float] = []
    steps = 0
    while todo:
        q, e, moved = todo.pop()
        while True:
            # parts that hang together by nothing are gone through on their own
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= max(small * (moved + q[i + 1]), none)), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            if len(q) == 2:
                found.extend(x + moved for x in _pair(q, e))
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = _pair(q[-2:], e[-1:])[1]
            for _ in range(4):
                new_q, new_e, wrong = _transform(q, e, shift)
                if wrong < 0:
                    break
                # a shift that fails at the very end shows how far it was too large
                shift = max(shift + new_q[-1], 0.0) * (1 - 4 * _EPS) if wrong == len(q) - 1 else shift / 4
            else:
                shift = 0.0
                new_q, new_e, _ = _transform(q, e, 0.0)
            q, e, moved = new_q, new_e, moved + shift
            steps += 1
            if steps > 100 * len(diagonal) + 1000:
                raise ArithmeticError("the singular values do not converge")
    return np.sort(np.maximum(found, 0.0))[::-1] * norm**2


# ---- twisted factorisation


class Twisted:
    """B'B - value I, taken apart from both ends down to the row ``k`` where its pivot is least."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        size = len(diagonal)
        norm = float(max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))) or 1.0
        least = norm * _EPS
        a = np.where(np.abs(diagonal) < least, least, diagonal)
        floor = _EPS * max(value, least * norm)  # what the value itself is uncertain by
        q, low = a * a, np.append(above / a[: len(above)], 0.0)
        down, up = np.zeros(size), np.zeros(size)  # pivots from the top and from the bottom
        self.l, self.u = np.zeros(size), np.zeros(size)
        s = -value
        carried = np.zeros(size)
        for i in range(size):
            carried[i] = s
            down[i] = _away(s + q[i], floor)
            self.l[i] = q[i] * low[i] / down[i]
            s = self.l[i] * low[i] * s - value
        p = _away(q[-1] - value, floor)
        pivot = np.zeros(size)
        pivot[-1] = carried[-1] + q[-1]
        up[-1] = p
        for i in range(size - 2, -1, -1):
            up[i + 1] = _away(q[i] * low[i] ** 2 + p, floor)
            t = q[i] / up[i + 1]
            self.u[i] = low[i] * t
            pivot[i] = carried[i] + t * p
            p = _away(p * t - value, floor)
        self.k = int(np.argmin(np.abs(pivot)))
        self.pivots = np.concatenate([down[: self.k], [_away(pivot[self.k], floor)], up[self.k + 1 :]])

    def _back(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.k - 1, -1, -1):
            z[i] -= self.l[i] * z[i + 1]
        for i in range(self.k, len(z) - 1):
            z[i + 1] -= self.u[i] * z[i]
        return z / np.linalg.norm(z)

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.pivots))
        z[self.k] = 1.0
        return self._back(z)

    def solved(self, c: np.ndarray) -> np.ndarray:
        """The direction of (B'B - value I)^-1 c."""
        c = c.copy()
        for i in range(self.k):
            c[i + 1] -= self.l[i] * c[i]
        for i in range(len(c) - 1, self.k, -1):
            c[i - 1] -= self.u[i - 1] * c[i]
        c /= self.pivots
        return self._back(c / np.abs(c).max())


def _away(x: float, floor: float) -> float:
    return x if abs(x) >= floor else (floor if x >= 0 else -floor)


def leading_directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of R'R and their unit eigenvectors by column."""
    diagonal, above, turns = bidiagonal(r)
    values = singular_squares(diagonal, above)[:count]
    rng = np.random.default_rng(3)
    found = np.zeros((0, len(diagonal)))
    for value in values:
        parts = Twisted(diagonal, above, float(value))
        z = parts.vector()
        if len(found) and np.abs(found @ z).max() > 1e-9:
            z = rng.normal(size=len(z))
            for _ in range(4):
                for _ in range(2):
                    z = z - found.T @ (found @ z)
                z = parts.solved(z)
        for _ in range(2):
            z = z - found.T @ (found @ z)
            z /= np.linalg.norm(z)
        found = np.vstack([found, z])
    directions = found.T
    for w in reversed(turns):
        directions = directions - 2 * np.outer(w, w @ directions)
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(len(values))]
    return values, directions * np.where(largest < 0, -1.0, 1.0)


# ---- the operator


def quantised(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, x)`` of the rows whose vectors are whole."""

    def whole(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    given = rows.select(column(key).cast("long").alias("vec_id"), column(vector).alias("v"))
    given = given.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", whole))
    return given.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))).alias("x"))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct ``x``; None without any."""
    fit_list = landed(vectors.select("x").distinct(), "fit-list")
    by_place = fit_list.select(F.posexplode("x").alias("place", "x")).groupBy("place")
    places = by_place.agg(F.count("*").alias("n"), F.sum("x").alias("total")).orderBy("place").collect()
    if not places:
        return None
    if len({p["n"] for p in places}) > 1:
        raise ValueError("the vectors differ in length")
    n, sums = places[0]["n"], np.array([p["total"] for p in places], np.int64)
    r = triangular(fit_list, sums / n)
    squares, directions = leading_directions(r, min(components, len(sums)))
    fitted = Whitening(n, sums, directions, squares / n, float((r * r).sum() / n))
    return fitted._replace(identity_error=_identity_error(fit_list, fitted))


def _identity_error(fit_list: DataFrame, fitted: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on all its rows."""
    count = int(fitted.varied.sum())
    if not count:
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            w = fitted.whiten(_matrix(batch.column("x")))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], names=["i", "j", "product"])

    sums = map_arrow(fit_list, products, "i long, j long, product double").groupBy("i", "j").agg(F.sum("product").alias("s"))
    table = np.zeros((count + 1, count + 1))
    for row in sums.collect():
        table[row["i"], row["j"]] = row["s"]
    mean = table[:-1, -1] / fitted.n
    return float(np.abs(table[:-1, :-1] / fitted.n - np.outer(mean, mean) - np.eye(count)).max())


def _deviations(x: np.ndarray, fitted: Whitening) -> list[int]:
    """Sum of (n x - S)^2 by row, exactly; beyond 64 bits it is an error."""
    rough = ((x.astype(np.float64) * fitted.n - fitted.sums) ** 2).sum(axis=1)
    if len(rough) == 0 or rough.max() < 2.0**62:
        return ((x * fitted.n - fitted.sums) ** 2).sum(axis=1).tolist()
    sums = fitted.sums.tolist()
    return [sum((fitted.n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each whole vector and leading component, by the fit on the distinct vectors."""
    vectors = quantised(rows, vector, key)
    fitted = fit_whitening(vectors, components)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], _RESULT)
    count = len(fitted.values)
    explained = [float(v) / fitted.trace if fitted.trace else None for v in fitted.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64)
            size = len(x)
            w = np.full((size, count), np.nan)
            w[:, fitted.varied] = fitted.whiten(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(size), count))),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * count, fitted.n)),
                 pa.array(np.repeat(np.array(_deviations(x, fitted), np.int64), count)),
                 pa.array(w.ravel(), from_pandas=True),
                 pa.array(explained * size, pa.float64()),
                 pa.array([fitted.identity_error] * (size * count), pa.float64())],
                names=[f.split(" ")[0] for f in _RESULT.split(", ")])

    return map_arrow(vectors, project, _RESULT)
