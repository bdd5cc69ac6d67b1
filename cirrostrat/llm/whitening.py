"""Whitening of embeddings: Welford moments of the distinct vectors, merged by the parallel update formula, and a symmetric QR eigen-solve.

Each task streams its distinct vectors and updates a mean and a matrix of centred products by one rank-one term a vector.
Vectors are whole numbers, so each task subtracts its first vector exactly and streams small differences, whatever offset they
share. The states of the partitions meet in a reduction tree, ``FAN`` at a time; one state a length of vector reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.runtime import discard, materialize

#: States that one task merges; the farthest that ``scale`` times an entry is told apart; bytes of projections that tasks hold at once.
FAN, FAR, HELD_BYTES = 32, float(1 << 60), 1 << 26
_LONG = (1 << 63) - 1
_STATE = "dims int, part int, n long, base array<long>, total array<decimal(38,0)>, mean array<double>, m2 array<double>"


def whole_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): entries c become ``floor(scale * c) + offset``. Vectors null, empty or holding null or non-finite entries go; null ids stay."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(FAR)), F.lit(-FAR))) + F.lit(offset).cast("long"))
    return vectors.where((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(False))).select("vec_id", x.alias("x"))


class Moments:
    """Count, mean and centred products of vectors, relative to a ``base`` that is subtracted exactly."""

    def __init__(self, base: np.ndarray):
        d = len(base)
        self.n, self.base, self.total = 0, base, [0] * d
        self.mean, self.m2 = np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update a row."""
        if rows.dtype.kind == "i":
            safe = len(rows) * int(max(abs(int(rows.max())), abs(int(rows.min())))) < 1 << 62
            self.total = [t + int(s) for t, s in zip(self.total, (rows if safe else rows.astype(object)).sum(axis=0), strict=True)]
        for row in (rows - self.base).astype(np.float64):
            self.n += 1
            away = row - self.mean
            self.mean += away / self.n
            self.m2 += np.outer(away, row - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel update: products within both, and one rank-one term for the distance of their means."""
        n = self.n + other.n
        away = (other.base - self.base).astype(np.float64) + (other.mean - self.mean)
        self.m2 += other.m2 + np.outer(away, away) * (self.n * other.n / n)
        self.mean += away * (other.n / n)
        self.total = [a + b for a, b in zip(self.total, other.total, strict=True)]
        self.n = n

    def covariance(self) -> np.ndarray:
        c = self.m2 / self.n
        return (c + c.T) / 2


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: Householder reduction, then implicit QR steps with Wilkinson's shift.

    The largest entry of each vector is positive.
    """
    d, size = len(a), float(np.abs(a).max(initial=0)) or 1.0
    a, q = a / size, np.eye(d)  # q holds vectors as rows
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += math.copysign(length, x[0])
        x /= np.linalg.norm(x)
        part = a[k + 1 :, k:]
        part -= 2 * np.outer(x, x @ part)
        part = a[k:, k + 1 :]
        part -= 2 * np.outer(part @ x, x)
        q[k + 1 :] -= 2 * np.outer(x, x @ q[k + 1 :])
    diag, off = np.diag(a).copy(), np.diag(a, 1).copy()
    hi = d - 1
    while hi > 0:
        small = np.abs(off) <= np.finfo(float).eps * (np.abs(diag[:-1]) + np.abs(diag[1:]))
        off[small] = 0.0
        if off[hi - 1] == 0:
            hi -= 1
            continue
        zeros = np.flatnonzero(off[: hi - 1] == 0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half, tail = (diag[hi - 1] - diag[hi]) / 2, off[hi - 1]
        shift = diag[hi] - tail * tail / (half + math.copysign(math.hypot(half, tail), half))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            p, o, e = diag[k], off[k], diag[k + 1]
            diag[k] = c * c * p + 2 * c * s * o + s * s * e
            diag[k + 1] = s * s * p - 2 * c * s * o + c * c * e
            off[k] = (c * c - s * s) * o + c * s * (e - p)
            if k + 1 < hi:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    turn = np.argsort(-diag, kind="stable")
    vectors = q[turn].T
    if d:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return diag[turn] * size, vectors


@dataclass(frozen=True)
class Whitener:
    """What one length of vector is projected by."""

    n: int
    total: list[int]
    axes: np.ndarray  # columns: components
    values: np.ndarray
    trace: float

    @staticmethod
    def of(m: Moments, components: int) -> Whitener:
        v = m.covariance()
        values, axes = symmetric_qr(v)
        return Whitener(m.n, m.total, axes[:, :components], values[:components], float(np.trace(v)))

    def positive(self) -> np.ndarray:
        """Components whose eigenvalue is told from 0 in doubles."""
        return self.values > max(float(self.values[0]), 0.0) * len(self.total) * 8 * np.finfo(float).eps

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in whole numbers: of 64 bits where they hold it, else of any size."""
        far = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.total))
        kind = np.int64 if far < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.total, dtype=kind)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        good = self.positive()
        return ((self.away(x) / self.n).astype(np.float64) @ self.axes) / np.sqrt(np.where(good, self.values, np.inf))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``away``, exact; None beyond 64 bits."""
        away = self.away(x)
        if away.dtype == np.int64 and (not away.size or int(np.abs(away).max()) ** 2 * away.shape[1] <= _LONG):
            return (away * away).sum(axis=1).tolist()
        return [s if (s := sum(int(c) ** 2 for c in row)) <= _LONG else None for row in away.tolist()]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[at[rows][:, None] + np.arange(d)]


def _states(found: dict[int, Moments], part: int) -> Iterator[pa.RecordBatch]:
    for d, m in found.items():
        row = {"dims": d, "part": part, "n": m.n, "base": m.base.astype(np.int64).tolist(), "total": m.total, "mean": m.mean.tolist(), "m2": m.m2.ravel().tolist()}
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _state(row: dict) -> Moments:
    m = Moments(np.array(row["base"], np.int64))
    m.n, m.total, m.mean = row["n"], [int(t) for t in row["total"]], np.array(row["mean"], float)
    m.m2 = np.array(row["m2"], float).reshape(len(m.mean), -1)
    return m


def _moments(whiteners: dict[int, Whitener] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                base = x[0]
                if whiteners is not None:
                    x = whiteners[d].whiten(x)
                    base = np.zeros(x.shape[1], np.int64)
                if d not in found:
                    found[d] = Moments(base)
                found[d].add(x)
        yield from _states(found, TaskContext.get().partitionId())

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    first = _state(rows[0])
    for row in rows[1:]:
        first.merge(_state(row))
    return pa.Table.from_batches(_states({rows[0]["dims"]: first}, rows[0]["part"] // FAN))


def moments(fit: DataFrame, whiteners: dict[int, Whitener] | None = None) -> dict[int, Moments]:
    """Moments of the vectors ``x`` (of what they are whitened to, if so) for each length, through a tree of merges."""
    states = materialize(fit.select("x").mapInArrow(_moments(whiteners), _STATE), "moments")
    while (states.agg(F.max("part")).first()[0] or 0) > 0:
        up = materialize(states.groupBy("dims", F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(_merged, _STATE), "moments")
        discard(states)
        states = up
    found = {r["dims"]: _state(r.asDict()) for r in states.toLocalIterator()}
    discard(states)
    return found


def _project(whiteners: dict[int, tuple[Whitener, float | None]], keep: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch.column(1)):
                w, error = whiteners[d]
                k, good = len(w.values), w.positive()
                white, mask = w.whiten(x).ravel(), np.tile(~good, len(rows))
                share = np.tile(w.values / w.trace if w.trace > 0 else np.zeros(k), len(rows))
                n = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))).cast(keep), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(n, w.n)),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(white, mask=mask), pa.array(np.maximum(share, 0.0)),
                        pa.array([error] * n, pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitened entries of every usable vector (``whole_vectors``): vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit list holds each distinct vector once; ``n``, the mean S/n, the covariance (divisor n) and the components come from it. Components
    run from 1 by falling eigenvalue, up to ``components`` or the length of the vectors. ``deviation``: the sum over dimensions of (n*x-S)^2, null
    beyond 64 bits. ``identity_error``: the largest absolute entry of the whitened fit list's covariance minus the identity, measured
    by a second stream over it. Components without variance have null ``whitened`` (explained 0) and do not count in identity_error, which is
    null if there are no others. Vectors of different lengths are whitened apart. Entries beyond 2**60 / scale count as that.
    Repeated rows and null ids each have their rows; an empty table gives none. Other columns are not read.
    """
    x = whole_vectors(vectors, scale, offset)
    fit = materialize(x.select("x").distinct(), "fit-vectors")
    whiteners = {d: Whitener.of(m, components) for d, m in moments(fit).items()}
    errors: dict[int, float | None] = {}
    for held in _portions(whiteners):
        part = fit if len(held) == len(whiteners) else fit.where(F.size("x").isin(list(held)))
        for d, m in moments(part, held).items():
            good = held[d].positive()
            off = np.abs(m.covariance() - np.eye(len(good)))[np.ix_(good, good)]
            errors[d] = float(off.max()) if good.any() else None
    discard(fit)
    id_type = vectors.schema["vec_id"].dataType
    schema = f"vec_id {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    keep = _arrow(vectors)
    outs = []
    for held in _portions(whiteners) or [{}]:
        part = x if len(held) == len(whiteners) else x.where(F.size("x").isin(list(held)))
        outs.append(part.mapInArrow(_project({d: (w, errors[d]) for d, w in held.items()}, keep), schema))
    for more in outs[1:]:
        outs[0] = outs[0].union(more)
    return outs[0]


def _arrow(vectors: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(vectors.schema["vec_id"].dataType)


def _portions(whiteners: dict[int, Whitener]) -> list[dict[int, Whitener]]:
    """The lengths in portions whose projections fit in ``HELD_BYTES``; one portion in all but odd tables."""
    out: list[dict[int, Whitener]] = []
    size = 0
    for d, w in whiteners.items():
        if not out or size + w.axes.nbytes > HELD_BYTES:
            out.append({})
            size = 0
        out[-1][d] = w
        size += w.axes.nbytes
    return out
