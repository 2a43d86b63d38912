"""Whitening of embeddings: leading principal components, scaled to unit variance.

Entries become whole numbers, floor(SCALE * c), so that sums and deviations are exact and equal vectors are
equal to the last bit. The fit list holds each distinct vector once.

Steps, each a Spark job over the stored fit list:

1. Sums of each dimension, exactly, as two halves of 32 bits.
2. Covariance: each task centres its rows, multiplies them with themselves and hands on one matrix; matrices are added
   in Spark by row and column. The driver gets dimension**2 numbers, whatever the number of rows.
3. On the driver, over that one matrix: Householder reflections make it tridiagonal, Sturm counts bisect its largest
   eigenvalues, inverse iteration finds their vectors; vectors of a cluster of eigenvalues are made
   orthogonal to one another in every step; reflections take them back.
4. Mean and covariance of the whitened fit list, for the error that is reported.

The projection is broadcast (components * dimension numbers) and every row passes it once, unshuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import store

SCALE = 256
COMPONENTS = 4
#: Eigenvalues nearer to one another than this share of the largest are treated as a cluster.
CLUSTER = 1e-3

_LONG = 1 << 63
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list; components as rows; eigenvalues and their share of the trace, falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None


# Linear algebra of one matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal, and the unit vectors of the Householder reflections."""
    a = matrix.astype(np.float64).copy()
    mirrors = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        length = np.linalg.norm(v)
        if length == 0:
            mirrors.append(np.zeros_like(v))
            continue
        v /= length
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def reflected(vector: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix in the coordinates of the first one."""
    out = vector.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        out[k + 1 :] -= 2 * mirrors[k] * (mirrors[k] @ out[k + 1 :])
    return out


def below(diagonal: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of the shifted matrix (Sturm)."""
    tiny = np.finfo(np.float64).tiny / _EPS
    count = np.zeros(len(at), dtype=np.int64)
    pivot = np.ones(len(at))
    with np.errstate(over="ignore"):  # next to a pivot of almost 0 the next one is infinite, with the right sign
        for k, d in enumerate(diagonal):
            pivot = d - at - (second[k - 1] ** 2 / pivot if k else 0.0)
            pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
            count += pivot < 0
    return count


def largest(diagonal: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected until their bounds are neighbouring numbers."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(second)
    reach[1:] += np.abs(second)
    slack = 4 * _EPS * max(np.abs(diagonal).max() + reach.max(), np.finfo(np.float64).tiny)
    lo = np.full(k, (diagonal - reach).min() - slack)
    hi = np.full(k, (diagonal + reach).max() + slack)
    wanted = n - 1 - np.arange(k)  # eigenvalues below the one that is looked for
    while True:
        mid = lo + (hi - lo) / 2
        open_ = (mid > lo) & (mid < hi) & (hi - lo > slack / 64)
        if not open_.any():
            return mid
        left = below(diagonal, second, mid) > wanted
        hi = np.where(open_ & left, mid, hi)
        lo = np.where(open_ & ~left, mid, lo)


def _solved(diagonal: np.ndarray, second: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """x with (T - shift) x = right, by elimination with row exchanges; pivots are at least ``floor``."""
    n = len(diagonal)
    d, up, up2 = diagonal - shift, np.r_[second, 0.0], np.zeros(n)
    b = right.copy()
    for k in range(n - 1):
        under = second[k]
        if abs(under) > abs(d[k]):
            factor = d[k] / under
            d[k], up[k], up2[k], d[k + 1], up[k + 1] = under, d[k + 1], up[k + 1], up[k] - factor * d[k + 1], -factor * up[k + 1]
            b[k], b[k + 1] = b[k + 1], b[k] - factor * b[k + 1]
        else:
            if abs(d[k]) < floor:
                d[k] = floor
            factor = under / d[k]
            d[k + 1] -= factor * up[k]
            b[k + 1] -= factor * b[k]
    if abs(d[-1]) < floor:
        d[-1] = floor
    x = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - up[k] * x[k + 1] - up2[k] * x[k + 2]) / d[k]
    return x[:n]


def vectors(diagonal: np.ndarray, second: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector, as a row, for each of the falling eigenvalues, by inverse iteration."""
    n, norm = len(diagonal), np.abs(diagonal).max() + 2 * np.abs(second).max(initial=0.0)
    floor = max(_EPS * norm, np.finfo(np.float64).tiny)
    rng = np.random.default_rng(7)
    out, first, before = np.zeros((len(values), n)), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        shift = min(value, before - 4 * floor)  # equal eigenvalues are taken a little apart
        before = shift
        x = rng.standard_normal(n)
        for turn in range(8):
            for other in (*out[first:k], *out[first:k]):  # twice, as one pass leaves rounding errors
                x -= (other @ x) * other
            size = np.linalg.norm(x)
            x = x / size if size else rng.standard_normal(n)
            if turn >= 3 and np.linalg.norm(_times(diagonal, second, x) - value * x) <= 8 * floor:
                break
            x = _solved(diagonal, second, shift, x, floor)
            x /= np.abs(x).max()
        for other in (*out[first:k], *out[first:k]):
            x -= (other @ x) * other
        out[k] = x / np.linalg.norm(x)
    return out


def _times(diagonal: np.ndarray, second: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = diagonal * x
    out[:-1] += second * x[1:]
    out[1:] += second * x[:-1]
    return out


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    diagonal, second, mirrors = tridiagonal(matrix)
    values = largest(diagonal, second, k)
    found = vectors(diagonal, second, values)
    return values, np.array([reflected(v, mirrors) for v in found])


# Jobs


def whole_numbers(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows with ``vector_col`` as ``x``, entries floor(SCALE * c); rows without such a vector are dropped.

    Dropped are null and empty vectors, those with null or non-finite entries, and those of another length than
    most vectors have (of lengths equally frequent: the greater). Entries beyond a long's range are its bounds.
    """
    entry = f"v IS NOT NULL AND NOT isnan(v) AND abs(CAST(v AS DOUBLE)) < CAST('Infinity' AS DOUBLE)"
    good = rows.where(F.expr(f"`{vector_col}` IS NOT NULL AND size(`{vector_col}`) > 0 AND forall(`{vector_col}`, v -> {entry})"))
    size = F.size(vector_col)
    usual = good.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return rows.limit(0).withColumn("x", F.lit(None).cast("array<bigint>"))
    return good.where(size == usual["d"]).withColumn("x", F.expr(f"transform(`{vector_col}`, v -> floor({SCALE}D * CAST(v AS DOUBLE)))"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A row for each list; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's number of rows, and of each dimension the sums of high and low 32 bits."""
    n, high, low = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0), np.int64)
            h, l = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            n, high, low = n + len(x), h if high is None else high + h, l if low is None else low + l
    if n:
        columns = (np.arange(len(high)), np.full(len(high), n), high, low)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "high", "low"])


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n; whole parts are subtracted exactly."""
    whole = np.array([max(-_LONG, min(_LONG - 1, s // n)) for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    if np.abs(x.astype(np.float64)).max(initial=0.0) < 2.0**61:
        return (x - whole).astype(np.float64) - rest
    return x.astype(np.float64) - (whole + rest)


def _products(made: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """A mapInArrow function: the task's sum of outer products of ``made`` rows, as (i, row i)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = made(_matrix(batch.column(0), np.int64))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            lists = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * len(total), total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), lists], names=["i", "row"])

    return multiply


def _covariance(fit_list: DataFrame, made: Callable[[np.ndarray], np.ndarray], n: int, d: int) -> np.ndarray:
    parts = fit_list.mapInArrow(_products(made), "i bigint, row array<double>")
    entries = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for i, j, v in entries.collect():  # d * d of them
        out[i, j] = v
    return (out + out.T) / 2 / n


def _projected(n: int, sums: tuple[int, ...], axes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: _centred(x, n, sums) @ axes.T


def _mean(fit_list: DataFrame, made: Callable[[np.ndarray], np.ndarray], n: int, k: int) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((made(_matrix(b.column(0), np.int64)).sum(axis=0) for b in batches if b.num_rows), np.zeros(k))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], names=["i", "v"])

    sums = fit_list.mapInArrow(add, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k)
    for i, v in sums:
        out[i] = v / n
    return out


def fit(numbers: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows with ``x`` (see ``whole_numbers``); None if there are none.

    Fitted on each distinct ``x`` once, so repeated rows weigh nothing. Equal vectors meet by a shuffle after
    they are combined in their task, so a vector that a third of all rows share is no hot key. Of a
    dimension less than ``k`` there are as many components as dimensions.
    """
    fit_list = store(numbers.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    found = fit_list.mapInArrow(_halves, "i bigint, n bigint, high bigint, low bigint").groupBy("i").agg(
        *(F.sum(c).alias(c) for c in ("n", "high", "low"))
    )
    told = sorted(map(tuple, found.collect()))  # a row for each dimension
    if not told:
        return None
    n, d = told[0][1], len(told)
    sums = tuple((high << 32) + low for _, _, high, low in told)
    matrix = _covariance(fit_list, lambda x: _centred(x, n, sums), n, d)
    trace = float(np.trace(matrix))
    values, axes = principal(matrix, min(k, d))
    # What is left of no variance at all is rounding.
    real = values > d * _EPS * trace if trace > 0 else np.zeros(len(values), dtype=bool)
    error = None
    if real.any():
        scaled = axes[real] / np.sqrt(values[real])[:, None]
        made = _projected(n, sums, scaled)
        middle = _mean(fit_list, made, n, len(scaled))
        spread = _covariance(fit_list, lambda x: made(x) - middle, n, len(scaled))
        error = float(np.abs(spread - np.eye(len(scaled))).max())
    explained = np.where(real, values, 0.0) / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitening(n, sums, axes, np.where(real, values, 0.0), explained, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum of (n * x - S)**2 of each row, exactly; None if it is beyond a long's range."""
    most = n * int(max(abs(int(x.min(initial=0))), int(x.max(initial=0)))) + max(map(abs, sums))
    if x.shape[1] * most * most < _LONG:
        away = n * x - np.array(sums, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    near = (((float(n) * x - np.array(sums, dtype=np.float64)) ** 2).sum(axis=1) < 1.001 * _LONG).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) if fits else _LONG for row, fits in zip(x.tolist(), near, strict=True))
    return [v if v < _LONG else None for v in exact]


def whiten(numbers: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """<id>, component, n, deviation, whitened, explained, identity_error: a row for each row and component.

    Components are numbered from 1. One without variance (as the fit list has too few different vectors) has
    ``whitened`` null and ``explained`` 0, or null if there is no variance at all; ``identity_error`` is that of the others.
    ``deviation`` is null where a long cannot hold it. Without a model the result is empty. Rows that repeat, and null ids, are projected as any other.
    """
    kind = numbers.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        real = model.values > 0
        axes = np.where(real[:, None], model.components / np.sqrt(np.where(real, model.values, 1.0))[:, None], 0.0)
        explained = [None if np.isnan(e) else float(e) for e in model.explained]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), np.int64)
            white = _projected(model.n, model.sums, axes)(x).ravel()
            missing = ~np.tile(real, m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([v for v in deviations(x, model.n, model.sums) for _ in range(k)], type=pa.int64()),
                    pa.array(white, mask=missing),
                    pa.array(explained * m, type=pa.float64()),
                    pa.array([model.identity_error] * (m * k), type=pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = numbers.select(F.col(id_col).alias("id"), "x")
    if model is None:
        rows = rows.limit(0)
    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on ``rows`` and whiten them (``whole_numbers``, ``fit``, ``whiten``). Other columns are not read."""
    kept = rows.select(F.col(id_col).alias("row_id"), F.col(vector_col).alias("row_vector"))
    numbers = whole_numbers(kept, "row_vector")
    return whiten(numbers, fit(numbers), "row_id").withColumnRenamed("row_id", id_col)
