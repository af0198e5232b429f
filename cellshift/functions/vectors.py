"""Dense-vector arithmetic on ARRAY columns, always accumulated in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    Higher-order functions are interpreted, so a repeated or nested expression
    would be computed again at every use; binding it as a lambda variable avoids
    that.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def cosine(a, b, eps: float | None = None) -> Column:
    """Cosine similarity; NULL for a zero-norm side unless ``eps`` guards the norm."""
    den = norm(a) * norm(b)
    if eps is not None:
        return dot(a, b) / (den + F.lit(eps))
    return dot(a, b) / F.nullif(den, F.lit(0.0))


def unit(a, floor: float = 1e-6) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return let(n, lambda size: F.transform(col(a), lambda x: x.cast("double") / size))


def subtract(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))


def distance(a, b, metric: str = "cosine") -> Column:
    if metric == "euclidean":
        return norm(subtract(a, b))
    if metric == "manhattan":
        return _sum(F.transform(subtract(a, b), F.abs))
    if metric == "cosine":
        eps = F.lit(1e-8)
        return F.lit(1.0) - dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
    raise ValueError(f"unknown distance metric: {metric}")


def _by_length(*columns: pa.Array):
    """(rows, one matrix of entries by vectors per column) for each length of vectors; rows with a NULL or with unequal lengths are in none."""
    n = len(columns[0])
    sizes, first, flats, whole = [], [], [], np.ones(n, bool)
    for c in columns:
        size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start = c.flatten(), np.cumsum(size) - size
        whole &= ~c.is_null().to_numpy(zero_copy_only=False)
        if flat.null_count:
            gaps = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
            whole &= gaps[start + size] == gaps[start]
            flat = pc.fill_null(flat, 0)
        sizes.append(size)
        first.append(start)
        flats.append(flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
    for size in sizes[1:]:
        whole &= size == sizes[0]
    for d in np.unique(sizes[0][whole]):
        rows = np.flatnonzero(whole & (sizes[0] == d))
        if len(rows) == n and all(len(flat) == n * d for flat in flats):
            yield rows, [np.ascontiguousarray(flat.reshape(n, d).T) for flat in flats]
        else:
            yield rows, [flat[start[rows] + np.arange(d)[:, None]] for flat, start in zip(flats, first)]


def _total(terms: Callable[[int], np.ndarray], d: int, n: int) -> np.ndarray:
    """Sum over the entries in their order, for all rows at once."""
    out = np.zeros(n)
    for j in range(d):
        out += terms(j)
    return out


def _kernel(of: Callable[..., np.ndarray]):
    """Arrow function of vector columns from one of (entries by vectors) matrices."""

    def run(*columns: pa.Array) -> pa.Array:
        out, known = np.zeros(len(columns[0])), np.zeros(len(columns[0]), bool)
        for rows, matrices in _by_length(*columns):
            with np.errstate(divide="ignore", invalid="ignore"):
                value, fine = of(*matrices)
            out[rows], known[rows] = value, fine
        return pa.array(out, mask=~known)

    return run


def _cosines(a: np.ndarray, b: np.ndarray):
    d, n = a.shape
    den = np.sqrt(_total(lambda j: a[j] * a[j], d, n)) * np.sqrt(_total(lambda j: b[j] * b[j], d, n))
    return _total(lambda j: a[j] * b[j], d, n) / den, den != 0


def _distances(metric: str):
    def of(a: np.ndarray, b: np.ndarray):
        d, n = a.shape
        if metric == "euclidean":
            value = np.sqrt(_total(lambda j: (a[j] - b[j]) * (a[j] - b[j]), d, n))
        elif metric == "manhattan":
            value = _total(lambda j: np.abs(a[j] - b[j]), d, n)
        else:
            na, nb = np.sqrt(_total(lambda j: a[j] * a[j], d, n)), np.sqrt(_total(lambda j: b[j] * b[j], d, n))
            value = 1.0 - _total(lambda j: a[j] * b[j], d, n) / ((na + 1e-8) * (nb + 1e-8))
        return value, True

    return of


def batch_cosine(a, b) -> Column:
    """``cosine`` by Arrow batches: one array operation per entry instead of an interpreted lambda per row and entry."""
    return F.arrow_udf(_kernel(_cosines), "double")(col(a), col(b))


def batch_distance(a, b, metric: str = "cosine") -> Column:
    """``distance`` by Arrow batches."""
    if metric not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"unknown distance metric: {metric}")
    return F.arrow_udf(_kernel(_distances(metric)), "double")(col(a), col(b))
