"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Each step multiplies the centred row matrix X by a right vector and its transpose by a left vector, both as sums over
row blocks in Spark tasks, and reorthogonalises fully on both sides. A left vector has one entry per row and is never
gathered: all left vectors are combinations X w of the rows with short coefficient vectors w, so a task computes its
own entries. The driver holds vectors of the dimension only; the singular values of the small bidiagonal matrix give
the deviations and its right singular vectors the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructType

from .columns import fresh, without
from .store import stored

BLOCK_ROWS = 4096
DIRECT_TASKS = 64  # beyond this many blocks partial sums are added up in Spark before the driver takes them
LARGEST = 2.0**40  # entries beyond raise: the integers made from them have to stay exact
BREAKDOWN = 1e-10  # a new direction this small against the largest singular value counts as none


class Whitening(NamedTuple):
    """What ``fit`` learns: everything ``whitened`` needs, of the size of dimension x components."""

    n: int
    sums: np.ndarray  # exact sum of each dimension's integers
    components: np.ndarray  # (components, dimension), unit rows
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of every entry."""
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"vector entries beyond {LARGEST:g} can't be summed exactly")
    return np.floor(64.0 * values).astype(np.int64) + 1_000_000


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole: not NULL, without NULL or non-finite entries, of the table's largest dimension.

    A shorter vector lacks entries, which counts as holding NULL; so do vectors of no entries at all.
    """
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = df.where(c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)))
    size = good.agg(F.max(F.size(c))).first()[0]
    return good.where(F.size(c) == F.lit(size or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return integers(flat).reshape(len(column), -1 if len(flat) else 0)


def row_blocks(df: DataFrame, vector: str) -> DataFrame:
    """The vectors' integers as blocks (rows, x): x is a row-major matrix of 64-bit integers. Stored once, read by each step."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                x = _matrix(b.column(0).slice(at, BLOCK_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["rows", "x"])

    return df.select(vector).mapInArrow(block, "rows long, x binary")


def _sum_blocks(blocks: DataFrame, step: Callable[[np.ndarray], np.ndarray], kind: type, many: bool) -> np.ndarray | None:
    """Sum of ``step(integers of a block)`` over all blocks: a task sends one array; ``many`` tasks are added up in Spark first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for rows, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if rows:
                    s = step(np.frombuffer(raw.as_buffer(), np.int64).reshape(rows, -1))
                    total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0):
                s = np.frombuffer(raw.as_buffer(), kind)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = blocks.mapInArrow(part, "s binary")
    if many:
        parts = parts.repartition(DIRECT_TASKS).mapInArrow(add, "s binary")
    rows = [np.frombuffer(r.s, kind) for r in parts.collect()]  # one array of a model's size from each task
    return np.sum(rows, axis=0) if rows else None


def _random_direction(draw: np.random.Generator, taken: list[np.ndarray], dim: int) -> np.ndarray:
    v = draw.standard_normal(dim)
    for _ in range(2):
        for q in taken:
            v -= q * (q @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], dim: int, wanted: int, seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values (falling) and right singular vectors (rows) of a matrix X known by products.

    ``product(t, W)`` returns (Uᵀp, pᵀp, Xᵀp) for p = X t and the left vectors U = X W. With X V = U B, B upper
    bidiagonal, each new left vector is X v less its parts along all earlier ones (twice), each new right vector Xᵀ u
    less its parts along all earlier ones (twice). A direction that ends the Krylov space is followed by a random one
    orthogonal to all before, so equal singular values are all found. It ends after ``dim`` steps, or when the wanted
    values have converged, a random restart was run for as many steps, and they have converged to the same again.
    """
    draw = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    left = np.zeros((dim, 0))  # W: the left vectors are X W
    images = np.zeros((dim, 0))  # Xᵀ U
    alphas: list[float] = []
    betas: list[float] = []
    v, confirmed, restarted = _random_direction(draw, [], dim), None, 0
    while True:
        right.append(v)
        t = v - left @ (images.T @ v)  # X t is X v without its parts along U, by Uᵀ X v = (Xᵀ U)ᵀ v
        along, square, image = product(t, left)
        t, image = t - left @ along, image - images @ along
        scale = max(alphas, default=0.0)
        alpha = float(np.sqrt(max(square - along @ along, 0.0)))
        if alpha <= BREAKDOWN * scale or alpha == 0.0:
            alpha, t, image = 0.0, np.zeros(dim), np.zeros(dim)
            inverse = 0.0
        else:
            inverse = 1.0 / alpha
        alphas.append(alpha)
        left, images = np.column_stack([left, t * inverse]), np.column_stack([images, image * inverse])
        k = len(right)
        following = images[:, -1] - alpha * v
        for _ in range(2):
            for q in right:
                following -= q * (q @ following)
        beta = float(np.linalg.norm(following))
        if beta <= BREAKDOWN * max(max(alphas), 1e-300):
            beta = 0.0
        upper, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        done = k == dim
        if not done and k >= wanted and np.abs(beta * upper[-1, :wanted]).max() <= 1e-14 * values[0]:
            top = values[:wanted]
            if confirmed is None:
                confirmed, restarted, beta = top, k, 0.0
            elif k - restarted >= wanted:
                done = bool(np.abs(top - confirmed).max() <= 1e-12 * values[0])
                if not done:
                    confirmed, restarted, beta = top, k, 0.0
        if done:
            return values[:wanted], (turned @ np.array(right))[:wanted]
        betas.append(beta)
        v = following / beta if beta else _random_direction(draw, right, dim)


def fit(df: DataFrame, vector: str, components: int, seed: int = 1) -> tuple[Whitening | None, float]:
    """Whitening of all usable rows and the largest entry of |covariance of the whitened rows - identity|.

    Directions without spread have no component. No usable row, or none that differs, gives (None or a model without
    components, 0.0).
    """
    blocks = stored(row_blocks(df, vector), "blocks")
    n = blocks.agg(F.sum("rows")).first()[0]
    if not n:
        return None, 0.0
    many = n > BLOCK_ROWS * DIRECT_TASKS
    sums = _sum_blocks(blocks, lambda x: x.sum(axis=0), np.int64, many)
    dim = len(sums)

    def spread(x: np.ndarray) -> np.ndarray:
        return ((n * x - sums).astype(float) ** 2).sum(axis=0) / (float(n) * n)

    trace = float(_sum_blocks(blocks, spread, np.float64, many).sum()) / n
    if trace == 0.0:
        return Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0), 0.0

    def product(t: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        def step(x: np.ndarray) -> np.ndarray:
            rows = (n * x - sums) / float(n)
            p = rows @ t
            return np.concatenate([(rows @ left).T @ p, [p @ p], rows.T @ p])

        s = _sum_blocks(blocks, step, np.float64, many)
        k = left.shape[1]
        return s[:k], float(s[k]), s[k + 1 :]

    sigma, found = bidiagonalise(product, dim, min(components, dim), seed)
    keep = sigma > BREAKDOWN * sigma[0]
    model = Whitening(n, sums, found[keep], sigma[keep] ** 2 / n, trace)
    size = len(model.values)

    def outer(x: np.ndarray) -> np.ndarray:
        w = _project(n * x - sums, model)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    s = _sum_blocks(blocks, outer, np.float64, many) / n
    mean = s[size * size :]
    covariance = s[: size * size].reshape(size, size) - np.outer(mean, mean)
    return model, float(np.abs(covariance - np.eye(size)).max())


def _project(y: np.ndarray, model: Whitening) -> np.ndarray:
    return (y / float(model.n)) @ model.components.T / np.sqrt(model.values)


def _squares(y: np.ndarray) -> pa.Array:
    """Exact sum of squares of each row as decimal(38, 0)."""
    if len(y) and (y.astype(float) ** 2).sum(axis=1).max() > 9e18:
        return pa.array([sum(int(v) ** 2 for v in row) for row in y]).cast(pa.decimal128(38, 0))
    return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))


def whitened(df: DataFrame, model: Whitening, vector: str) -> DataFrame:
    """``df`` with ``whitened`` (array of doubles, one per component) and ``deviation`` (decimal, n² times the squared
    distance from the mean, exact). Columns of these names are replaced. ``df`` holds usable rows only.
    """
    df = without(df, "whitened", "deviation")
    at = df.columns.index(vector)
    shape = StructType(list(df.schema)).add("whitened", ArrayType(DoubleType())).add("deviation", DecimalType(38, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = model.n * _matrix(b.column(at)) - model.sums
            w = _project(y, model)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel())), _squares(y)], names=shape.names)

    return df.mapInArrow(project, shape)


def whitened_components(df: DataFrame, vector: str = "embedding", components: int = 32, key: str = "vec_id") -> DataFrame:
    """Fit on all usable rows and project them: one row per usable row and component.

    (key, component from 1, n, deviation, whitened, explained, identity_error). Rows whose vector is NULL, holds NULL or a
    non-finite entry, or is shorter than the longest, are left out; repeated rows and NULL keys count as rows of their
    own. No usable rows, or no two different ones, give an empty table.
    """
    good = usable(df.select(key, vector), vector)
    model, error = fit(good, vector, components)
    if model is None:
        model = Whitening(1, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 1.0)
        good = good.limit(0)
    explained = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.values) else F.array().cast("array<double>")
    place = fresh(df, "_i")
    return whitened(good, model, vector).select(
        key, "deviation", F.posexplode("whitened").alias(place, "whitened")).select(
        key, (F.col(place) + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col(place)).alias("explained"), F.lit(error).alias("identity_error"))
