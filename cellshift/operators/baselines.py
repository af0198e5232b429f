"""Baseline predictors that any model has to beat.

Random choices are hash orders (``stable_hash``): repeatable and independent of
partitioning.  ``sized_by`` may name a cheaper table with the same cells for
counting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even, hash_unit, stable_hash
from .cells import leave_one_area_out
from .demand import largest_remainder
from .ranking import GroupStats, attach_row, group_rank, group_stats, join_small

POS = ("row", "col")


def persistence(cells: DataFrame) -> DataFrame:
    return cells.withColumn("persistence_cls", F.col("start_cls"))


def spatial_shuffle(
    cells: DataFrame, keys: Sequence[str], seed: int, cls: str = "pred_cls", stats: GroupStats | None = None
) -> DataFrame:
    """Permute the labels of an area: grid rank k receives the label of hash rank k."""
    st = stats or group_stats(cells, keys)
    order = stable_hash(seed, *keys, *POS)
    by_grid = group_rank(cells, keys, list(POS), "_k", st)
    by_hash = group_rank(cells.select(*keys, *POS, F.col(cls).alias("shuffled_cls")), keys, [order, *POS], "_k", st)
    return by_grid.join(by_hash.select(*keys, "_k", "shuffled_cls"), [*keys, "_k"]).drop("_k")


def transition_quotas(cells: DataFrame, keys: Sequence[str], counts: DataFrame) -> DataFrame:
    """Cells of each start class to give each end class: floors plus largest remainders.

    ``counts`` is (keys, from_cls, to_cls, n) of the training areas.
    """
    size = cells.groupBy(*keys, F.col("start_cls").alias("from_cls")).agg(F.count(F.lit(1)).alias("total"))
    row = counts.groupBy(*keys, "from_cls").agg(F.sum("n").alias("_t"))
    j = counts.join(row, [*keys, "from_cls"]).join(size, [*keys, "from_cls"])
    exp = j.select(
        *keys, "from_cls", F.col("to_cls").alias("cls"), "total",
        (F.col("n") / F.col("_t") * F.col("total")).alias("expected"),
    )
    return largest_remainder(exp, [*keys, "from_cls"])


def transition_prior(
    cells: DataFrame, keys: Sequence[str], counts: DataFrame, seed: int, sized_by: DataFrame | None = None
) -> DataFrame:
    """Assign end classes by quota to hash-ordered cells of each start class."""
    base = cells if sized_by is None else sized_by
    quotas = transition_quotas(base, keys, counts)
    per = quotas.groupBy(*keys, F.col("from_cls").alias("start_cls")).agg(
        F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("_q")
    )
    tk = [*keys, "start_cls"]
    st = group_stats(base, tk)
    ranked = group_rank(cells, tk, [stable_hash(seed, *keys, *POS), *POS], "_rk", st)
    j = join_small(ranked, per, tk, st.groups)
    return j.withColumn("prior_cls", _pick_by_position("_q", F.col("_rk") - 1, F.col("start_cls"))).drop("_q", "_rk")


def _pick_by_position(quota: str, position: Column, default: Column) -> Column:
    """Class whose cumulative range of ``quota`` (sorted by class) holds a 0-based position."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("acc"), F.lit(None).cast("int").alias("cls")
    )

    def step(a: Column, x: Column) -> Column:
        acc = a["acc"] + x["n"]
        hit = a["cls"].isNull() & (position < acc)
        return F.struct(acc.alias("acc"), F.when(hit, x["cls"]).otherwise(a["cls"]).alias("cls"))

    picked = F.aggregate(F.col(quota), start, step, lambda a: a["cls"])
    return F.coalesce(picked, default)


def temporal_prior(
    cells: DataFrame, keys: Sequence[str], seed: int, shape: Sequence[str] = (),
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Change rate and changed-end classes of the other areas applied to hash-chosen cells."""
    area, base = keys[0], cells if sized_by is None else sized_by
    ch = F.col("end_cls") != F.col("start_cls")
    per = base.groupBy(*shape, *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(ch.cast("double")).alias("_rate")
    )
    tot = per.groupBy(*shape).agg(F.sum("_rate").alias("_sum"), F.count(F.lit(1)).alias("_areas"))
    with_tot = per.join(tot, list(shape)) if shape else attach_row(per, tot)
    rate = with_tot.filter("_areas > 1").select(
        *keys, half_even((F.col("_sum") - F.col("_rate")) / (F.col("_areas") - 1) * F.col("_n")).alias("_take")
    )
    hist = base.filter(ch).groupBy(*shape, *keys, F.col("end_cls").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    loo = leave_one_area_out(hist, list(shape), area, ["cls"])
    loo = loo.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("_h"))
    st = group_stats(base, keys)
    ranked = group_rank(cells, keys, [stable_hash(seed, *keys, *POS), *POS], "_rk", st)
    j = join_small(ranked, rate.join(loo, list(keys)), keys, st.groups)
    others = F.filter("_h", lambda x: x["cls"] != F.col("start_cls"))
    j = j.withColumn("_alt", F.when(F.size(others) > 0, others).otherwise(F.col("_h")))
    total = F.aggregate("_alt", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    pos = F.floor(hash_unit(seed + 1, *keys, *POS) * total)
    drawn = _pick_by_position("_alt", pos, F.col("start_cls"))
    out = F.when(F.col("_rk") <= F.coalesce("_take", F.lit(0)), drawn).otherwise(F.col("start_cls"))
    return j.withColumn("temporal_cls", out).drop("_rk", "_take", "_h", "_alt")


# ---- linear forecast of embedding change -------------------------------------

def vector_moments(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(i, value) sums needed for a multi-output ridge of y - x on x.

    Each task reduces its rows to one block of sums (n, x, d, x'x, x'd), so only
    those small blocks are shuffled.
    """
    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            a = np.stack(pdf[x].to_numpy()).astype(float)
            d = np.stack(pdf[y].to_numpy()).astype(float) - a
            part = np.concatenate([[len(a)], a.sum(0), d.sum(0), (a.T @ a).ravel(), (a.T @ d).ravel()])
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"i": np.arange(len(acc)), "value": acc})

    parts = pairs.select(x, y).mapInPandas(block, "i long, value double")
    return parts.groupBy("i").agg(F.sum("value").alias("value"))


def solve_ridge(moments: DataFrame, dim: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (dim x dim) and intercept from the moment sums (a dim^2-sized model)."""
    rows = moments.orderBy("i").collect()
    v = np.array([r["value"] for r in rows])
    n, sx, sd = v[0], v[1 : 1 + dim], v[1 + dim : 1 + 2 * dim]
    xx = v[1 + 2 * dim : 1 + 2 * dim + dim * dim].reshape(dim, dim)
    xd = v[1 + 2 * dim + dim * dim :].reshape(dim, dim)
    mx, md = sx / n, sd / n
    gram = xx - n * np.outer(mx, mx)
    cross = xd - n * np.outer(mx, md)
    coef = np.linalg.solve(gram + alpha * np.eye(dim), cross)
    return coef, md - mx @ coef


def linear_delta_forecast(cells: DataFrame, x: str, coef: np.ndarray, intercept: np.ndarray, out: str = "forecast") -> DataFrame:
    """x + predicted change, one matrix product per Arrow batch."""
    @F.pandas_udf("array<double>")
    def apply(z: pd.Series) -> pd.Series:
        a = np.stack(z.to_numpy()).astype(float)
        return pd.Series(list(a + a @ coef + intercept))

    return cells.withColumn(out, apply(F.col(x)))
