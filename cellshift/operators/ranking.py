"""Exact ranks and quantiles inside groups of any size.

A window partitioned by area would sort a whole area in one task, and one area
may hold a third of all cells.  These helpers first measure the groups.  While
the largest fits one task a plain window (or ``percentile``) is used.  Beyond
that, each large group is cut into slices of its own sort order: cut points come
from a hash sample, a pure function of the rows, so a re-run task sees the same
cuts; every slice is ranked on its own and shifted by the size of the slices
before it.  Ranks are exact in both cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import col
from ..session import cut_lineage, shared_path

MAX_GROUP_ROWS = 4_000_000
MAX_BROADCAST_ROWS = 10_000
_SAMPLE_PER_SLICE = 64


class GroupStats(NamedTuple):
    """Group sizes and what the driver needs to know about them."""

    sizes: DataFrame  # (keys, n)
    groups: int
    slices: int  # total slices of the groups above the limit; 0 if none
    limit: int


def group_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.cellshift.maxGroupRows", str(MAX_GROUP_ROWS)))


def group_stats(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> GroupStats:
    """Count rows per group (map-side combined) and fetch three totals."""
    limit = limit or group_row_limit(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.when(F.col("n") > limit, F.ceil(F.col("n") / F.lit(limit)))
    row = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(hot), F.lit(0))).first()
    return GroupStats(sizes, int(row[0]), int(row[1]), limit)


def join_small(
    df: DataFrame, small: DataFrame, keys: Sequence[str], rows: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Join a per-group table: known few rows are broadcast, others are written once and joined by their bytes.

    The written table's size decides between broadcast and shuffle (``spark.sql.autoBroadcastJoinThreshold``), so a
    table of wide rows is never sent whole, and its lineage isn't run a second time just to be counted.
    """
    if rows is not None and rows <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(small), list(keys), how)
    path = shared_path(small.sparkSession, "small")
    small.write.parquet(path)
    return df.join(small.sparkSession.read.schema(small.schema).parquet(path), list(keys), how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as scalar values (NULL if it is empty)."""
    value = row.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", value).select(*df.columns, "_row.*")


def attach_table(df: DataFrame, small: DataFrame) -> DataFrame:
    """Every row with every row of a class-sized table, sent as one array value."""
    packed = small.agg(F.collect_list(F.struct(*small.columns)).alias("_table"))
    return attach_row(df, packed).select(*df.columns, F.inline("_table"))


def group_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "rk",
    stats: GroupStats | None = None,
    limit: int | None = None,
    bound: GroupStats | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based row number inside ``keys`` by ascending ``order``.

    ``order`` must end in a key that is unique inside the group.  ``stats`` are
    the sizes of these very groups; ``bound`` may give sizes of groups known to
    be at least as large, which saves the measuring job while they all fit.
    """
    keys = list(keys)
    order = [col(o) for o in order]
    fits = bound is not None and bound.slices == 0
    if not fits:
        stats = stats or group_stats(df, keys, limit)
    if fits or stats.slices == 0:
        plain = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(plain).cast("bigint"))
    return _sliced_rank(df, keys, order, out, stats)


def _sliced_rank(
    df: DataFrame, keys: list[str], order: list[Column], out: str, stats: GroupStats
) -> DataFrame:
    hot = stats.sizes.filter(F.col("n") > stats.limit).select(
        *keys, F.col("n").alias("_rk_n"),
        F.ceil(F.col("n") / F.lit(stats.limit)).cast("bigint").alias("_rk_slices"),
    )
    names = [f"_rk_o{i}" for i in range(len(order))]
    # read three times below (sample, slice sizes, ranks): write it once
    src = cut_lineage(df.withColumns(dict(zip(names, order))))
    per_cut = F.floor(F.col("_rk_n") / (F.col("_rk_slices") * F.lit(_SAMPLE_PER_SLICE)))
    modulus = F.greatest(F.lit(1), per_cut).cast("bigint")
    sample = join_small(src, hot, keys, stats.slices, "inner").filter(
        F.pmod(F.xxhash64(*names), modulus) == 0
    )
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*names))
    picked = sample.select(*keys, F.struct(*names).alias("_rk_t"), nth.alias("_rk_r")).filter(
        F.col("_rk_r") % _SAMPLE_PER_SLICE == 0
    )
    cuts = picked.groupBy(*keys).agg(F.array_sort(F.collect_list("_rk_t")).alias("_rk_cuts"))
    # Two-step search: coarse stride first, then inside one stride.
    cuts = cuts.withColumn("_rk_step", F.ceil(F.sqrt(F.size("_rk_cuts"))).cast("int"))
    cuts = cuts.withColumn("_rk_coarse", F.expr("filter(_rk_cuts, (c, i) -> (i + 1) % _rk_step = 0)"))
    src = join_small(src.withColumn("_rk_t", F.struct(*names)), cuts, keys, stats.slices)
    src = src.withColumn("_rk_b", F.expr("size(filter(_rk_coarse, c -> c < _rk_t)) * _rk_step"))
    fine = F.expr("_rk_b + size(filter(slice(_rk_cuts, _rk_b + 1, _rk_step), c -> c < _rk_t))")
    src = src.withColumn("_rk_slice", F.coalesce(fine, F.lit(0)))
    src = src.drop("_rk_cuts", "_rk_coarse", "_rk_step", "_rk_t", "_rk_b")
    sizes = join_small(src, hot.select(*keys), keys, stats.slices, "left_semi")
    sizes = sizes.groupBy(*keys, "_rk_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_rk_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_rk_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_rk_off")
    )
    inner = W.partitionBy(*keys, "_rk_slice").orderBy(*names)
    ranked = src.withColumn("_rk_rn", F.row_number().over(inner))
    ranked = join_small(ranked, offsets, [*keys, "_rk_slice"], stats.slices)
    rank = F.col("_rk_rn") + F.coalesce(F.col("_rk_off"), F.lit(0))
    return ranked.withColumn(out, rank.cast("bigint")).select(*df.columns, out)


def group_agg(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column] = (),
    value: str = "value",
    quantiles: dict[str, float] | None = None,
    stats: GroupStats | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Aggregates plus exact linear-interpolated quantiles of ``value`` per group."""
    keys = list(keys)
    quantiles = quantiles or {}
    if quantiles:
        stats = stats or group_stats(df, keys, limit)
    if not quantiles or stats.slices == 0:
        cols = [F.percentile(value, F.lit(q)).alias(n) for n, q in quantiles.items()]
        return df.groupBy(*keys).agg(*aggs, *cols)
    quants = _sliced_quantiles(df, keys, value, quantiles, stats.limit)
    rest = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_one")]))
    out = join_small(rest, quants, keys, stats.groups)
    return out if aggs else out.drop("_one")


def value_positions(
    df: DataFrame, keys: Sequence[str], value: str, limit: int | None = None
) -> DataFrame:
    """Distinct values per group with the sorted row positions they cover.

    Returns (keys, _v, _m, _first, _last): value, multiplicity, first and last
    1-based position.  Rows are counted per value before anything is sorted.
    """
    keys = list(keys)
    limit = limit or group_row_limit(df)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    tally = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    ranked = group_rank(tally, keys, ["_v"], "_d", limit=limit)
    ranked = ranked.withColumn("_s", F.floor((F.col("_d") - 1) / F.lit(limit)))
    per = ranked.groupBy(*keys, "_s").agg(F.sum("_m").alias("_sm"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, "_s", F.coalesce(F.sum("_sm").over(before), F.lit(0)).alias("_off"))
    run = W.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranked.withColumn("_run", F.sum("_m").over(run)).join(per, [*keys, "_s"])
    last = F.col("_run") + F.col("_off")
    return ranked.select(
        *keys, "_v", "_m", (last - F.col("_m") + 1).alias("_first"), last.alias("_last")
    )


def _sliced_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], limit: int
) -> DataFrame:
    """Exact interpolated quantiles from the positions of distinct values."""
    ranked = value_positions(df, keys, value, limit)
    j = ranked.join(ranked.groupBy(*keys).agg(F.sum("_m").alias("_cnt")), keys)
    parts = []
    for name, q in quantiles.items():
        pos = (F.col("_cnt") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
        a = F.max(F.when((F.col("_first") <= lo) & (lo <= F.col("_last")), F.col("_v")))
        b = F.max(F.when((F.col("_first") <= hi) & (hi <= F.col("_last")), F.col("_v")))
        parts.append((a + (b - a) * F.max(pos - F.floor(pos))).alias(name))
    return j.groupBy(*keys).agg(*parts)
