"""Gates: keep some predicted changes, revert the others to the start class.

A candidate is a valid cell whose predicted class differs from its start class.
Each gate ranks candidates once inside a key and compares the rank with a
per-group budget; ranks come from ``group_rank`` and stay exact for huge areas.
The gated class is column ``gated_cls``.  ``sized_by`` may name a cheaper table
with the same cells (keys, start and predicted class), so that measuring the
groups does not recompute scores and supports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_even, ratio
from ..session import cut_lineage
from . import mapmetrics as M
from .ranking import GroupStats, attach_row, attach_table, group_agg, group_rank, group_stats, join_small

POS = ("row", "col")


def is_candidate(valid: Column | None = None) -> Column:
    """A predicted change of a cell in the mask ``valid``; without a mask, of a cell with both classes known."""
    S, P = F.col("start_cls"), F.col("pred_cls")
    v = (S != 0) & (P != 0) if valid is None else valid
    return v & (P != S)


def change_score(pred_p, start_p, w_target: float = 0.5, w_source: float = 0.25) -> Column:
    """p(pred) - p(start) + w_t * target support - w_s * source support."""
    return (
        F.col(pred_p) - F.col(start_p)
        + F.lit(w_target) * F.col("target_support")
        - F.lit(w_source) * F.col("source_support")
    )


def _check_fraction(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be in [0, 1]: {value}")


def rank_candidates(
    cells: DataFrame, keys: Sequence[str], order: Sequence[Column | str], candidate: Column,
    sized_by: DataFrame | None = None, stats: GroupStats | None = None,
) -> tuple[DataFrame, GroupStats]:
    """Add ``_c`` (is a candidate) and ``_rk``, the candidate's rank inside ``keys``.

    Only candidate groups are measured.  While they fit a task, all cells go
    through one window whose non-candidates are spread by raster row, so no join
    back is needed; otherwise candidates are ranked in slices.  ``_rk`` has no
    meaning where ``_c`` is false.
    """
    flagged = cells.withColumn("_c", F.coalesce(candidate, F.lit(False)))
    st = stats or group_stats((cells if sized_by is None else sized_by).filter(candidate), keys)
    full = [*order, *POS]
    if st.slices == 0:
        spread = F.when(F.col("_c"), F.lit(-1)).otherwise(F.col("row"))
        one = group_rank(flagged.withColumn("_sp", spread), [*keys, "_c", "_sp"], full, "_rk", bound=st)
        return one.drop("_sp"), st
    cand = group_rank(flagged.filter("_c"), keys, full, "_rk", st)
    return cand.unionByName(flagged.filter("not _c").withColumn("_rk", F.lit(None).cast("bigint"))), st


def _gated(kept: Column) -> Column:
    S, P = F.col("start_cls"), F.col("pred_cls")
    return F.when(kept, P).otherwise(S)


def keep_fraction(
    cells: DataFrame, keys: Sequence[str], fraction: float, score: str = "score",
    sized_by: DataFrame | None = None, valid: Column | None = None
) -> DataFrame:
    """Keep the top round(n * fraction) candidates by score."""
    _check_fraction("fraction", fraction)
    ranked, st = rank_candidates(cells, keys, [-F.col(score)], is_candidate(valid), sized_by)
    budget = st.sizes.select(*keys, half_even(F.col("n") * F.lit(fraction)).alias("_k"))
    out = join_small(ranked, budget, keys, st.groups)
    return out.withColumn("gated_cls", _gated(F.col("_c") & (F.col("_rk") <= F.col("_k")))).drop(
        "_c", "_k", "_rk"
    )


def sweep_fractions(
    cells: DataFrame, keys: Sequence[str], fractions: Sequence[float], score: str = "score", valid: Column | None = None
) -> DataFrame:
    """Metric rows per keep fraction from one ranking and one pass of counting.

    A cell is kept from some fraction on; cells are counted by that first index,
    so fractions multiply the small contingency table only.
    """
    S, P = F.col("start_cls"), F.col("pred_cls")
    fr = sorted(fractions)
    known = cells.filter(((S != 0) & (P != 0) if valid is None else valid) & (F.col("end_cls") != 0))
    ranked, st = rank_candidates(known, keys, [-F.col(score)], is_candidate(valid))
    ks = [half_even(F.col("n") * F.lit(float(f))).alias(f"_k{i}") for i, f in enumerate(fr)]
    out = join_small(ranked, st.sizes.select(*keys, *ks), keys, st.groups)
    first = F.lit(len(fr))
    for i in range(len(fr) - 1, -1, -1):
        first = F.when(F.col("_c") & (F.col("_rk") <= F.col(f"_k{i}")), F.lit(i)).otherwise(first)
    counts = out.groupBy(*keys, "start_cls", "end_cls", "pred_cls", first.alias("_first")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(f)).alias("fraction")) for i, f in enumerate(fr)])
    long = counts.select("*", F.inline(grid))
    gated = F.when(F.col("_first") <= F.col("_i"), P).otherwise(S)
    cont = long.groupBy(*keys, "fraction", "start_cls", "end_cls", gated.alias("pred_cls")).agg(
        F.sum("n").alias("n")
    )
    return M.metric_row(cont, [*keys, "fraction"])


def best_by_metric(
    rows: DataFrame, keys: Sequence[str], param: str, higher: Sequence[str], lower: Sequence[str]
) -> DataFrame:
    """Best parameter per metric and key, the first parameter winning ties."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (-F.col(m)).alias("_s")) for m in higher]
    items += [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(m).alias("_s")) for m in lower]
    long = rows.select(*keys, param, F.inline(F.array(*items)))
    best = F.min(F.struct("_s", param, "value")).alias("_b")
    return long.groupBy(*keys, "metric").agg(best).select(
        *keys, "metric", F.col(f"_b.{param}").alias(param), F.col("_b.value").alias("value")
    )


def leave_one_out_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: candidate hits of all the other keys, from totals minus own."""
    cols = ["n", "exact", "binary_hits"]
    total = hits.groupBy("from_cls", "to_cls").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    # classes are few: one small row of transitions per key
    grid = attach_table(hits.select(*keys).distinct(), total)
    j = grid.join(hits, [*keys, "from_cls", "to_cls"], "left")
    return j.select(
        *keys, "from_cls", "to_cls", *[(F.col(f"_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in cols]
    ).filter(F.col("n") > 0)


def _transition_budget(
    st: GroupStats, keys: Sequence[str], rel: DataFrame, take: Column
) -> DataFrame:
    """Join the reliability table to candidate group sizes and compute ``_k``."""
    groups = st.sizes.withColumnsRenamed({"start_cls": "from_cls", "pred_cls": "to_cls"})
    on = [*[k for k in keys if k in rel.columns], "from_cls", "to_cls"]
    only = [k for k in keys if k in rel.columns]
    g = rel.groupBy(*only).agg(F.max("global_reliability").alias("_g"))
    j = groups.join(rel.select(*on, "reliability"), on, "left")
    j = j.join(g, only, "left") if only else attach_row(j, g)
    j = j.withColumn("_g", F.coalesce("_g", F.lit(0.0)))
    j = j.withColumn("_rel", F.coalesce("reliability", "_g"))
    return j.select(
        *keys, F.col("from_cls").alias("start_cls"), F.col("to_cls").alias("pred_cls"), take.alias("_k")
    )


def reliability_gate(
    cells: DataFrame, keys: Sequence[str], rel: DataFrame, base: float = 0.8, slope: float = 0.55,
    lo: float = 0.45, hi: float = 1.0, score: str = "score", sized_by: DataFrame | None = None, valid: Column | None = None
) -> DataFrame:
    """Per transition keep a share that grows with its reliability against the global one."""
    _check_fraction("base", base)
    tk = [*keys, "start_cls", "pred_cls"]
    st = group_stats((cells if sized_by is None else sized_by).filter(is_candidate(valid)), tk)
    frac = F.lit(base) + F.lit(slope) * (F.col("_rel") - F.col("_g")) / F.greatest(F.col("_g"), F.lit(1e-6))
    budget = _transition_budget(st, keys, rel, half_even(F.col("n") * clamp(frac, lo, hi)))
    ranked, _ = rank_candidates(cells, tk, [-F.col(score)], is_candidate(valid), stats=st)
    out = join_small(ranked, budget, tk, st.groups)
    kept = F.col("_c") & (F.col("_rk") <= F.col("_k"))
    return out.withColumn("gated_cls", _gated(kept)).drop("_rk", "_k", "_c")


def support_reversion(
    cells: DataFrame, keys: Sequence[str], threshold: float = 0.25, quantile: float = 0.4,
    max_fraction: float = 0.03, score: str = "score", support: str = "target_support",
    sized_by: DataFrame | None = None, valid: Column | None = None
) -> DataFrame:
    """Revert weakly supported, low-scored candidates, up to a share of all candidates."""
    S, P = F.col("start_cls"), F.col("pred_cls")
    for n, v in (("threshold", threshold), ("quantile", quantile), ("max_fraction", max_fraction)):
        _check_fraction(n, v)
    cand = cells.filter(is_candidate(valid))
    st = group_stats((cells if sized_by is None else sized_by).filter(is_candidate(valid)), keys)
    limits = group_agg(
        cand, keys, [half_even(F.count(F.lit(1)) * F.lit(max_fraction)).alias("_k")], score,
        {"_q": quantile}, stats=st,
    )
    if st.slices:
        limits = cut_lineage(limits)  # one row per key, used by several passes below
    j = join_small(cells, limits, keys, st.groups)
    eligible = is_candidate(valid) & (F.col(support) <= threshold) & (F.col(score) <= F.col("_q"))
    if st.slices:  # eligible groups are smaller than the measured candidate groups
        st = group_stats(j.filter(eligible), keys)
    ranked, _ = rank_candidates(j, keys, [F.col(support), F.col(score)], eligible, stats=st)
    drop = F.col("_c") & (F.col("_rk") <= F.col("_k"))
    return ranked.withColumn("gated_cls", F.when(drop, S).otherwise(P)).drop("_c", "_k", "_q", "_rk")


def exactness_reversion(
    cells: DataFrame, keys: Sequence[str], rel: DataFrame, max_revert: float = 0.4,
    min_group: int = 100, order: Column | None = None, sized_by: DataFrame | None = None, valid: Column | None = None
) -> DataFrame:
    """In large transition groups below the global exactness, revert the lowest-ranked cells."""
    S, P = F.col("start_cls"), F.col("pred_cls")
    _check_fraction("max_revert", max_revert)
    tk = [*keys, "start_cls", "pred_cls"]
    st = group_stats((cells if sized_by is None else sized_by).filter(is_candidate(valid)), tk)
    short = (F.col("_g") - F.col("_rel")) / F.greatest(F.col("_g"), F.lit(1e-6))
    weak = (F.col("n") >= min_group) & (F.col("_rel") < F.col("_g"))
    take = F.when(weak, half_even(F.col("n") * (F.lit(max_revert) * short))).otherwise(0)
    budget = _transition_budget(st, keys, rel, take)
    by = F.col("score") if order is None else order
    ranked, _ = rank_candidates(cells, tk, [by], is_candidate(valid), stats=st)
    out = join_small(ranked, budget, tk, st.groups)
    drop = F.col("_c") & (F.col("_rk") <= F.col("_k"))
    return out.withColumn("gated_cls", F.when(drop, S).otherwise(P)).drop("_rk", "_k", "_c")


def transition_group_stats(cells: DataFrame, keys: Sequence[str], order: Column, valid: Column | None = None) -> DataFrame:
    """Candidate groups per transition: size, mean supports, range of the rank score."""
    S, P = F.col("start_cls"), F.col("pred_cls")
    return cells.filter(is_candidate(valid)).groupBy(
        *keys, S.alias("from_cls"), P.alias("to_cls")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("target_support").alias("target_support_mean"),
        F.avg("source_support").alias("source_support_mean"),
        F.min(order).alias("rank_min"), F.max(order).alias("rank_max"),
    )


def class_budget(
    cells: DataFrame, keys: Sequence[str], ratios: DataFrame, classes: Sequence[int],
    strength: float = 0.1, min_over: int = 100, order: Column | None = None, valid: Column | None = None
) -> DataFrame:
    """Revert changed cells of over-budget classes, one class after the other.

    Reverting a cell adds to its start class, so later classes see earlier
    reversions.  Candidates of a class are fixed, so cells are ranked once and
    written; each of the few classes then needs one small aggregate.
    """
    S, P = F.col("start_cls"), F.col("pred_cls")
    _check_fraction("strength", strength)
    rank_by = F.col("score") if order is None else order
    ranked = cut_lineage(rank_candidates(cells, [*keys, "pred_cls"], [rank_by], is_candidate(valid))[0])
    valid = (S != 0) & (P != 0)
    base = ranked.filter(valid).groupBy(*keys, F.col("pred_cls").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_c").cast("bigint")).alias("cand")
    )
    scope = cells.select(*keys).distinct()
    done = None
    for c in classes:
        cur = scope.join(base.filter(F.col("cls") == c), list(keys), "left")
        on = [k for k in keys if k in ratios.columns]
        mine = ratios.filter(F.col("cls") == c).select(*on, "ratio")
        cur = cur.join(mine, on, "left") if on else attach_row(cur, mine)
        gained = F.lit(0)
        if done is not None:
            back = join_small(
                ranked.filter(F.col("_c") & (S == c)), done, [*keys, "pred_cls"], how="inner"
            ).filter(F.col("_rk") <= F.col("_k")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_back"))
            cur = cur.join(back, list(keys), "left")
            gained = F.coalesce("_back", F.lit(0))
        n = F.coalesce("n", F.lit(0)) + gained
        calibrated = half_even(n * F.coalesce("ratio", F.lit(1.0)))
        target = half_even(F.lit(1.0 - strength) * n + F.lit(strength) * calibrated)
        over = F.greatest(F.lit(0), n - target)
        k = F.when(over >= min_over, F.least(over, F.coalesce("cand", F.lit(0)))).otherwise(0)
        row = cur.select(*keys, F.lit(int(c)).alias("pred_cls"), k.cast("bigint").alias("_k"))
        done = cut_lineage(row if done is None else done.unionByName(row))
    out = join_small(ranked, done, [*keys, "pred_cls"])
    drop = F.col("_c") & (F.col("_rk") <= F.coalesce("_k", F.lit(0)))
    return out.withColumn("gated_cls", F.when(drop, S).otherwise(P)).drop("_rk", "_k", "_c")


def demand_gate(
    cells: DataFrame, keys: Sequence[str], fractions: DataFrame, order: Column,
    sized_by: DataFrame | None = None, valid: Column | None = None
) -> DataFrame:
    """Keep min(round(valid * target), candidates) candidates with the highest ``order``.

    ``fractions`` holds (keys, target_fraction).
    """
    S, P = F.col("start_cls"), F.col("pred_cls")
    flagged = cells.withColumn("_s", order)
    ranked, st = rank_candidates(flagged, keys, [-F.col("_s")], is_candidate(valid), sized_by)
    n_valid = (cells if sized_by is None else sized_by).filter((S != 0) & (P != 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    budget = n_valid.join(fractions, list(keys)).select(
        *keys, half_even(F.col("_v") * F.col("target_fraction")).alias("_k")
    )
    out = join_small(ranked, budget, keys, st.groups)
    kept = F.col("_c") & (F.col("_rk") <= F.coalesce("_k", F.lit(0)))
    return out.withColumn("gated_cls", _gated(kept)).drop("_c", "_k", "_rk", "_s")


def scale_adaptive_gate(
    cells: DataFrame, keys: Sequence[str], quantile: float, small_mul: float, large_mul: float,
    threshold_pixels: int, p_min: float, p_max: float, w_target: float, w_source: float,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Keep every candidate scoring at least as high as the k-th one (ties kept).

    Needs ``pred_box`` and ``start_box`` (``uniform_class_support``); valid cells
    are those with an end label.
    """
    S, P = F.col("start_cls"), F.col("pred_cls")
    valid = F.col("end_cls") > 0
    cand = valid & (P != S)
    score = F.lit(w_target) * F.col("pred_box") - F.lit(w_source) * F.col("start_box")
    sizes = (cells if sized_by is None else sized_by).groupBy(*keys).agg(
        F.sum(valid.cast("bigint")).alias("_v"), F.sum(cand.cast("bigint")).alias("_n")
    )
    mul = F.when(F.col("_v") < threshold_pixels, F.lit(small_mul)).otherwise(F.lit(large_mul))
    target = clamp(ratio(F.col("_n"), F.col("_v")) * F.lit(quantile) * mul, p_min, p_max)
    k = F.least(F.greatest(half_even(target * F.col("_v")), F.lit(0)), F.col("_n"))
    sizes = sizes.select(*keys, k.alias("_k"))
    scored = cells.withColumn("_s", score)
    ranked, st = rank_candidates(scored, keys, [-F.col("_s")], cand, sized_by)
    ranked = join_small(ranked, sizes, keys)
    kth = ranked.filter(F.col("_c") & (F.col("_rk") == F.col("_k"))).select(*keys, F.col("_s").alias("_t"))
    out = join_small(ranked, kth, keys, st.groups)
    drop = F.col("_c") & (F.col("_t").isNull() | (F.col("_s") < F.col("_t")))
    return out.withColumn("gated_cls", F.when(drop, S).otherwise(P)).select(*cells.columns, "gated_cls")


def hybrid_branch(
    features: DataFrame, low_reliability: float, low_change: float, high_change: float,
    with_mild: bool = True,
) -> DataFrame:
    """Per area branch from (reliability, change_fraction)."""
    rel, ch = F.col("reliability"), F.col("change_fraction")
    b = F.when(rel < low_reliability, "reliability").when(ch < low_change, "low_change")
    if with_mild:
        b = b.when(ch < high_change, "mild_support")
    return features.withColumn("branch", b.otherwise("high_change"))


def choose_branch(
    cells: DataFrame, keys: Sequence[str], branches: DataFrame, sources: dict[str, str]
) -> DataFrame:
    """Take each area's prediction from the column its branch names."""
    j = join_small(cells, branches.select(*keys, "branch"), keys, how="inner")
    out = F.lit(None).cast("int")
    for b, c in sources.items():
        out = F.when(F.col("branch") == b, F.col(c)).otherwise(out)
    return j.withColumn("gated_cls", out)


def consensus(
    candidates: DataFrame, keys: Sequence[str], anchor: str, min_support: int
) -> DataFrame:
    """Keep an anchor change when at least ``min_support`` candidates changed the cell.

    ``candidates`` is long: (candidate, keys, row, col, start_cls, pred_cls).
    """
    S, P = F.col("start_cls"), F.col("pred_cls")
    if min_support < 1:
        raise ValueError(f"min_support must be positive: {min_support}")
    agg = candidates.groupBy(*keys, "row", "col", "start_cls").agg(
        F.sum((P != S).cast("bigint")).alias("support"),
        F.max(F.when(F.col("candidate") == anchor, P)).alias("_a"),
    )
    keep = (F.col("_a") != S) & (F.col("support") >= min_support)
    return agg.withColumn("gated_cls", F.when(keep, F.col("_a")).otherwise(S)).drop("_a")
