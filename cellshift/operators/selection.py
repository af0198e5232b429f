"""Fits on small calibration tables, leave-one-area tuning and rule search.

Calibration tables have one row per area.  Leave-one-out figures come from
totals, ranks and prefix sums, never from an area x area expansion.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import clamp, half_even, n_if, stable_hash
from ..session import cut_lineage
from . import mapmetrics as M
from .gates import is_candidate, rank_candidates
from .ranking import attach_row, group_agg, group_rank, group_stats, join_small

TOLERANCE = 1e-12


# ---- change-fraction models ----------------------------------------------------

def fit_ridge(rows: DataFrame, features: Sequence[str], target: str, ridge: float = 1e-3) -> list[float]:
    """Weights (intercept first, unpenalised) from moment sums; the solve is (k+1) x (k+1)."""
    if ridge < 0.0:
        raise ValueError(f"ridge must be non-negative: {ridge}")
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(target)) for c in x]
    v = rows.agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)]).first()
    gram, it = np.zeros((k, k)), iter(v)
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = next(it)
    rhs = np.array(list(it))
    penalty = np.diag([0.0] + [ridge] * (k - 1))
    if ridge == 0.0:
        return [float(w) for w in np.linalg.lstsq(gram, rhs, rcond=None)[0]]
    return [float(w) for w in np.linalg.solve(gram + penalty, rhs)]


def predict_fraction(features: Sequence[str], weights: Sequence[float], lo: float = 0.0, hi: float = 1.0) -> Column:
    raw = F.lit(weights[0])
    for f, w in zip(features, weights[1:]):
        raw = raw + F.col(f) * F.lit(w)
    return clamp(raw, lo, hi)


def change_ratios(cases: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Usable cases with ratio = max(target, 0) / max(predicted, eps)."""
    return cases.filter(F.col("predicted") > eps).withColumn(
        "ratio", F.greatest(F.col("target"), F.lit(0.0)) / F.greatest(F.col("predicted"), F.lit(eps))
    )


def ratio_quantile(ratios: DataFrame, q: float) -> DataFrame:
    """One row with the q-quantile of the ratios."""
    r = ratios.withColumn("_k", F.lit(1))
    return group_agg(r, ["_k"], [F.count(F.lit(1)).alias("n_usable")], "ratio", {"base_ratio": q}).drop("_k")


def cap_ratio(cases: DataFrame, threshold: float, q: float, eps: float = 1e-6) -> DataFrame:
    """Quantile of the ratios of cases at or above the threshold, or of all when there are none."""
    high = F.col("predicted") >= threshold
    r = change_ratios(cases, eps).withColumns({"_k": F.lit(1), "_h": F.when(high, F.col("ratio"))})
    a = group_agg(r, ["_k"], [F.count("_h").alias("n_high")], "ratio", {"_q": q})
    h = group_agg(r, ["_k"], [], "_h", {"_qh": q})
    return attach_row(a, h.select("_qh")).select(F.coalesce("_qh", "_q").alias("cap_ratio"), "n_high")


def leave_one_out_quantile(
    cases: DataFrame, usable: Column, value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Per area the quantiles (name -> q) of ``value`` over the other usable areas.

    With n usable values sorted, leaving out rank k shifts the wanted positions
    by at most one, so four order statistics per quantile answer every area.
    """
    u = cases.filter(usable).select("area", F.col(value).alias("_v"), F.lit(1).alias("_k"))
    st = group_stats(u, ["_k"])
    ranked = group_rank(u, ["_k"], ["_v", "area"], "_r", st)
    r = attach_row(ranked, st.sizes.select(F.col("n").alias("_n")))

    def order_stats(name: str, q: float, drop: int) -> list[Column]:
        """Order statistics around the q-position of a sample of n - drop values."""
        pos = (F.col("_n") - 1 - drop) * F.lit(float(q))
        cols = [F.max(pos - F.floor(pos)).alias(f"_{name}_f{drop}")]
        for side, p in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            at = lambda s, p=p: F.max(F.when(F.col("_r") == p + 1 + s, F.col("_v")))
            cols += [F.max(p).alias(f"_{name}_{side}{drop}_p"),
                     at(0).alias(f"_{name}_{side}{drop}_0"), at(1).alias(f"_{name}_{side}{drop}_1")]
        return cols

    s = r.groupBy("_k").agg(
        F.max("_n").alias("_n"), *[c for n, q in quantiles.items() for d in (0, 1) for c in order_stats(n, q, d)]
    )
    c = attach_row(cases.join(ranked.select("area", "_r"), "area", "left"), s.drop("_k"))

    def answer(name: str) -> Column:
        def moved(side: str) -> Column:
            p = f"_{name}_{side}1"
            return F.when(F.col("_r") <= F.col(f"{p}_p") + 1, F.col(f"{p}_1")).otherwise(F.col(f"{p}_0"))

        def between(lo: Column, hi: Column, drop: int) -> Column:
            return lo + (hi - lo) * F.col(f"_{name}_f{drop}")

        everyone = between(F.col(f"_{name}_lo0_0"), F.col(f"_{name}_hi0_0"), 0)
        others = F.when(F.col("_n") > 1, between(moved("lo"), moved("hi"), 1))
        return F.when(F.col("_r").isNull(), everyone).otherwise(others)

    return c.select(*cases.columns, *[answer(n).alias(n) for n in quantiles])


def target_fraction(
    candidate: Column, ratio: Column, multiplier: Column, lo: Column, hi: Column,
    cap: Column | None = None, threshold: Column | None = None,
) -> Column:
    """min/max-clipped candidate * ratio * multiplier, capped for high candidates."""
    c = F.greatest(F.lit(0.0), candidate)
    raw = c * (ratio * multiplier)
    if cap is not None and threshold is not None:
        raw = F.when(c >= threshold, F.least(raw, c * cap)).otherwise(raw)
    return F.least(hi, F.greatest(lo, raw))


def scale_multiplier(valid: Column, base: float, threshold: int | None, large: float | None) -> Column:
    """Multiplier switched by region size."""
    if threshold is None or large is None:
        return F.lit(base)
    return F.when(valid < threshold, F.lit(base)).otherwise(F.lit(large))


# ---- parameter tuning ------------------------------------------------------------

def parameter_grid(rows: DataFrame, options: dict[str, Sequence], cap_flag: str, cap_knobs: Sequence[str]) -> DataFrame:
    """Every combination of the options for each row; cap knobs collapse while the cap is off."""
    out = rows
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    for k in cap_knobs:
        out = out.withColumn(k, F.when(F.col(cap_flag), F.col(k)).otherwise(F.lit(options[k][0])))
    return out.distinct()


def evaluate_budgets(
    cells: DataFrame, keys: Sequence[str], budgets: DataFrame, order: Column,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Metrics of keeping the top-k candidates for every (key, param, k) at once.

    Cells are ranked once.  A cell is counted by the first of the key's sorted
    budgets that keeps it; parameters multiply the small contingency table only.
    """
    ranked, st = rank_candidates(cells, keys, [-order], is_candidate(), sized_by)
    ks = budgets.groupBy(*keys).agg(F.array_sort(F.collect_set("k")).alias("_ks"))
    j = join_small(ranked, ks, keys, how="inner")
    first = F.when(F.col("_c"), F.size(F.filter("_ks", lambda x: x < F.col("_rk"))))
    cont = j.groupBy(*keys, "start_cls", "end_cls", "pred_cls", first.alias("_first")).agg(F.count(F.lit(1)).alias("n"))
    packed = budgets.join(ks, list(keys)).select(
        *keys, "param", (F.array_position("_ks", F.col("k")) - 1).alias("_i")
    )
    long = cont.join(packed, list(keys))
    kept = F.col("_first").isNotNull() & (F.col("_first") <= F.col("_i"))
    s, p = F.col("start_cls"), F.col("pred_cls")
    gated = long.groupBy(*keys, "param", "start_cls", "end_cls", F.when(kept, p).otherwise(s).alias("pred_cls")).agg(
        F.sum("n").alias("n")
    )
    return M.metric_row(gated, [*keys, "param"])


def rank_parameters(rows: DataFrame) -> list[Column]:
    """Sort order of parameter summaries."""
    return [F.desc("mean_fom"), F.asc("mean_allocation_disagreement"), F.desc("mean_change_f1"),
            F.desc("mean_transition_accuracy"), F.asc("param")]


def best_parameter(rows: DataFrame, min_transition_accuracy: float | None = None) -> DataFrame:
    """Best row, among those meeting the floor if any does."""
    if min_transition_accuracy is None:
        return rows.orderBy(*rank_parameters(rows)).limit(1)
    ok = F.col("mean_transition_accuracy") >= min_transition_accuracy
    return rows.orderBy(ok.desc(), *rank_parameters(rows)).limit(1)


# ---- candidate selection -----------------------------------------------------------

def select_leave_one_out(
    rows: DataFrame, metrics: Sequence[str], priority: Sequence[str] = ()
) -> DataFrame:
    """Per area the candidate with the best mean over the other areas.

    Compared lexicographically by the metrics, then by priority, then by name
    (the later name wins).  ``rows`` is (candidate, area, metrics).
    """
    tot = rows.groupBy("candidate").agg(
        *[F.sum(m).alias(f"_s_{m}") for m in metrics], *[F.count(m).alias(f"_n_{m}") for m in metrics],
        F.count(F.lit(1)).alias("_n"),
    )
    j = rows.join(tot, "candidate")
    keys = []
    for m in metrics:
        own, has = F.coalesce(F.col(m), F.lit(0.0)), F.col(m).isNotNull().cast("int")
        n = F.col(f"_n_{m}") - has
        mean = F.when(n > 0, (F.col(f"_s_{m}") - own) / n).otherwise(F.lit(float("-inf")))
        j = j.withColumn(f"train_{m}", mean)
        keys.append(f"train_{m}")
    prio = F.lit(len(priority))
    for i, c in enumerate(priority):
        prio = F.when(F.col("candidate") == c, i).otherwise(prio)
    best = F.max(F.struct(*[F.round(k, 12).alias(k) for k in keys], (-prio).alias("p"), F.col("candidate").alias("c")))
    out = j.groupBy("area").agg(best.alias("_b"), F.max(F.col("_n") - 1).alias("n_train"))
    return out.select("area", F.col("_b.c").alias("selected"), "n_train", *[F.col(f"_b.{k}").alias(k) for k in keys])


def _axes(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(axis, op, area, s): a condition holds when s <= the axis threshold."""
    arr = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    long = rows.select("candidate", "area", F.inline(arr))
    ops = F.array(
        F.struct(F.lit("le").alias("op"), F.col("v").alias("s")), F.struct(F.lit("ge").alias("op"), (-F.col("v")).alias("s"))
    )
    axis = F.concat_ws("|", "candidate", "field", "op")
    return long.select("candidate", "field", "area", F.inline(ops)).withColumn("axis", axis)


def _deltas(rows: DataFrame, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """(alternate, area, d_metric): alternate minus baseline per area."""
    b = rows.filter(F.col("candidate") == baseline).select("area", *[F.col(m).alias(f"_b_{m}") for m in metrics])
    a = rows.filter(F.col("candidate") != baseline).join(b, "area")
    return a.select(F.col("candidate").alias("alternate"), "area", *[(F.col(m) - F.col(f"_b_{m}")).alias(f"d_{m}") for m in metrics])


def _baseline(rows: DataFrame, baseline: str, metrics: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("candidate") == baseline).agg(
        F.count(F.lit(1)).alias("n_areas"), *[F.avg(m).alias(f"base_{m}") for m in metrics]
    )


def _finish(rules: DataFrame, base: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Turn summed deltas into means against the baseline."""
    r = attach_row(rules, base)
    cols = {f"delta_{m}": F.col(f"d_{m}") / F.col("n_areas") for m in metrics}
    r = r.withColumns(cols)
    r = r.withColumns({f"mean_{m}": F.col(f"base_{m}") + F.col(f"delta_{m}") for m in metrics})
    r = r.withColumn("alternate_share", F.col("n_alternate") / F.col("n_areas"))
    return r.drop(*[f"d_{m}" for m in metrics], *[f"base_{m}" for m in metrics])


def threshold_rules(rows: DataFrame, baseline: str, field: str, metrics: Sequence[str]) -> DataFrame:
    """Means of every rule "alternate where feature <= / >= t", and of "always baseline".

    Thresholds are the observed values, so a rule's sum is a prefix sum over the
    areas in feature order.
    """
    axes = _axes(rows, [field]).select("candidate", "op", "area", "s")
    d = _deltas(rows, baseline, metrics)
    j = axes.join(d, (axes.candidate == d.alternate) & (axes.area == d.area)).drop(d.area)
    at = j.groupBy("alternate", "op", "s").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"d_{m}").alias(f"_d_{m}") for m in metrics]
    )
    w = W.partitionBy("alternate", "op").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    rules = at.select(
        "alternate", F.col("op").alias("operator"), F.when(F.col("op") == "le", F.col("s")).otherwise(-F.col("s")).alias("threshold"),
        F.sum("_n").over(w).alias("n_alternate"), *[F.sum(f"_d_{m}").over(w).alias(f"d_{m}") for m in metrics],
    )
    none = rows.limit(1).select(
        F.lit(None).cast("string").alias("alternate"), F.lit("always").alias("operator"),
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("n_alternate"),
        *[F.lit(0.0).alias(f"d_{m}") for m in metrics],
    )
    return _finish(rules.unionByName(none), _baseline(rows, baseline, metrics), metrics)


def conjunctive_rules(rows: DataFrame, baseline: str, fields: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means of every rule with two different conditions, as two-way prefix sums.

    One output row per rule: (alternate, axis1, t1, axis2, t2).  The areas enter
    once per axis pair; the grid of thresholds is the result itself.
    """
    axes = _axes(rows, fields).select("axis", "area", "s")
    a = axes.select(F.col("axis").alias("axis1"), "area", F.col("s").alias("s1"))
    b = axes.select(F.col("axis").alias("axis2"), "area", F.col("s").alias("s2"))
    pairs = a.join(b, "area").filter("axis1 <= axis2")
    d = _deltas(rows, baseline, metrics)
    pts = pairs.join(d, "area").groupBy("alternate", "axis1", "axis2", "s1", "s2").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"d_{m}").alias(f"_d_{m}") for m in metrics]
    )
    t = axes.groupBy("axis").agg(F.array_sort(F.collect_set("s")).alias("ts"))
    ap = pts.select("alternate", "axis1", "axis2").distinct()
    grid = ap.join(t.select(F.col("axis").alias("axis1"), F.col("ts").alias("_t1")), "axis1").join(
        t.select(F.col("axis").alias("axis2"), F.col("ts").alias("_t2")), "axis2"
    ).select("alternate", "axis1", "axis2", F.explode("_t1").alias("s1"), "_t2").select(
        "alternate", "axis1", "axis2", "s1", F.explode("_t2").alias("s2")
    )
    names = ["_n", *[f"_d_{m}" for m in metrics]]
    g = grid.join(pts, ["alternate", "axis1", "axis2", "s1", "s2"], "left").fillna(0, names)
    k = ["alternate", "axis1", "axis2"]
    w1 = W.partitionBy(*k, "s2").orderBy("s1").rowsBetween(W.unboundedPreceding, 0)
    w2 = W.partitionBy(*k, "s1").orderBy("s2").rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumns({f"{c}1": F.sum(c).over(w1) for c in names})
    g = g.select(*k, "s1", "s2", *[F.sum(f"{c}1").over(w2).alias(c) for c in names])
    g = g.filter((F.col("axis1") < F.col("axis2")) | (F.col("s1") < F.col("s2")))
    out = g.select(*k, "s1", "s2", F.col("_n").alias("n_alternate"), *[F.col(f"_d_{m}").alias(f"d_{m}") for m in metrics])
    return _finish(out, _baseline(rows, baseline, metrics), metrics)


BITMAP_BYTES = 1 << 28  # what a task holds of all conditions' area bitmaps and of the gains


TARGET_BLOCK = 4096  # target areas that a task compares with all conditions at once
SHARE_ROWS = 1 << 14  # target areas that a task is given
CHUNK_RULES = 256  # rules that a task counts target areas for at once


def _target_values(target: DataFrame, fields: Sequence[str], axes: Sequence[str]) -> tuple[DataFrame, int]:
    """((_share, _v: least value of a target area on each axis), number of areas); shares by hash, of bounded size."""
    aims = _axes(target, fields).select("axis", "area", "s").filter("s is not null and not isnan(s)")
    least = [F.min(F.when(F.col("axis") == a, F.col("s"))) for a in axes]
    values = cut_lineage(aims.groupBy("area").agg(F.array(*least).alias("_v")))
    n = values.count()
    return values.select(F.pmod(F.xxhash64("area"), F.lit(n // SHARE_ROWS + 1)).alias("_share"), "_v"), n


def _target_counts(
    level: DataFrame, values: DataFrame, shares: int, conditions: Sequence[tuple[str, float]], axes: Sequence[str],
) -> DataFrame:
    """(at, aim): for each rule so far, in how many target areas it holds together with each condition.

    A task counts one share of the target areas for a chunk of rules, block by block, and only its totals leave it.
    """
    n, kind = len(conditions), "at array<int>, aim array<bigint>"
    column = np.array([axes.index(a) for a, _ in conditions], int)
    limit = np.array([s for _, s in conditions], float)
    chunks = level.count() // CHUNK_RULES + 1
    rules = level.select("at", F.pmod(F.xxhash64("at"), F.lit(chunks)).alias("_chunk"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    rules = rules.withColumn("_share", F.col("_share").cast("bigint"))
    given = values.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("_chunk", F.col("_chunk").cast("bigint"))

    def told(at: list, total: np.ndarray) -> pa.Table:
        return pa.table([pa.array(at, pa.list_(pa.int32())), pa.array(list(total), pa.list_(pa.int64()))], names=["at", "aim"])

    def count(areas: pa.Table, own: pa.Table) -> pa.Table:
        at = own.column("at").to_pylist()
        total = np.zeros((len(at), n), np.int64)
        for b in areas.to_batches(max_chunksize=TARGET_BLOCK) if at else ():
            v = b.column("_v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            held = v[:, column] <= limit  # a missing value is NaN and holds nowhere
            so_far = np.stack([held[:, r].all(axis=1) for r in at])
            total += (so_far.astype(np.float32) @ held.astype(np.float32)).astype(np.int64)  # whole numbers up to the block
        return told(at, total)

    def add(t: pa.Table) -> pa.Table:
        v = t.column("aim").combine_chunks().flatten().to_numpy().reshape(t.num_rows, n)
        return told(t.column("at").slice(0, 1).to_pylist(), v.sum(axis=0, keepdims=True))

    by = lambda d: d.groupBy("_share", "_chunk")
    return by(given).cogroup(by(rules)).applyInArrow(count, kind).groupBy("at").applyInArrow(add, kind)


def best_conjunction(
    rows: DataFrame, baseline: str, fields: Sequence[str], k: int, higher: Sequence[str], lower: Sequence[str] = (),
    max_share: float | None = None, min_count: int = 1, target: DataFrame | None = None, target_min: int | None = None,
    target_max: int | None = None,
) -> DataFrame:
    """The best feasible rule of one to ``k`` conditions: (alternate, conditions, n_alternate, delta_metric...).

    A condition is (axis, s): areas whose axis value is at most s. Feasible as in ``feasible_rules``, and, with ``target``
    (candidate, area, fields of unlabelled areas), switching ``target_min`` to ``target_max`` of its areas
    (``target_count``). Best by the mean of ``higher`` metrics in turn, then lower ones, more alternates, alternate, fewer
    conditions, then the conditions themselves. Empty if none is feasible.

    Target areas are counted share by share over all tasks, none holds them all.

    Branch and bound by number of conditions: each condition is a bitmap of areas, a task joins the conditions so far with
    all later ones at once. A rule so far goes on with an alternate only if it holds enough areas, and if the gains of
    its best areas, as many as the share allows, could still reach the best feasible rule found.
    """
    metrics = [*higher, *lower]
    axes = _axes(rows, fields).select("axis", "area", "s").filter("s is not null and not isnan(s)")
    points = _deltas(rows, baseline, metrics)
    spark = rows.sparkSession
    n_areas = rows.filter(F.col("candidate") == baseline).count()
    n_points = points.select("area").distinct().count()
    n_conditions = axes.select("axis", "s").distinct().count()
    size = n_conditions * (n_points + 32) + 8 * n_points * len(metrics) * points.select("alternate").distinct().count()
    if size > BITMAP_BYTES:
        raise ValueError(f"{n_conditions} conditions over {n_points} areas need {size} bytes in a task, over {BITMAP_BYTES}")
    d = points.toPandas().dropna() if n_points else points.limit(0).toPandas()  # bounded by the check above, as all below
    place = {x: i for i, x in enumerate(sorted(d["area"].unique()))}
    named = sorted(d["alternate"].unique())
    gains = np.zeros((len(named), len(metrics), len(place)))
    there = np.zeros((len(named), len(place)), bool)
    for i, name in enumerate(named):
        own = d[d["alternate"] == name]
        at = own["area"].map(place).to_numpy(int)
        gains[i][:, at] = own[[f"d_{m}" for m in metrics]].to_numpy(float).T
        there[i, at] = True
    held = axes.toPandas()
    conditions = sorted(set(zip(held["axis"], held["s"])))

    def bitmaps(table, of: dict) -> np.ndarray:
        out = np.zeros((len(conditions), len(of)), bool)
        by_axis = {a: (g["area"].map(of), g["s"].to_numpy()) for a, g in table[table["area"].isin(of)].groupby("axis")}
        for i, (axis, s) in enumerate(conditions):
            if axis in by_axis:
                at, v = by_axis[axis]
                out[i, at.to_numpy(int)[v <= s]] = True
        return out

    met = bitmaps(held, place)
    axis_names = sorted({a for a, _ in conditions})
    values, n_targets = (None, 0) if target is None or not conditions else _target_values(target, fields, axis_names)
    kind_of = [axis for axis, _ in conditions]
    after = np.array([kind_of.index(a) + kind_of.count(a) for a in kind_of], int)  # first condition of the next axis
    most = n_areas if max_share is None else int(np.floor((max_share + TOLERANCE) * n_areas))
    low, high = target_min or 0, n_targets if target_max is None else target_max
    shared = spark.sparkContext.broadcast((met, gains, there, after))  # of the checked size
    n_higher = len(higher)

    def grow(best: float, last: bool):
        def run(batches):
            met, gains, there, after = shared.value
            for b in batches:
                rules, going = [], []
                for so_far, alternates, aims in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    first = int(after[so_far[-1]]) if so_far else 0
                    here = met[first:] & (met[so_far].all(axis=0) if so_far else True)
                    aim = aims.values.to_numpy()[first:] if aims.is_valid else np.zeros(len(here), np.int64)
                    if not len(here):
                        continue
                    able = aim >= low
                    onward: dict[int, list[int]] = {}
                    for a in alternates:
                        areas = here & there[a]
                        count = areas.sum(axis=1)
                        delta = areas @ gains[a].T / n_areas
                        ok = (count >= min_count) & (count <= most) & able & (aim <= high)
                        ok &= (delta[:, :n_higher] >= -TOLERANCE).all(axis=1) & (delta[:, n_higher:] <= TOLERANCE).all(axis=1)
                        at = np.flatnonzero(ok)
                        if len(at):
                            v = np.round(delta[at], 12)
                            v[:, n_higher:] *= -1
                            i = at[np.lexsort((at, -count[at], *(-v[:, m] for m in range(v.shape[1] - 1, -1, -1))))[0]]
                            rules.append((a, [*so_far, first + int(i)], int(count[i]), int(aim[i]), [float(x) for x in delta[i]]))
                        if not last:
                            top = np.sort(np.where(areas, np.maximum(gains[a][0], 0.0), 0.0), axis=1)[:, ::-1][:, :most]
                            reach = top.sum(axis=1) / n_areas >= max(best, -TOLERANCE) - 1e-9
                            for i in np.flatnonzero((count >= max(min_count, 1)) & able & reach).tolist():
                                onward.setdefault(first + i, []).append(a)
                    going += [([*so_far, i], alive) for i, alive in onward.items()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([*(r[0] for r in rules), *(None for _ in going)], pa.int32()),
                    pa.array([*(r[1] for r in rules), *(g[0] for g in going)], pa.list_(pa.int32())),
                    pa.array([*(r[2] for r in rules), *(None for _ in going)], pa.int64()),
                    pa.array([*(r[3] for r in rules), *(None for _ in going)], pa.int64()),
                    pa.array([*(r[4] for r in rules), *(None for _ in going)], pa.list_(pa.float64())),
                    pa.array([*(None for _ in rules), *(g[1] for g in going)], pa.list_(pa.int32()))],
                    names=["a", "at", "n", "aim", "delta", "alive"])
        return run

    order = [F.round(F.get("delta", F.lit(i)), 12).desc() for i in range(n_higher)]
    order += [F.round(F.get("delta", F.lit(n_higher + i)), 12).asc() for i in range(len(lower))]
    order += [F.desc("n"), F.desc("a"), F.size("at"), F.col("at")]
    shape = "a int, at array<int>, n long, aim long, delta array<double>, alive array<int>"
    level = spark.createDataFrame([([], list(range(len(named))))], "at array<int>, alive array<int>")
    best = None
    for i in range(k):
        reach = float("-inf") if best is None else best.delta[0]
        if n_targets:
            level = level.join(_target_counts(level, values, n_targets // SHARE_ROWS + 1, conditions, axis_names), "at", "left")
        else:
            level = level.withColumn("aim", F.lit(None).cast("array<bigint>"))
        grown = cut_lineage(level.select("at", "alive", "aim").mapInArrow(grow(reach, i == k - 1), shape))
        rule = grown.filter("a is not null").orderBy(*order).limit(1).collect()  # one row
        both = spark.createDataFrame([r for r in (best, *rule) if r is not None], shape)
        best = both.orderBy(*order).first()
        level = grown.filter("alive is not null").select("at", "alive").repartition(spark.sparkContext.defaultParallelism, "at")
    kind = "array<struct<axis:string,s:double>>"
    out = [] if best is None else [(
        named[best.a], [conditions[i] for i in best["at"]], best.n, best.n / n_areas, best.aim, *best.delta)]
    done = spark.createDataFrame(out, f"alternate string, conditions {kind}, n_alternate long, alternate_share double, target_count long, "
                                 + ", ".join(f"delta_{m} double" for m in metrics))
    return done if target is not None else done.drop("target_count")


def feasible_rules(
    rules: DataFrame, higher: Sequence[str], lower: Sequence[str], max_share: float | None = None, min_count: int = 0
) -> DataFrame:
    """Flag rules whose means are nowhere worse than the baseline and whose use is within bounds."""
    ok = F.lit(True)
    for m in higher:
        ok = ok & (F.col(f"delta_{m}") >= -TOLERANCE)
    for m in lower:
        ok = ok & (F.col(f"delta_{m}") <= TOLERANCE)
    if max_share is not None:
        ok = ok & (F.col("alternate_share") <= max_share + TOLERANCE)
    if min_count:
        ok = ok & ((F.col("n_alternate") >= min_count) | F.col("alternate").isNull())
    return rules.withColumn("feasible", ok)


def best_rule(rules: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Best feasible rule by (metric, higher-is-better) in turn, more alternates, then name."""
    by = [F.round(f"mean_{m}", 12).desc() if up else F.round(f"mean_{m}", 12).asc() for m, up in order]
    return rules.orderBy(F.desc("feasible"), *by, F.desc("n_alternate"), F.desc_nulls_last("alternate")).limit(1)


def apply_rule(features: DataFrame, conditions: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Add ``use_alternate`` = all conditions (field, 'le'|'ge', threshold) hold; none means False."""
    ok = F.lit(bool(conditions))
    for field, op, t in conditions:
        if op not in ("le", "ge"):
            raise ValueError(f"unsupported operator: {op}")
        ok = ok & (F.col(field) <= t if op == "le" else F.col(field) >= t)
    return features.withColumn("use_alternate", ok)


def unlabeled_counts(features: DataFrame) -> DataFrame:
    """How many target areas a rule would switch, without looking at labels."""
    return features.agg(n_if(F.col("use_alternate")).alias("n_alternate"), F.count(F.lit(1)).alias("n_areas"))


def oracle_best(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Best candidate per area by (metric, higher-is-better) in turn, then name."""
    keys = [F.round(-F.col(m) if up else F.col(m), 12).alias(f"_{m}") for m, up in order]
    best = F.min(F.struct(*keys, "candidate")).alias("_b")
    return rows.groupBy("area").agg(best).select("area", F.col("_b.candidate").alias("best"))


AUDIT_METRICS = (("fom", True), ("change_f1", True), ("transition_accuracy", True), ("allocation_disagreement", False))


def bank_contingency(cells: DataFrame, area: str, candidates: dict[str, str], nodata: int = 0) -> DataFrame:
    """(candidate, area, start_cls, end_cls, pred_cls, n) of a bank of predictions: all that its metrics need of the cells.

    Cells without start, end or predicted class count for no metric of that candidate.
    """
    cont = M.method_contingency(cells, [area], candidates).withColumnRenamed("method", "candidate")
    known = [F.col(c) != nodata for c in ("start_cls", "end_cls", "pred_cls")]
    return cont.filter(known[0] & known[1] & known[2])


def composite_metrics(cont: DataFrame, decisions: DataFrame, area: str = "area") -> DataFrame:
    """Metrics per area of the prediction that takes each area from the candidate decided on: (area, candidate, metrics).

    ``decisions`` is (area, candidate). Only contingency rows are read, so any number of rules costs no pass over cells.
    """
    chosen = cont.join(decisions.select(area, "candidate"), [area, "candidate"])
    return M.metric_row(chosen, [area, "candidate"])


def bank_audit(cont: DataFrame, area: str = "area", order: Sequence[tuple[str, bool]] = AUDIT_METRICS) -> DataFrame:
    """Metrics of every candidate and area, its predicted change, and whether it is the area's best (``is_best``).

    Best by the metrics in turn as in ``oracle_best``, then the first candidate by name.
    """
    rows = M.metric_row(cont, [area, "candidate"])
    moved = cont.groupBy(area, "candidate").agg(
        (F.sum(F.when(F.col("pred_cls") != F.col("start_cls"), F.col("n")).otherwise(0)) / F.sum("n")).alias("predicted_change_fraction"))
    best = oracle_best(rows.withColumnRenamed(area, "area"), order).withColumnRenamed("area", area)
    return rows.join(moved, [area, "candidate"]).join(best, area).withColumn("is_best", F.col("candidate") == F.col("best")).drop("best")


def bank_headroom(audit: DataFrame, metrics: Sequence[tuple[str, bool]] = AUDIT_METRICS) -> DataFrame:
    """Per candidate its mean metrics, how many areas it is best in, and what always taking the best would gain."""
    means = [F.avg(m).alias(f"mean_{m}") for m, _ in metrics]
    by = audit.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_areas"), n_if(F.col("is_best")).alias("n_best"), *means)
    top = audit.filter("is_best").agg(*[F.avg(m).alias(f"oracle_{m}") for m, _ in metrics])
    out = attach_row(by, top)
    return out.withColumns({
        f"headroom_{m}": (F.col(f"oracle_{m}") - F.col(f"mean_{m}")) * F.lit(1 if up else -1) for m, up in metrics})


def split_areas(areas: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Mark hash-chosen calibration areas: at least one if the fraction is positive, never all."""
    if not 0.0 <= fraction < 1.0:
        raise ValueError(f"fraction must be in [0, 1): {fraction}")
    a = areas.select("area").distinct().withColumn("_k", F.lit(1))
    st = group_stats(a, ["_k"])
    take = half_even(F.col("n") * F.lit(fraction))
    if fraction > 0.0:
        take = F.greatest(F.lit(1), take)
    take = F.least(F.greatest(F.lit(0), take), F.greatest(F.lit(0), F.col("n") - 1))
    r = group_rank(a, ["_k"], [stable_hash(seed, "area"), "area"], "_rk", st)
    r = join_small(r, st.sizes, ["_k"], st.groups)
    return r.select("area", (F.col("_rk") <= take).alias("calibration"))


# ---- stratified sample ---------------------------------------------------------------

def stratified_sample(
    units: DataFrame, sample_size: int, max_per_province: int, seed: str, id_cols: Sequence[str]
) -> DataFrame:
    """Round-robin over (region, size_class) groups in hash order with a cap per province; adds ``selection_rank``.

    A unit's turn is (its place among its group's units, its group). A province takes the units with its first turns.
    When a unit comes too late for its province, those behind it in its group move up, so all turns before the first
    late one are final, and with them the provinces that they fill: each round drops all later units of those provinces.
    No province takes more than its cap from a group, and at most sample_size / cap provinces get full, so the first
    2 x sample_size units left of a group hold all that it can give; nothing larger is moved after that cut.
    """
    key = F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols]), 256)
    group, place = ["region", "size_class"], ["province", *group_cols(id_cols)]
    u = units.select(*group, *place, key.alias("selection_key"))
    order = ["selection_key", *id_cols]
    top = group_rank(u, [*group, "province"], order, "_rk").filter(F.col("_rk") <= max_per_province).drop("_rk")
    top = group_rank(top, group, order, "_rk").filter(F.col("_rk") <= 2 * sample_size)
    live = cut_lineage(top)
    in_group = W.partitionBy(*group).orderBy("_rk")
    turn = F.struct("_k", *group)
    while True:
        turns = live.withColumn("_k", F.row_number().over(in_group))
        turns = turns.withColumn("_c", F.row_number().over(W.partitionBy("province").orderBy("_k", *group)))
        turns = cut_lineage(turns)
        late = turns.filter(F.col("_c") > max_per_province).agg(F.min(turn).alias("_late"))
        final = attach_row(turns, late).filter(F.col("_late").isNull() | (turn < F.col("_late")))
        row = late.select(F.col("_late").isNotNull(), final.agg(F.count(F.lit(1)).alias("n")).scalar()).first()
        if not row[0] or row[1] >= sample_size:
            break
        full = final.filter(F.col("_c") == max_per_province).select("province")
        ahead = attach_row(turns, late).filter(turn >= F.col("_late"))
        live = cut_lineage(final.select(*top.columns).unionByName(
            ahead.join(full, "province", "left_anti").select(*top.columns)))
    # rank of a turn: all turns of earlier rounds, then its place in its round
    sizes = final.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))  # at most 2 x sample_size rounds
    before = F.coalesce(F.sum("_n").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = final.withColumn("_at", F.row_number().over(W.partitionBy("_k").orderBy(*group))).join(
        sizes.select("_k", before.alias("_before")), "_k")
    rank = (F.col("_before") + F.col("_at")).cast("int")
    return ranked.withColumn("selection_rank", rank).filter(F.col("selection_rank") <= sample_size).select(
        *group, *place, "selection_key", "selection_rank")


def group_cols(id_cols: Sequence[str]) -> list[str]:
    """Identifying columns that aren't among region, size_class and province."""
    return [c for c in id_cols if c not in ("region", "size_class", "province")]
