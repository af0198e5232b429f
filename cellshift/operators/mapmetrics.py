"""Map comparison and class statistics.

Cells are reduced first to a contingency table (keys, start, end, predicted, n):
one map-side-combined aggregate whose size depends on the number of classes, not
on the number of cells.  Every metric is then a small aggregate over that table,
so one huge area costs no more than many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import f1_score, n_if, ratio, transition_label
from .ranking import attach_row, attach_table, group_agg, join_small


def contingency(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells -> (keys, start_cls, end_cls, pred_cls, n)."""
    return cells.groupBy(*keys, "start_cls", "end_cls", "pred_cls").agg(
        F.count(F.lit(1)).alias("n")
    )


def binary_change(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp / fp / fn and precision, recall, F1 of predicted change (0 when undefined)."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    t, p = E != S, P != S
    out = cont.groupBy(*keys).agg(
        n_if(t & p, N).alias("tp"), n_if(~t & p, N).alias("fp"), n_if(t & ~p, N).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def figure_of_merit(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correctly predicted change over the union of true and predicted change; 1 if empty."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    t, p = E != S, P != S
    hit, union = n_if(t & (P == E), N), n_if(t | p, N)
    return cont.groupBy(*keys).agg(ratio(hit, union, 1.0).alias("fom"))


def transition_accuracy(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of truly changed cells with the right end class; 1 if none changed."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    t = E != S
    return cont.groupBy(*keys).agg(
        ratio(n_if(t & (P == E), N), n_if(t, N), 1.0).alias("transition_accuracy")
    )


def class_balance(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per class: cells in the end map, cells in the prediction."""
    E, P, N = F.col("end_cls"), F.col("pred_cls"), F.col("n")
    both = F.array(
        F.struct(E.alias("cls"), N.alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(P.alias("cls"), F.lit(0).cast("bigint").alias("t"), N.alias("p")),
    )
    return cont.select(*keys, F.inline(both)).groupBy(*keys, "cls").agg(
        F.sum("t").alias("n_true"), F.sum("p").alias("n_pred")
    )


def quantity_disagreement(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    diff = F.abs(F.col("n_true") - F.col("n_pred"))
    return class_balance(cont, keys).groupBy(*keys).agg(
        ratio(F.sum(diff), 2 * F.sum("n_true")).alias("quantity_disagreement")
    )


def area_bias(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over the classes of either map of |predicted share - true share|."""
    diff = F.abs(F.col("n_true") - F.col("n_pred"))
    return class_balance(cont, keys).groupBy(*keys).agg(
        ratio(F.sum(diff) / F.count(F.lit(1)), F.sum("n_true")).alias("area_bias_mae")
    )


def allocation_disagreement(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """max(0, error rate - quantity disagreement)."""
    E, P, N = F.col("end_cls"), F.col("pred_cls"), F.col("n")
    acc = cont.groupBy(*keys).agg(
        n_if(P == E, N).alias("_ok"), F.sum("n").alias("_all")
    )
    out = acc.join(quantity_disagreement(cont, keys), list(keys))
    err = F.lit(1.0) - F.col("_ok") / F.col("_all")
    return out.select(
        *keys,
        F.greatest(F.lit(0.0), err - F.col("quantity_disagreement")).alias(
            "allocation_disagreement"
        ),
    )


def metric_row(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All map-comparison metrics in one row per key, from one contingency table."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    t, p = E != S, P != S
    wide = cont.groupBy(*keys).agg(
        n_if(t & p, N).alias("tp"),
        n_if(~t & p, N).alias("fp"),
        n_if(t & ~p, N).alias("fn"),
        n_if(t & (P == E), N).alias("_hit"),
        n_if(t | p, N).alias("_union"),
        n_if(t, N).alias("_true"),
        n_if(P == E, N).alias("_ok"),
        F.sum("n").alias("n_cells"),
    )
    wide = wide.join(quantity_disagreement(cont, keys), list(keys))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    err = F.lit(1.0) - F.col("_ok") / F.col("n_cells")
    wide = wide.withColumns(
        {"change_precision": ratio(tp, tp + fp), "change_recall": ratio(tp, tp + fn)}
    )
    return wide.select(
        *keys,
        "n_cells",
        "change_precision",
        "change_recall",
        f1_score(F.col("change_precision"), F.col("change_recall")).alias("change_f1"),
        ratio(F.col("_hit"), F.col("_union"), 1.0).alias("fom"),
        ratio(F.col("_hit"), F.col("_true"), 1.0).alias("transition_accuracy"),
        "quantity_disagreement",
        F.greatest(F.lit(0.0), err - F.col("quantity_disagreement")).alias(
            "allocation_disagreement"
        ),
    )


def stack_methods(cells: DataFrame, methods: dict[str, str]) -> DataFrame:
    """One row per cell and method: ``methods`` maps a name to a prediction column."""
    arr = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(c).alias("pred_cls")) for m, c in methods.items()]
    )
    rest = [c for c in cells.columns if c not in methods.values()]
    return cells.select(*rest, F.inline(arr))


def method_contingency(
    cells: DataFrame, keys: Sequence[str], methods: dict[str, str]
) -> DataFrame:
    """Contingency per method, stacked after the cells were aggregated once."""
    wide = cells.groupBy(*keys, "start_cls", "end_cls", *dict.fromkeys(methods.values())).agg(
        F.count(F.lit(1)).alias("n")
    )
    arr = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(c).alias("_p")) for m, c in methods.items()]
    )
    rows = wide.select(*keys, "start_cls", "end_cls", "n", F.inline(arr))
    return rows.groupBy("method", *keys, "start_cls", "end_cls", F.col("_p").alias("pred_cls")).agg(
        F.sum("n").alias("n")
    )


def variant_metrics(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric dialect of the sensitivity study: only cells with an end label count."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    v, t, p = E > 0, E != S, P != S
    out = cont.groupBy(*keys).agg(
        n_if(v & t & p, N).alias("tp"),
        n_if(v & ~t & p, N).alias("fp"),
        n_if(v & t & ~p, N).alias("fn"),
        n_if(v & ~t & ~p, N).alias("tn"),
        n_if(v, N).alias("n_valid"),
        n_if(v & t & (P == E), N).alias("_hit"),
        n_if(v & t, N).alias("_true"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pr, rc = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return out.select(
        *keys, "tp", "fp", "fn", "tn", "n_valid",
        f1_score(pr, rc).alias("change_f1"),
        ratio(tp, tp + fp + fn).alias("fom"),
        (F.col("_hit") / F.greatest(F.col("_true"), F.lit(1))).alias("transition_accuracy"),
        ((fp + fn) / F.greatest(F.col("n_valid"), F.lit(1))).alias("allocation_disagreement"),
    )


def validation_row(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change scores, end accuracy, changed-cell accuracy and area bias (0 on empty)."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    t = E != S
    acc = cont.groupBy(*keys).agg(
        ratio(n_if(P == E, N), F.sum("n")).alias("end_accuracy"),
        ratio(n_if(t & (P == E), N), n_if(t, N)).alias("changed_cell_accuracy"),
    )
    b = binary_change(cont, keys).select(*keys, "precision", "recall", "f1")
    return b.join(acc, list(keys)).join(area_bias(cont, keys), list(keys))


def transition_confusion(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True -> predicted transition labels of the truly changed cells."""
    S, E, P = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls")
    return (
        cont.filter(E != S)
        .groupBy(
            *keys,
            transition_label(S, E).alias("true_transition"),
            transition_label(S, P).alias("pred_transition"),
        )
        .agg(F.sum("n").alias("n"))
    )


def pixel_accuracy(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of cells equal to the end map, and of cells equal to the start map."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    return cont.groupBy(*keys).agg(
        ratio(n_if(P == E, N), F.sum("n")).alias("end_accuracy"),
        ratio(n_if(P == S, N), F.sum("n")).alias("start_accuracy"),
    )


def class_distribution(
    cells: DataFrame, keys: Sequence[str], cls: str, known: Sequence[int]
) -> DataFrame:
    """Cells and percent (2 dp) per known class; the percent is of all cells."""
    counts = cells.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    out = counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 2))
    return out.filter(F.col(cls).isin(list(known)))


def transition_matrix(
    cont: DataFrame, keys: Sequence[str], known: Sequence[int], to: str = "end_cls"
) -> DataFrame:
    """(from, to, n) over known classes."""
    S = F.col("start_cls")
    return (
        cont.filter(S.isin(list(known)) & F.col(to).isin(list(known)))
        .groupBy(*keys, S.alias("from_cls"), F.col(to).alias("to_cls"))
        .agg(F.sum("n").alias("n"))
    )


def matrix_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-zero differences a - b of two transition matrices."""
    on = [*keys, "from_cls", "to_cls"]
    j = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), on, "full_outer")
    diff = F.coalesce(F.col("_a"), F.lit(0)) - F.coalesce(F.col("_b"), F.lit(0))
    return j.select(*on, diff.cast("bigint").alias("diff")).filter(F.col("diff") != 0)


def period_summary(
    cont: DataFrame, keys: Sequence[str], urban: int, outside: Sequence[int] = (0,)
) -> DataFrame:
    """Changed, persistent, to-urban and from-urban cells, outside values excluded."""
    S, E, N = F.col("start_cls"), F.col("end_cls"), F.col("n")
    out_vals = list(outside)
    inside = cont.filter(~S.isin(out_vals) & ~E.isin(out_vals))
    agg = inside.groupBy(*keys).agg(
        F.sum("n").alias("n_valid"),
        n_if(S != E, N).alias("n_changed"),
        n_if(S == E, N).alias("n_persistent"),
        n_if((S != urban) & (E == urban), N).alias("to_urban"),
        n_if((S == urban) & (E != urban), N).alias("from_urban"),
    )
    return agg.withColumn("changed_share", ratio(F.col("n_changed"), F.col("n_valid")))


def raster_profile(
    cells: DataFrame, keys: Sequence[str], cls: str, outside: Sequence[int] = (0,)
) -> DataFrame:
    """Per class: cells and share of valid cells, with valid/outside totals and extent."""
    per = cells.groupBy(*keys, cls).agg(
        F.count(F.lit(1)).alias("n"), F.max("row").alias("_r"), F.max("col").alias("_c")
    )
    w = W.partitionBy(*keys)
    out = F.col(cls).isin(list(outside))
    n_valid = F.sum(F.when(~out, F.col("n")).otherwise(0)).over(w)
    return per.select(
        *keys, cls, "n",
        n_valid.alias("n_valid"),
        (F.sum("n").over(w) - n_valid).alias("n_outside"),
        (F.max("_r").over(w) + 1).alias("height"),
        (F.max("_c").over(w) + 1).alias("width"),
        F.when(~out, ratio(F.col("n"), n_valid)).alias("share"),
    )


def grid_profile(
    cells: DataFrame, keys: Sequence[str], value: str, masked: Column
) -> DataFrame:
    """min / max / mean of a continuous grid over its unmasked cells."""
    v = F.when(~masked, F.col(value))
    return cells.groupBy(*keys).agg(
        F.count(v).alias("n_unmasked"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
    )


def transition_prior(
    counts: DataFrame, keys: Sequence[str], classes: Sequence[int]
) -> DataFrame:
    """Row-normalised (from, to) shares; known classes only, unseen targets 0.

    ``counts`` holds (keys, from_cls, to_cls, n).
    """
    kept = counts.filter(F.col("from_cls").isin(list(classes)) & F.col("to_cls").isin(list(classes)))
    rows = kept.groupBy(*keys, "from_cls").agg(
        F.sum("n").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("to_cls", "n"))).alias("_m"),
    )
    long = rows.select(*keys, "from_cls", "_total", "_m",
                       F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("to_cls"))
    n = F.coalesce(F.try_element_at("_m", F.col("to_cls")), F.lit(0))
    return long.filter(F.col("_total") > 0).select(
        *keys, "from_cls", "to_cls", (n / F.col("_total")).alias("prior")
    )


def candidate_hits(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted-change cells per (from, to): total, exact hits, binary hits."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    ok = (S != 0) & (E != 0) & (P != 0) & (P != S)
    return (
        cont.filter(ok)
        .groupBy(*keys, S.alias("from_cls"), P.alias("to_cls"))
        .agg(
            F.sum("n").alias("n"),
            n_if((E == P) & (E != S), N).alias("exact"),
            n_if(E != S, N).alias("binary_hits"),
        )
    )


def add_totals(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the key-level totals (g_n, g_exact, g_binary) to per-transition counts."""
    if keys:
        w = W.partitionBy(*keys)
        return hits.withColumns(
            {
                "g_n": F.sum("n").over(w),
                "g_exact": F.sum("exact").over(w),
                "g_binary": F.sum("binary_hits").over(w),
            }
        )
    tot = hits.agg(
        F.sum("n").alias("g_n"), F.sum("exact").alias("g_exact"), F.sum("binary_hits").alias("g_binary")
    )
    return attach_row(hits, tot)


def transition_reliability(
    hits: DataFrame, keys: Sequence[str], alpha: float = 0.5, smoothing: float = 500.0
) -> DataFrame:
    """Smoothed exact and binary hit rates per transition, mixed by ``alpha``."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be in [0, 1]: {alpha}")
    if smoothing < 0.0:
        raise ValueError(f"smoothing must be non-negative: {smoothing}")
    t = add_totals(hits, keys)
    ge = ratio(F.col("g_exact"), F.col("g_n"))
    gb = ratio(F.col("g_binary"), F.col("g_n"))
    den = F.col("n") + F.lit(smoothing)
    ex = (F.col("exact") + F.lit(smoothing) * ge) / den
    bi = (F.col("binary_hits") + F.lit(smoothing) * gb) / den
    mix = lambda e, b: F.lit(alpha) * e + F.lit(1.0 - alpha) * b
    return t.select(
        *keys, "from_cls", "to_cls", "n",
        mix(ex, bi).alias("reliability"), mix(ge, gb).alias("global_reliability"),
    )


def reliability_weights(
    hits: DataFrame, keys: Sequence[str], smoothing: float = 1.0, floor: float = 0.2
) -> DataFrame:
    """Smoothed precision per transition mapped to [floor, 1], plus the default weight."""
    if smoothing < 0.0 or not 0.0 <= floor <= 1.0:
        raise ValueError("smoothing must be >= 0 and floor in [0, 1]")
    t = add_totals(hits, keys)
    base = ratio(F.col("g_exact"), F.col("g_n"))
    prec = (F.col("exact") + F.lit(smoothing) * base) / (F.col("n") + F.lit(smoothing))
    raw = F.lit(floor) + F.lit(1.0 - floor) * prec
    return t.select(
        *keys, "from_cls", "to_cls",
        F.least(F.lit(1.0), F.greatest(F.lit(floor), raw)).alias("weight"),
        (F.lit(floor) + F.lit(1.0 - floor) * base).alias("default_weight"),
    )


def class_count_ratio(
    cont: DataFrame, keys: Sequence[str], smoothing: float = 0.0
) -> DataFrame:
    """Observed over predicted cells per class on valid cells; 1 for a zero denominator."""
    S, E, P = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls")
    bal = class_balance(cont.filter((S != 0) & (E != 0) & (P != 0)), keys)
    num, den = F.col("n_true") + F.lit(smoothing), F.col("n_pred") + F.lit(smoothing)
    return bal.select(*keys, "cls", F.when(den > 0, num / den).otherwise(1.0).alias("ratio"))


def collapse_expansion(
    cont: DataFrame, keys: Sequence[str], shrinking: int, growing: int,
    min_start: float = 0.03, max_ratio: float = 0.30, min_growth: float = 0.03,
) -> DataFrame:
    """Does one class nearly vanish in the prediction while another expands?"""
    S, P, N = F.col("start_cls"), F.col("pred_cls"), F.col("n")
    v = (S != 0) & (P != 0)
    a = cont.groupBy(*keys).agg(
        n_if(v, N).alias("n_valid"),
        n_if(v & (S == shrinking), N).alias("shrink_start"),
        n_if(v & (P == shrinking), N).alias("shrink_pred"),
        n_if(v & (S == growing), N).alias("grow_start"),
        n_if(v & (P == growing), N).alias("grow_pred"),
    )
    n = F.col("n_valid")
    trig = (
        (n > 0)
        & (ratio(F.col("shrink_start"), n) >= min_start)
        & (ratio(F.col("shrink_pred"), F.col("shrink_start"), 1.0) <= max_ratio)
        & (ratio(F.col("grow_pred") - F.col("grow_start"), n) >= min_growth)
    )
    return a.withColumn("triggered", trig)


def change_features(cont: DataFrame, keys: Sequence[str], selector: int = 5) -> DataFrame:
    """Per area: change share, selector-class shares, class entropy, class richness."""
    S, P, N = F.col("start_cls"), F.col("pred_cls"), F.col("n")
    v = cont.filter((S != 0) & (P != 0))
    per = v.groupBy(*keys, "start_cls").agg(
        F.sum("n").alias("_n"),
        n_if(P != S, N).alias("_ch"),
        n_if(P == selector, N).alias("_ps"),
    )
    w = W.partitionBy(*keys)
    share = F.col("_n") / F.sum("_n").over(w)
    per = per.withColumn("_h", -share * F.ln(F.greatest(share, F.lit(1e-12))))
    a = per.groupBy(*keys).agg(
        F.sum("_n").alias("n_valid"),
        F.sum("_ch").alias("_ch"),
        F.sum(F.when(S == selector, F.col("_n")).otherwise(0)).alias("_ss"),
        F.sum("_ps").alias("_ps"),
        F.sum("_h").alias("_h"),
        F.count(F.lit(1)).alias("_k"),
    )
    n = F.col("n_valid")
    return a.select(
        *keys, "n_valid",
        (F.col("_ch") / n).alias("change_fraction"),
        (F.col("_ss") / n).alias("start_selector_fraction"),
        (F.col("_ps") / n).alias("pred_selector_fraction"),
        (F.col("_h") / F.greatest(F.ln(F.greatest(F.col("_k"), F.lit(2))), F.lit(1e-12))).alias(
            "entropy"
        ),
        F.least(F.lit(1.0), F.col("_k") / F.lit(10.0)).alias("richness"),
    )


def reciprocal_churn(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of predicted change that is mirrored by the opposite transition."""
    S, P, N = F.col("start_cls"), F.col("pred_cls"), F.col("n")
    pair = cont.filter(P != S).groupBy(
        *keys, F.least(S, P).alias("a"), F.greatest(S, P).alias("b")
    ).agg(n_if(S < P, N).alias("_up"), n_if(S > P, N).alias("_down"))
    agg = pair.groupBy(*keys).agg(
        F.sum(2 * F.least("_up", "_down")).alias("_rec"), F.sum(F.col("_up") + F.col("_down")).alias("_all")
    )
    base = cont.select(*keys).distinct()
    return base.join(agg, list(keys), "left").select(
        *keys, F.coalesce(ratio(F.col("_rec"), F.col("_all")), F.lit(0.0)).alias("churn")
    )


def pair_evidence(
    cont: DataFrame, keys: Sequence[str], prior: DataFrame, pairs: DataFrame,
    min_fraction: float, min_expected: float,
) -> DataFrame:
    """Reciprocal share of gross change and prior-expected cells of each class pair."""
    S, P = F.col("start_cls"), F.col("pred_cls")
    pred = cont.filter(P != S).groupBy(*keys, S.alias("from_cls"), P.alias("to_cls")).agg(
        F.sum("n").alias("_p")
    )
    gross = pred.groupBy(*keys).agg(F.sum("_p").alias("_gross"))
    starts = cont.groupBy(*keys, S.alias("from_cls")).agg(F.sum("n").alias("_s"))
    directed = pairs.select("a", "b", F.inline(F.expr(
        "array(named_struct('from_cls', a, 'to_cls', b), named_struct('from_cls', b, 'to_cls', a))"
    )))
    want = attach_table(cont.select(*keys).distinct(), directed)
    j = (
        want.join(pred, [*keys, "from_cls", "to_cls"], "left")
        .join(starts, [*keys, "from_cls"], "left")
        .join(prior, [*[k for k in keys if k in prior.columns], "from_cls", "to_cls"], "left")
    )
    agg = j.groupBy(*keys, "a", "b").agg(
        F.min(F.coalesce("_p", F.lit(0))).alias("_min"),
        F.sum(F.coalesce("_s", F.lit(0)) * F.coalesce("prior", F.lit(0.0))).alias("expected_pixels"),
    )
    agg = agg.join(gross, list(keys), "left")
    frac = F.coalesce(ratio(2 * F.col("_min"), F.col("_gross")), F.lit(0.0))
    return agg.select(
        *keys, "a", "b", frac.alias("reciprocal_fraction"), "expected_pixels",
        ((frac >= min_fraction) & (F.col("expected_pixels") >= min_expected)).alias("evidence"),
    )


def class_bias(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most over- and under-estimated class (lowest class wins ties)."""
    b = class_balance(cont, keys).withColumn("_d", F.col("n_pred") - F.col("n_true"))
    top = F.min(F.struct((-F.col("_d")).alias("d"), F.col("cls").alias("c")))
    low = F.min(F.struct(F.col("_d").alias("d"), F.col("cls").alias("c")))
    return b.groupBy(*keys).agg(top.alias("t"), low.alias("l")).select(
        *keys,
        F.col("t.c").alias("over_cls"), (-F.col("t.d")).alias("over_by"),
        F.col("l.c").alias("under_cls"), (-F.col("l.d")).alias("under_by"),
    )


def class_weights(counts: DataFrame, lo: float = 0.25, hi: float = 4.0) -> DataFrame:
    """sqrt(median count / count) clipped, over classes with a positive count (cls, n)."""
    pos = counts.filter(F.col("n") > 0)
    med = pos.agg(F.percentile("n", F.lit(0.5)).alias("_med"))
    w = F.sqrt(F.col("_med") / F.col("n"))
    return attach_row(pos, med).select(
        "cls", "n", F.least(F.lit(hi), F.greatest(F.lit(lo), w)).alias("weight")
    )


def positive_weight(cont: DataFrame, keys: Sequence[str], cap: float = 10.0) -> DataFrame:
    """min(cap, max(1, unchanged / changed)); 1 when nothing changed."""
    S, E, N = F.col("start_cls"), F.col("end_cls"), F.col("n")
    a = cont.groupBy(*keys).agg(n_if(E != S, N).alias("pos"), n_if(E == S, N).alias("neg"))
    w = F.least(F.lit(cap), F.greatest(F.lit(1.0), F.col("neg") / F.col("pos")))
    return a.withColumn("pos_weight", F.when(F.col("pos") > 0, w).otherwise(1.0))


def centroid(cells: DataFrame, keys: Sequence[str], changed: Column, prefix: str) -> DataFrame:
    """Mean row and column of the changed cells; NULL if there are none."""
    return cells.groupBy(*keys).agg(
        F.avg(F.when(changed, F.col("row"))).alias(f"{prefix}_row"),
        F.avg(F.when(changed, F.col("col"))).alias(f"{prefix}_col"),
    )


def spillover(cells: DataFrame, keys: Sequence[str], zone: Column, base: str, alt: str) -> DataFrame:
    """Cells outside a zone whose alternative class differs from the base class."""
    outside = n_if(~zone)
    hit = n_if(~zone & (F.col(base) != F.col(alt)))
    return cells.groupBy(*keys).agg(
        hit.alias("n_spill"), outside.alias("n_outside"),
        F.round(F.lit(100.0) * hit / F.greatest(outside, F.lit(1)), 2).alias("spill_pct"),
    )


def counterfactual(cells: DataFrame, keys: Sequence[str], a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Scenario A vs B: changed cells and percent; percent difference per class."""
    pair = cells.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    diff = n_if(F.col(a) != F.col(b), F.col("n"))
    total = F.sum("n")
    changed = pair.groupBy(*keys).agg(
        diff.alias("n_diff"), F.round(F.lit(100.0) * diff / total, 2).alias("diff_pct")
    )
    sides = pair.select(*keys, F.inline(F.array(
        F.struct(F.col(a).alias("cls"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")),
        F.struct(F.col(b).alias("cls"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")),
    ))).groupBy(*keys, "cls").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    w = W.partitionBy(*keys)
    pct = F.lit(100.0) * F.col("na") / F.sum("na").over(w) - F.lit(100.0) * F.col("nb") / F.sum("nb").over(w)
    return changed, sides.select(*keys, "cls", F.round(pct, 2).alias("pct_diff"))


def top_transitions(cont: DataFrame, keys: Sequence[str], to: str, limit: int) -> DataFrame:
    """Most frequent changed transitions per key (count desc, then classes)."""
    S = F.col("start_cls")
    t = cont.filter(S != F.col(to)).groupBy(
        *keys, S.alias("from_cls"), F.col(to).alias("to_cls")
    ).agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "from_cls", "to_cls")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def class_count_summary(counts: DataFrame, keys: Sequence[str], k: int, out: str) -> DataFrame:
    """"cls:n;cls:n" text of the k most frequent classes (cls, n)."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("cls").alias("c"))))
    text = F.transform(F.slice(items, 1, k), lambda x: F.concat_ws(":", x["c"], -x["m"]))
    return counts.groupBy(*keys).agg(F.array_join(text, ";").alias(out))


def confidence_by_true_class(
    cells: DataFrame, keys: Sequence[str], true: str, prob: str, decoded: str
) -> DataFrame:
    """Per true class: n, mean and median probability, most frequent decoded class."""
    k = [*keys, true]
    stats = group_agg(
        cells, k,
        [F.count(F.lit(1)).alias("n"), F.round(F.avg(prob), 6).alias("mean_prob")],
        prob, {"median_prob": 0.5},
    ).withColumn("median_prob", F.round("median_prob", 6))
    modes = cells.groupBy(*k, decoded).agg(F.count(F.lit(1)).alias("_c"))
    modal = modes.groupBy(*k).agg(
        F.min(F.struct((-F.col("_c")).alias("m"), F.col(decoded).alias("d"))).alias("t")
    ).select(*k, F.col("t.d").alias("modal_cls"), (-F.col("t.m")).alias("modal_n"))
    return stats.join(modal, k)


def transition_fate(
    cells: DataFrame, keys: Sequence[str], prob: str, limit: int, k: int
) -> DataFrame:
    """Fate of the top true transitions: predicted class mix and true-end probability."""
    S, E, P = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls")
    cont = contingency(cells, keys)
    top = top_transitions(cont, keys, "end_cls", limit)
    tk = [*keys, "from_cls", "to_cls"]
    mix = cont.select(*keys, S.alias("from_cls"), E.alias("to_cls"), P.alias("cls"), "n").join(
        top.select(*tk), tk
    )
    mix = mix.groupBy(*tk, "cls").agg(F.sum("n").alias("n"))
    text = class_count_summary(mix, tk, k, "pred_mix")
    chosen = cells.filter(S != E).select(*keys, S.alias("from_cls"), E.alias("to_cls"), F.col(prob))
    chosen = join_small(chosen, top.select(*tk), tk, how="inner")
    stats = group_agg(chosen, tk, [F.round(F.avg(prob), 6).alias("mean_prob")], prob,
                      {"median_prob": 0.5}).withColumn("median_prob", F.round("median_prob", 6))
    return top.join(text, tk).join(stats, tk)


def top_mean_probabilities(probs: DataFrame, keys: Sequence[str], k: int = 2) -> DataFrame:
    """Classes with the highest mean probability; ``probs`` is long (keys, cls, p)."""
    m = probs.groupBy(*keys, "cls").agg(F.round(F.avg("p"), 6).alias("mean_prob"))
    w = W.partitionBy(*keys).orderBy(F.desc("mean_prob"), "cls")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def confusion_report(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row-normalised confusion cells, and precision/recall/F1 per class (true, pred, n)."""
    w = W.partitionBy("true_cls")
    cells = counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(w)))
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("true_cls").alias("cls"), F.col("n").alias("t"),
                 F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("true_cls") == F.col("pred_cls"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("pred_cls").alias("cls"), F.lit(0).cast("bigint").alias("t"),
                 F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    ))).groupBy("cls").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    pr, rc = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("t"))
    per = sides.select(
        "cls", F.col("t").alias("support"), pr.alias("precision"), rc.alias("recall"),
        f1_score(pr, rc).alias("f1"),
    )
    return cells, per


def distribution_delta(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent difference per class of two class distributions (cls, pct)."""
    on = [*keys, "cls"]
    j = a.select(*on, F.col("pct").alias("_a")).join(b.select(*on, F.col("pct").alias("_b")), on, "full_outer")
    d = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return j.select(*on, F.round(d, 2).alias("pct_diff"))




def shifted_fate(cells: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Matches of the raw and of the shifted prediction for the top true transitions."""
    S, E, P, N = F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"), F.col("n")
    wide = cells.groupBy(*keys, "start_cls", "end_cls", "pred_cls", "shifted_cls").agg(
        F.count(F.lit(1)).alias("n")
    )
    top = top_transitions(wide, keys, "end_cls", limit)
    tk = [*keys, "from_cls", "to_cls"]
    hits = wide.groupBy(*keys, S.alias("from_cls"), E.alias("to_cls")).agg(
        n_if(P == E, N).alias("raw_matches"),
        n_if(F.col("shifted_cls") == E, N).alias("shifted_matches"),
    )
    out = top.join(hits, tk)
    for col, name in (("pred_cls", "raw_top"), ("shifted_cls", "shifted_top")):
        out = out.join(_class_text(wide.withColumnsRenamed({"start_cls": "from_cls", "end_cls": "to_cls"}), tk, col, name), tk)
    return out


def _class_text(counts: DataFrame, keys: Sequence[str], cls: str, out: str, limit: int = 4) -> DataFrame:
    """"class:count;..." of the most frequent classes per key, smaller class first among equals."""
    n = counts.groupBy(*keys, F.col(cls).alias("_c")).agg(F.sum("n").alias("_n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col("_c").alias("c")))), 1, limit)
    return n.groupBy(*keys).agg(F.array_join(
        F.transform(ranked, lambda x: F.concat_ws(":", x["c"].cast("string"), (-x["m"]).cast("string"))), ";").alias(out))
