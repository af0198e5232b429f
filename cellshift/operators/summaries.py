"""Summaries of metric tables: methods, seeds, areas, tiers and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, n_if, steady_mean
from .ranking import attach_row, group_agg, group_rank


def long_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], lower: Sequence[str] = ()) -> DataFrame:
    """Unpivot metric columns; ``higher`` tells the direction."""
    arr = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 F.lit(m not in lower).alias("higher"))
        for m in metrics
    ])
    return rows.select(*keys, F.inline(arr))


def _std(c: str) -> Column:
    """Sample deviation; 0 for a single value."""
    return F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def _spread(c: str, suffix: str) -> list[Column]:
    return [
        F.avg(c).alias(f"mean_{suffix}"), _std(c).alias(f"std_{suffix}"),
        F.min(c).alias(f"min_{suffix}"), F.max(c).alias(f"max_{suffix}"),
    ]


def finite_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median and sign counts of the finite values; an empty group has n = 0."""
    v = rows.withColumn("_v", finite(F.col(value)))
    x = F.col("_v")
    aggs = [
        F.count(x).alias("n"), F.avg(x).alias("mean"),
        n_if(x > 0).alias("n_positive"), n_if(x < 0).alias("n_negative"),
    ]
    return group_agg(v, keys, aggs, "_v", {"median": 0.5})


def summarise_scopes(rows: DataFrame, value: str) -> DataFrame:
    """Summaries by tier, by stratum and by both, in one pass over the rows."""
    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    t, s = text("tier"), text("stratum")
    scopes = F.array(
        F.struct(F.lit("tier").alias("scope"), t.alias("group")),
        F.struct(F.lit("stratum").alias("scope"), s.alias("group")),
        F.struct(F.lit("tier_stratum").alias("scope"), F.concat(t, F.lit("|"), s).alias("group")),
    )
    long = rows.select(F.col(value), F.inline(scopes)).filter(F.col("group").isNotNull())
    return finite_summary(long, ["scope", "group"], value)


def registry_summary(rows: DataFrame, value: Sequence[str]) -> DataFrame:
    """Evaluated and failed rows, and the means over the evaluated ones."""
    ok = F.col("qc_status") == "include"
    return rows.agg(
        n_if(ok).alias("n_evaluated"), n_if(~ok).alias("n_failed"),
        *[F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in value],
    )


def failure_list(rows: DataFrame) -> DataFrame:
    return rows.filter("qc_status <> 'include'").select("area", "excluded_reason")


def best_control(controls: Sequence[str], model: str, shuffled: str) -> list[Column]:
    """Best non-neural score and the two advantages of the model."""
    best = F.greatest(*[F.col(c) for c in controls])
    return [
        best.alias("best_non_neural"), (F.col(model) - best).alias("primary_advantage"),
        (F.col(model) - F.col(shuffled)).alias("spatial_advantage"),
    ]


def method_means(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(finite(F.col(m))).alias(f"mean_{m}") for m in metrics]
    )


def seeded_method_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per (method, area): n and mean/std/min/max of each metric over seeds."""
    cols = [c for m in metrics for c in _spread(m, m)]
    return rows.groupBy("method", "area").agg(F.count(F.lit(1)).alias("n"), *cols)


def seeded_deltas(
    rows: DataFrame, keys: Sequence[str], challenger: str, baseline: str, metrics: Sequence[str],
    lower: Sequence[str] = (),
) -> DataFrame:
    """Challenger minus baseline per key and metric (both must exist)."""
    both = rows.filter(F.col("method").isin(challenger, baseline))
    long = long_metrics(both, [*keys, "method"], metrics, lower)
    side = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    wide = long.groupBy(*keys, "metric", "higher").agg(
        side(challenger).alias("challenger_value"), side(baseline).alias("baseline_value")
    )
    delta = F.col("challenger_value") - F.col("baseline_value")
    wide = wide.filter("challenger_value is not null and baseline_value is not null")
    return wide.withColumn("delta", delta).withColumn(
        "better", F.when(F.col("higher"), delta > 0).otherwise(delta < 0)
    )


def delta_summary(deltas: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    better = n_if(F.col("better"))
    return deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *_spread("delta", "delta"), better.alias("n_better"),
        (better / F.count(F.lit(1))).alias("better_rate"),
    )


def overall_deltas(
    rows: DataFrame, challenger: str, baseline: str, metrics: Sequence[str], lower: Sequence[str] = ()
) -> DataFrame:
    """Average over areas first, then compare per seed."""
    means = rows.groupBy("seed", "method").agg(*[steady_mean(F.col(m)).alias(m) for m in metrics])
    return seeded_deltas(means, ["seed"], challenger, baseline, metrics, lower)


def cross_area_summary(deltas: DataFrame) -> DataFrame:
    """Per metric over areas: delta and benefit, better/worse counts, weighted better rate.

    ``deltas`` are per (seed, area, metric).
    """
    per = deltas.groupBy("metric", "higher", "area").agg(
        F.count(F.lit(1)).alias("n"), steady_mean(F.col("delta")).alias("mean_delta"), n_if(F.col("better")).alias("n_better")
    )
    benefit = F.when(F.col("higher"), F.col("mean_delta")).otherwise(-F.col("mean_delta"))
    per = per.withColumn("benefit", benefit)
    aggs = [
        F.count(F.lit(1)).alias("n_areas"), F.sum("n").alias("n_seed_pairs"),
        F.avg("mean_delta").alias("mean_area_delta"), F.avg("benefit").alias("mean_area_benefit"),
        n_if(F.col("benefit") > 0).alias("area_better_count"),
        n_if(F.col("n_better") == F.col("n")).alias("area_all_seed_better_count"),
        n_if(F.col("n_better") == 0).alias("area_all_seed_worse_count"),
        (F.sum("n_better") / F.sum("n")).alias("weighted_better_rate"),
    ]
    out = group_agg(per, ["metric", "higher"], aggs, "mean_delta", {"median_area_delta": 0.5})
    flip = F.when(F.col("higher"), F.col("median_area_delta")).otherwise(-F.col("median_area_delta"))
    return out.withColumn("median_area_benefit", flip)


def mean_advantages(
    rows: DataFrame, challenger: str, baseline: str, metrics: Sequence[str], lower: Sequence[str] = ()
) -> DataFrame:
    """Method means compared metric by metric."""
    means = rows.groupBy("method").agg(*[steady_mean(F.col(m)).alias(m) for m in metrics]).withColumn("_k", F.lit(1))
    return seeded_deltas(means, ["_k"], challenger, baseline, metrics, lower).drop("_k")


def acceptance_gates(
    means: DataFrame, overall: DataFrame, paired: DataFrame, need_means: int, need_seeds: int,
    n_seeds: int, need_allocation: int, need_fom: int,
) -> DataFrame:
    """One row per gate with observed, required and passed."""
    m = means.agg(n_if(F.col("better")).alias("observed")).select(
        F.lit("mean_wins").alias("gate"), F.lit("all").alias("metric"), "observed",
        F.lit(need_means).cast("bigint").alias("required"), F.lit(True).alias("_ok"),
    )
    alloc = F.col("metric") == "allocation_disagreement"
    s = overall.select(
        F.when(alloc, "allocation_seed_wins").otherwise("seed_wins").alias("gate"), "metric",
        F.col("n_better").alias("observed"),
        F.when(alloc, need_allocation).otherwise(need_seeds).cast("bigint").alias("required"),
        (F.col("n") == n_seeds).alias("_ok"),
    )
    f = paired.filter("metric = 'fom'").select(
        F.lit("paired_fom_wins").alias("gate"), "metric", F.col("n_better").alias("observed"),
        F.lit(need_fom).cast("bigint").alias("required"), F.lit(True).alias("_ok"),
    )
    out = m.unionByName(s).unionByName(f)
    return out.withColumn("passed", F.col("_ok") & (F.col("observed") >= F.col("required"))).drop("_ok")


def all_passed(gates: DataFrame) -> DataFrame:
    return gates.agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("n_gates"))


def failure_rows(deltas: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """FoM losses and allocation degradations above the tolerance."""
    fom = (F.col("metric") == "fom") & (F.col("delta") < 0)
    alloc = (F.col("metric") == "allocation_disagreement") & (F.col("delta") > tolerance)
    kind = F.when(fom, "fom_loss").when(alloc, "allocation_degradation")
    return deltas.withColumn("failure", kind).filter("failure is not null")


def comparison_mismatches(rows: DataFrame, challenger: str, baseline: str) -> DataFrame:
    """Rows whose challenger/baseline names differ from the expected pair."""
    return rows.filter((F.col("challenger") != challenger) | (F.col("baseline") != baseline))


def category_summary(rows: DataFrame, categories: dict[str, str], area: str, value: str) -> DataFrame:
    """Finite summary per category of a fixed area -> category table."""
    from ..functions.columns import lookup

    cat = rows.withColumn("category", lookup(categories, F.col(area).cast("string"), None))
    cat = cat.withColumn("_f", finite(F.col(value))).filter("category is not null and _f is not null")
    return finite_summary(cat, ["category"], "_f")


def category_members(rows: DataFrame, categories: dict[str, str], area: str, value: str) -> DataFrame:
    """The (category, area) rows behind ``category_summary``."""
    from ..functions.columns import lookup

    cat = rows.withColumn("category", lookup(categories, F.col(area).cast("string"), None))
    return cat.filter(F.col("category").isNotNull() & finite(F.col(value)).isNotNull()).select("category", area)


def planning_summary(rows: DataFrame, config: str, value: str, reference: str) -> DataFrame:
    """Mean, deviation and retention of each configuration against a reference one."""
    s = rows.groupBy(config).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_value"), _std(value).alias("std_value")
    )
    j = attach_row(s, s.filter(F.col(config) == reference).select(F.col("mean_value").alias("_ref")))
    return j.withColumn(
        "retention", F.when(F.col("_ref") != 0, F.col("mean_value") / F.col("_ref"))
    ).drop("_ref")


def transfer_summary(rows: DataFrame, config: str, value: str, references: Sequence[str]) -> DataFrame:
    """Mean, deviation and difference of each configuration to every reference."""
    s = rows.groupBy(config).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_value"), _std(value).alias("std_value")
    )
    pick = lambda r: F.max(F.when(F.col(config) == r, F.col("mean_value")))
    j = attach_row(s, s.agg(*[pick(r).alias(f"_{r}") for r in references]))
    return j.select(
        config, "n", "mean_value", "std_value",
        *[(F.col("mean_value") - F.col(f"_{r}")).alias(f"delta_vs_{r}") for r in references],
    )


def multistep_summary(rows: DataFrame) -> DataFrame:
    """Per step: means of persistence, model and advantage, spread and sign counts."""
    a = F.col("advantage")
    return rows.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("persistence").alias("mean_persistence"),
        F.avg("model").alias("mean_model"), F.avg(a).alias("mean_advantage"),
        F.stddev_samp(a).alias("sd_advantage"), n_if(a > 0).alias("n_pos"), n_if(a < 0).alias("n_neg"),
        F.min(a).alias("min_advantage"), F.max(a).alias("max_advantage"),
    )


def area_ranking(rows: DataFrame, value: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Sign counts and range; the k best positive and k worst negative areas."""
    v = F.col(value)
    agg = rows.agg(
        F.count(F.lit(1)).alias("n_total"), n_if(v > 0).alias("n_pos"), n_if(v < 0).alias("n_neg"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"),
    )
    # orderBy + limit is a distributed top-k
    best = rows.filter(v > 0).orderBy(v.desc(), "area").limit(k).select(F.lit("best").alias("list"), "area", value)
    worst = rows.filter(v < 0).orderBy(v.asc(), "area").limit(k).select(F.lit("worst").alias("list"), "area", value)
    return agg, best.unionByName(worst)


def valid_delta_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summary of deltas with status ok; others and NULLs are dropped."""
    keys = list(keys) or ["_all"]
    ok = rows.filter("status = 'ok' and delta is not null").withColumn("_all", F.lit("all"))
    d = F.col("delta")
    aggs = [
        F.count(d).alias("n_total"), n_if(d > 0).alias("n_improved"), n_if(d < 0).alias("n_degraded"),
        F.avg(d).alias("mean_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"),
        F.stddev_samp(d).alias("std_delta"),
    ]
    return group_agg(ok, keys, aggs, "delta", {"median_delta": 0.5}).drop("_all")


def stratum_focus(rows: DataFrame, stratum: str, tier: str) -> DataFrame:
    """Per batch: size, mean advantages, sign counts, best and worst area of one stratum."""
    f = rows.filter((F.col("stratum") == stratum) & (F.col("tier") == tier))
    order = F.struct("spatial_adv", "primary_adv", "area")
    return f.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("primary_adv").alias("mean_primary"),
        F.avg("spatial_adv").alias("mean_spatial"), n_if(F.col("spatial_adv") < 0).alias("n_negative"),
        n_if(F.col("spatial_adv") > 0).alias("n_positive"),
        F.min_by("area", order).alias("lowest_area"), F.max_by("area", order).alias("best_area"),
    )


def stratum_intervals(rows: DataFrame, stratum: str, tier: str, n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """Per batch: lower bootstrap limits of the mean primary and spatial advantage of one stratum over its areas."""
    from .inference import cluster_bootstrap

    f = rows.filter((F.col("stratum") == stratum) & (F.col("tier") == tier))
    p = cluster_bootstrap(f, ["batch"], "area", "primary_adv", n_boot, seed).select("batch", F.col("ci_low").alias("primary_ci_low"))
    s = cluster_bootstrap(f, ["batch"], "area", "spatial_adv", n_boot, seed + 1).select("batch", F.col("ci_low").alias("spatial_ci_low"))
    return p.join(s, "batch", "full_outer")


def stratum_ranking(rows: DataFrame, stratum: str, tier: str) -> DataFrame:
    """Rows of one stratum per batch, lowest spatial advantage first: (batch, rank, area, spatial_adv, primary_adv)."""
    f = rows.filter((F.col("stratum") == stratum) & (F.col("tier") == tier))
    return group_rank(f, ["batch"], ["spatial_adv", "primary_adv", "area"], "rank").select(
        "batch", "rank", "area", "spatial_adv", "primary_adv")


def win_loss(
    rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], model: str, lower: Sequence[str], changed: str
) -> DataFrame:
    """Model against every other method per key and metric, ill-defined pairs dropped."""
    from .cells import versus_reference

    ok = rows.filter(F.col(changed) > 0)
    v = versus_reference(ok, keys, model, metrics, lower)
    return v.select(
        *keys, "metric", F.col("method").alias("control"), F.col("ref_value").alias("model_value"),
        F.col("value").alias("control_value"),
        (F.col("ref_value") - F.col("value")).alias("delta"), (F.col("advantage") < 0).alias("model_won"),
    )


def finite_means(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(finite(F.col(m))).alias(f"mean_{m}") for m in metrics])


def grid_summary(rows: DataFrame, cell: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of the metrics per parameter cell."""
    cols = [c for m in metrics for c in (F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"))]
    return rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *cols)


def metric_ranges(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, low, high, spread) of the cell means of ``grid_summary``."""
    long = summary.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("v")) for m in metrics])))
    return long.groupBy("metric").agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.max("v") - F.min("v")).alias("spread"))


def multistep_disclosure(areas: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded steps of an area, else one 1-step row, with a status."""
    j = areas.join(recorded.select("area", "step", F.col("advantage").alias("_rec")), "area", "left")
    return j.select(
        "area", F.coalesce("step", F.lit(1)).alias("step"),
        F.coalesce("_rec", "advantage").alias("advantage"),
        F.when(F.col("step").isNull(), "one_step_only").otherwise("recorded").alias("status"),
    )


def redecode_delta(published: DataFrame, redecoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New minus published end accuracy; pairs without true change are dropped, missing ones flagged."""
    j = published.filter("true_change_pixels > 0").join(redecoded, list(keys), "left")
    status = F.when(F.col("end_accuracy").isNull(), "missing_input").otherwise("ok")
    return j.select(
        *keys, status.alias("status"), (F.col("end_accuracy") - F.col("published_accuracy")).alias("delta")
    )


def focus_bundle(metrics: DataFrame, focus: str, others: Sequence[str]) -> DataFrame:
    """Metric rows of a focus area and its comparison areas, with a role; the focus must exist."""
    wanted = metrics.filter(F.col("area").isin([focus, *others]))
    return wanted.withColumn("role", F.when(F.col("area") == focus, "focus").otherwise("comparison"))


def focus_report(cells: DataFrame, focus: int, others: Sequence[int], prob: str) -> tuple[DataFrame, DataFrame]:
    """Diagnostics of a focus area next to its comparison areas; a focus without cells is an error.

    First table, one row per area: role, best shift of the prediction with its scores, decode accuracies, and the most
    frequent true transition. Second table: confidence in the true end class by (area, class), with the role.
    """
    from . import mapmetrics as M
    from . import neighbourhood as H

    chosen = cells.filter(F.col("area").isin([focus, *others]))
    if chosen.filter(F.col("area") == focus).isEmpty():
        raise ValueError(f"no cells of the focus area {focus}")
    role = F.when(F.col("area") == focus, "focus").otherwise("comparison").alias("role")
    cont = M.contingency(chosen, ["area"])
    top = M.top_transitions(cont, ["area"], "end_cls", 1).drop("rank").withColumnsRenamed(
        {"from_cls": "top_from", "to_cls": "top_to", "n": "top_n"})
    rows = H.best_shift(chosen, ["area"]).join(M.pixel_accuracy(cont, ["area"]), "area", "left").join(top, "area", "left")
    confidence = M.confidence_by_true_class(chosen, ["area"], "end_cls", prob, "pred_cls")
    return rows.select("*", role), confidence.select("*", role)


def ranked_report(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rank of every row per key by a full ascending order that ends in a unique column."""
    return group_rank(rows, keys, order, "rank")


def set_difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values in only one of two sets, with the side they belong to."""
    x, y = a.select(col).distinct(), b.select(col).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(
        y.exceptAll(x).withColumn("side", F.lit("right"))
    )


