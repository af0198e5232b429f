"""Summaries of the metric table, plus report sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import steady_mean
from ..operators import mapmetrics as M
from ..operators import summaries as S
from . import bindings as B
from .q_mapmetrics import _METHODS, method_metrics
from .registry import query, sql

A, C = "click", "error"


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def deltas(spark, sf):
    return S.seeded_deltas(B.seeded(spark, sf), ["seed", "area"], A, C, B.METRICS, B.LOWER)


@query("e01_summary_by_scope", sql("adv", """
l AS (SELECT 'tier' AS scope, tier AS grp, primary_adv AS v FROM adv UNION ALL SELECT 'stratum', stratum, primary_adv FROM adv
 UNION ALL SELECT 'tier_stratum', tier || '|' || stratum, primary_adv FROM adv)""", """
SELECT scope, grp AS "group", count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
 sum((v>0)::INT)::BIGINT AS n_positive, sum((v<0)::INT)::BIGINT AS n_negative FROM l GROUP BY ALL"""))
def e01(spark, sf):
    return r6(S.summarise_scopes(B.advantages(spark, sf), "primary_adv"), "mean", "median")


_REGM = """
rm AS (SELECT area, primary_adv, spatial_adv, CASE WHEN area % 9 = 4 THEN 'exclude' ELSE 'include' END AS qc_status,
 CASE WHEN area % 9 = 4 THEN 'missing_label' ELSE '' END AS excluded_reason FROM adv)"""


def registry_metrics(spark, sf):
    return B.advantages(spark, sf).selectExpr(
        "area", "primary_adv", "spatial_adv", "if(area % 9 = 4, 'exclude', 'include') as qc_status",
        "if(area % 9 = 4, 'missing_label', '') as excluded_reason")


@query("e02_registry_summary", sql("adv", _REGM, """
SELECT sum((qc_status='include')::INT)::BIGINT AS n_evaluated, sum((qc_status<>'include')::INT)::BIGINT AS n_failed,
 round(avg(primary_adv) FILTER (qc_status='include'), 6) AS mean_primary_adv,
 round(avg(spatial_adv) FILTER (qc_status='include'), 6) AS mean_spatial_adv FROM rm"""))
def e02(spark, sf):
    s = S.registry_summary(registry_metrics(spark, sf), ["primary_adv", "spatial_adv"])
    return r6(s, "mean_primary_adv", "mean_spatial_adv")


@query("e02_failure_list", sql("adv", _REGM, "SELECT area, excluded_reason FROM rm WHERE qc_status<>'include'"))
def e02b(spark, sf):
    return S.failure_list(registry_metrics(spark, sf))


@query("e04_method_means", sql("seeded", """
SELECT method, count(*) AS n, round(avg(change_f1), 6) AS mean_change_f1, round(avg(fom), 6) AS mean_fom,
 round(avg(transition_accuracy), 6) AS mean_transition_accuracy, round(avg(allocation_disagreement), 6) AS mean_allocation_disagreement
FROM seeded GROUP BY method"""))
def e04(spark, sf):
    m = S.method_means(B.seeded(spark, sf), B.METRICS)
    return r6(m, *[f"mean_{x}" for x in B.METRICS])


_SPREAD = ", ".join(
    f"round(avg({m}), 10) AS mean_{m}, round(coalesce(stddev_samp({m}), 0.0), 10) AS std_{m},"
    f" round(min({m}), 10) AS min_{m}, round(max({m}), 10) AS max_{m}" for m in B.METRICS)


@query("e05_seeded_method_summary", sql("seeded", f"SELECT method, area, count(*) AS n, {_SPREAD} FROM seeded GROUP BY ALL"))
def e05(spark, sf):
    s = S.seeded_method_summary(B.seeded(spark, sf), B.METRICS)
    names = [f"{p}_{m}" for p in ("mean", "std", "min", "max") for m in B.METRICS]
    return s.withColumns({c: F.round(c, 10) for c in names})


_DSUM = """count(*) AS n, round(avg(delta), 6) AS mean_delta, round(coalesce(stddev_samp(delta), 0.0), 6) AS std_delta,
 round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta, sum((delta*dir > 0)::INT)::BIGINT AS n_better,
 round(avg((delta*dir > 0)::INT), 6) AS better_rate"""
_DCOLS = ("mean_delta", "std_delta", "min_delta", "max_delta", "better_rate")


@query("e06_seeded_delta_summary", sql("deltas", f"SELECT metric, {_DSUM} FROM deltas GROUP BY metric"))
def e06(spark, sf):
    return r6(S.delta_summary(deltas(spark, sf)), *_DCOLS)


_OVER = """
sm AS (SELECT seed, method, metric, dir, avg(value) AS v FROM seeded_long GROUP BY ALL),
od AS (SELECT a.seed, a.metric, a.dir, a.v AS cv, b.v AS bv, a.v - b.v AS delta FROM sm a JOIN sm b USING (seed, metric)
 WHERE a.method='click' AND b.method='error')"""


def overall(spark, sf):
    return S.overall_deltas(B.seeded(spark, sf), A, C, B.METRICS, B.LOWER)


@query("e07_overall_deltas", sql("seeded_long", _OVER, """
SELECT seed, metric, dir > 0 AS higher, round(cv, 6) AS challenger_value, round(bv, 6) AS baseline_value, round(delta, 6) AS delta,
 delta*dir > 0 AS better FROM od"""))
def e07(spark, sf):
    return r6(overall(spark, sf), "challenger_value", "baseline_value", "delta")


@query("e07_overall_delta_summary", sql("seeded_long", _OVER, f"SELECT metric, {_DSUM} FROM od GROUP BY metric"))
def e07b(spark, sf):
    return r6(S.delta_summary(overall(spark, sf)), *_DCOLS)


@query("e08_cross_area_summary", sql("deltas", """
p AS (SELECT metric, dir, area, count(*) AS n, avg(delta) AS md, sum((delta*dir>0)::INT) AS nb FROM deltas GROUP BY ALL)""", """
SELECT metric, dir > 0 AS higher, count(*) AS n_areas, sum(n)::BIGINT AS n_seed_pairs, round(avg(md), 6) AS mean_area_delta,
 round(avg(md*dir), 6) AS mean_area_benefit, sum((md*dir>0)::INT)::BIGINT AS area_better_count,
 sum((nb=n)::INT)::BIGINT AS area_all_seed_better_count, sum((nb=0)::INT)::BIGINT AS area_all_seed_worse_count,
 round((sum(nb)/sum(n))::DOUBLE, 6) AS weighted_better_rate, round(quantile_cont(md, 0.5), 6) AS median_area_delta,
 round(quantile_cont(md*dir, 0.5), 6) AS median_area_benefit FROM p GROUP BY metric, dir"""))
def e08(spark, sf):
    return r6(S.cross_area_summary(deltas(spark, sf)), "mean_area_delta", "mean_area_benefit",
              "weighted_better_rate", "median_area_delta", "median_area_benefit")


_MEANS = """
mm AS (SELECT method, metric, dir, avg(value) AS v FROM seeded_long GROUP BY ALL),
ma AS (SELECT a.metric, a.dir, a.v AS cv, b.v AS bv, a.v - b.v AS delta FROM mm a JOIN mm b USING (metric) WHERE a.method='click' AND b.method='error')"""


def means(spark, sf):
    return S.mean_advantages(B.seeded(spark, sf), A, C, B.METRICS, B.LOWER)


@query("e09_mean_advantages", sql("seeded_long", _MEANS, """
SELECT metric, dir>0 AS higher, round(cv, 6) AS challenger_value, round(bv, 6) AS baseline_value, round(delta, 6) AS delta,
 delta*dir>0 AS better FROM ma"""))
def e09(spark, sf):
    return r6(means(spark, sf), "challenger_value", "baseline_value", "delta")


_GATES = """
gs AS (SELECT metric, count(*) AS n, sum((delta*dir>0)::INT)::BIGINT AS nb FROM od GROUP BY metric),
gates AS (SELECT 'mean_wins' AS gate, 'all' AS metric, sum((delta*dir>0)::INT)::BIGINT AS observed, 4::BIGINT AS required, true AS ok FROM ma
 UNION ALL SELECT CASE WHEN metric='allocation_disagreement' THEN 'allocation_seed_wins' ELSE 'seed_wins' END, metric, nb,
  CASE WHEN metric='allocation_disagreement' THEN 3 ELSE 5 END, n=5 FROM gs
 UNION ALL SELECT 'paired_fom_wins', 'fom', sum((delta>0)::INT)::BIGINT, 66, true FROM deltas WHERE metric='fom')"""


def gates(spark, sf):
    return S.acceptance_gates(means(spark, sf), S.delta_summary(overall(spark, sf)),
                              S.delta_summary(deltas(spark, sf)), 4, 5, 5, 3, 66)


@query("e10_acceptance_gates", sql("deltas", _OVER, _MEANS, _GATES, """
SELECT gate, metric, observed, required, (ok AND observed >= required) AS passed FROM gates"""))
def e10(spark, sf):
    return gates(spark, sf)


@query("e10_all_passed", sql("deltas", _OVER, _MEANS, _GATES, """
SELECT bool_and(ok AND observed >= required) AS passed, count(*) AS n_gates FROM gates"""))
def e10b(spark, sf):
    return S.all_passed(gates(spark, sf))


@query("e11_failure_rows", sql("deltas", """
SELECT seed, area, metric, round(delta, 6) AS delta, CASE WHEN metric='fom' THEN 'fom_loss' ELSE 'allocation_degradation' END AS failure
FROM deltas WHERE (metric='fom' AND delta<0) OR (metric='allocation_disagreement' AND delta>0.02)"""))
def e11(spark, sf):
    return r6(S.failure_rows(deltas(spark, sf)), "delta").select("seed", "area", "metric", "delta", "failure")


@query("e12_comparison_mismatches", sql("seeded", """
SELECT area, count(*) AS n FROM seeded WHERE method <> 'click' OR (CASE WHEN area%4=0 THEN 'view' ELSE 'error' END) <> 'error' GROUP BY area"""))
def e12(spark, sf):
    rows = B.seeded(spark, sf).selectExpr("area", "method as challenger", "if(area % 4 = 0, 'view', 'error') as baseline")
    return S.comparison_mismatches(rows, A, C).groupBy("area").agg(F.count("*").alias("n"))


CATEGORIES = {str(i): ("lowland", "upland", "coast")[i % 3] for i in range(30)}


@query("e13_category_summary", sql("adv", """
k AS (SELECT CASE area%3 WHEN 0 THEN 'lowland' WHEN 1 THEN 'upland' ELSE 'coast' END AS category, primary_adv AS v FROM adv WHERE area < 30 AND primary_adv IS NOT NULL)""", """
SELECT category, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, sum((v>0)::INT)::BIGINT AS n_positive,
 sum((v<0)::INT)::BIGINT AS n_negative FROM k GROUP BY category"""))
def e13(spark, sf):
    return r6(S.category_summary(B.advantages(spark, sf), CATEGORIES, "area", "primary_adv"), "mean", "median")


@query("e13_category_members", sql("adv", """
SELECT CASE area%3 WHEN 0 THEN 'lowland' WHEN 1 THEN 'upland' ELSE 'coast' END AS category, area FROM adv WHERE area < 30 AND primary_adv IS NOT NULL"""))
def e13b(spark, sf):
    return S.category_members(B.advantages(spark, sf), CATEGORIES, "area", "primary_adv")


@query("e14_planning_summary", sql("seeded", """
s AS (SELECT method, count(change_f1) AS n, avg(change_f1) AS m, coalesce(stddev_samp(change_f1),0.0) AS sd FROM seeded GROUP BY method)""", """
SELECT method, n, round(m, 6) AS mean_value, round(sd, 6) AS std_value, round(m/(SELECT m FROM s WHERE method='click'), 6) AS retention FROM s"""))
def e14(spark, sf):
    return r6(S.planning_summary(B.seeded(spark, sf), "method", "change_f1", A), "mean_value", "std_value", "retention")


@query("e15_transfer_summary", sql("seeded", """
s AS (SELECT method, count(fom) AS n, avg(fom) AS m, coalesce(stddev_samp(fom),0.0) AS sd FROM seeded GROUP BY method)""", """
SELECT method, n, round(m, 6) AS mean_value, round(sd, 6) AS std_value, round(m-(SELECT m FROM s WHERE method='click'), 6) AS delta_vs_click,
 round(m-(SELECT m FROM s WHERE method='error'), 6) AS delta_vs_error FROM s"""))
def e15(spark, sf):
    t = S.transfer_summary(B.seeded(spark, sf), "method", "fom", [A, C])
    return r6(t, "mean_value", "std_value", "delta_vs_click", "delta_vs_error")


_STEP = """
st AS (SELECT area, seed + 1 AS step, avg(change_f1) FILTER (method='error') AS persistence, avg(change_f1) FILTER (method='click') AS model
 FROM seeded GROUP BY ALL),
sa AS (SELECT *, model - persistence AS advantage FROM st WHERE model IS NOT NULL AND persistence IS NOT NULL)"""


def step_rows(spark, sf):
    side = lambda m: F.avg(F.when(F.col("method") == m, F.col("change_f1")))
    st = B.seeded(spark, sf).groupBy("area", (F.col("seed") + 1).alias("step")).agg(
        side(C).alias("persistence"), side(A).alias("model"))
    return st.withColumn("advantage", F.col("model") - F.col("persistence")).filter("advantage is not null")


@query("e16_multistep_summary", sql("seeded", _STEP, """
SELECT step, count(*) AS n, round(avg(persistence), 10) AS mean_persistence, round(avg(model), 10) AS mean_model, round(avg(advantage), 10) AS mean_advantage,
 round(stddev_samp(advantage), 10) AS sd_advantage, sum((advantage>0)::INT)::BIGINT AS n_pos, sum((advantage<0)::INT)::BIGINT AS n_neg,
 round(min(advantage), 10) AS min_advantage, round(max(advantage), 10) AS max_advantage FROM sa GROUP BY step"""))
def e16(spark, sf):
    out = S.multistep_summary(step_rows(spark, sf))
    return out.withColumns({c: F.round(c, 10) for c in (
        "mean_persistence", "mean_model", "mean_advantage", "sd_advantage", "min_advantage", "max_advantage")})


@query("e17_area_counts", sql("adv", """
SELECT count(*) AS n_total, sum((primary_adv>0)::INT)::BIGINT AS n_pos, sum((primary_adv<0)::INT)::BIGINT AS n_neg,
 round(min(primary_adv), 6) AS min_value, round(max(primary_adv), 6) AS max_value FROM adv"""))
def e17(spark, sf):
    return r6(S.area_ranking(B.advantages(spark, sf), "primary_adv")[0], "min_value", "max_value")


@query("e17_area_ranking", sql("adv", """
SELECT * FROM (SELECT 'best' AS list, area, round(primary_adv, 6) AS primary_adv FROM adv WHERE primary_adv>0 ORDER BY adv.primary_adv DESC, area LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'worst', area, round(primary_adv, 6) FROM adv WHERE primary_adv<0 ORDER BY adv.primary_adv, area LIMIT 10)"""))
def e17b(spark, sf):
    return r6(S.area_ranking(B.advantages(spark, sf), "primary_adv")[1], "primary_adv")


@query("e18_valid_delta_summary", sql("deltas", """
SELECT count(*) AS n_total, sum((delta>0)::INT)::BIGINT AS n_improved, sum((delta<0)::INT)::BIGINT AS n_degraded, round(avg(delta), 6) AS mean_delta,
 round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta, round(stddev_samp(delta), 6) AS std_delta,
 round(quantile_cont(delta, 0.5), 6) AS median_delta FROM deltas WHERE metric='fom' AND area % 7 <> 3"""))
def e18(spark, sf):
    d = deltas(spark, sf).filter("metric = 'fom'").withColumn("status", F.expr("if(area % 7 = 3, 'missing', 'ok')"))
    return r6(S.valid_delta_summary(d), "mean_delta", "min_delta", "max_delta", "std_delta", "median_delta")


@query("e19_stratum_focus", sql("adv", """
b AS (SELECT *, CASE WHEN area < 50 THEN 'first' ELSE 'second' END AS batch FROM adv WHERE stratum='stratum_2' AND tier='tier1')""", """
SELECT batch, count(*) AS n, round(avg(primary_adv), 9) AS mean_primary, round(avg(spatial_adv), 9) AS mean_spatial,
 sum((spatial_adv<0)::INT)::BIGINT AS n_negative, sum((spatial_adv>0)::INT)::BIGINT AS n_positive,
 first(area ORDER BY spatial_adv, primary_adv, area) AS lowest_area, last(area ORDER BY spatial_adv, primary_adv, area) AS best_area FROM b GROUP BY batch"""))
def e19(spark, sf):
    rows = B.advantages(spark, sf).withColumn("batch", F.expr("if(area < 50, 'first', 'second')"))
    f = S.stratum_focus(rows, "stratum_2", "tier1")
    return f.withColumns({c: F.round(c, 9) for c in ("mean_primary", "mean_spatial")})


_E19 = "b AS (SELECT *, CASE WHEN area < 50 THEN 'first' ELSE 'second' END AS batch FROM adv WHERE stratum='stratum_2' AND tier='tier1')"


@query("e19_ranked_rows", sql("adv", _E19, """
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY spatial_adv NULLS FIRST, primary_adv NULLS FIRST, area) AS rank, area,
 round(spatial_adv, 6) AS spatial_adv, round(primary_adv, 6) AS primary_adv FROM b"""))
def e19b(spark, sf):
    rows = B.advantages(spark, sf).withColumn("batch", F.expr("if(area < 50, 'first', 'second')"))
    return r6(S.stratum_ranking(rows, "stratum_2", "tier1"), "spatial_adv", "primary_adv")


@query("e20_win_loss", sql("seeded_long", """
v AS (SELECT area, method, metric, dir, avg(value) AS value FROM seeded_long WHERE metric IN ('fom','allocation_disagreement') AND area % 6 <> 0 GROUP BY ALL)""", """
SELECT c.area, c.metric, c.method AS control, round(m.value, 6) AS model_value, round(c.value, 6) AS control_value, round(m.value-c.value, 6) AS delta,
 (c.value-m.value)*m.dir < 0 AS model_won FROM v c JOIN v m USING (area, metric) WHERE m.method='click' AND c.method<>'click'"""))
def e20(spark, sf):
    w = B.seeded(spark, sf).groupBy("area", "method").agg(
        *[steady_mean(F.col(m)).alias(m) for m in ("fom", "allocation_disagreement")]
    ).withColumn("changed", F.col("area") % 6)
    return r6(S.win_loss(w, ["area"], ["fom", "allocation_disagreement"], A, B.LOWER, "changed"),
              "model_value", "control_value", "delta")


@query("e21_finite_means", sql("metric_rows", """
SELECT method, round(avg(CASE WHEN row_id % 13 = 0 THEN NULL ELSE value END), 6) AS mean_v FROM metric_rows GROUP BY method"""))
def e21(spark, sf):
    m = B.metric_rows(spark, sf).withColumn("v", F.expr("if(row_id % 13 = 0, double('NaN'), value)"))
    return r6(S.finite_means(m, ["method"], ["v"]), "mean_v")


@query("e23_sensitivity_ranges", sql("grid", _METHODS, """
SELECT method, count(*) AS n, round(avg(change_f1), 6) AS mean_change_f1, round(stddev_samp(change_f1), 6) AS std_change_f1,
 round(avg(fom), 6) AS mean_fom, round(stddev_samp(fom), 6) AS std_fom FROM metrics GROUP BY method"""))
def e23(spark, sf):
    g = S.grid_summary(method_metrics(spark, sf), ["method"], ["change_f1", "fom"])
    return r6(g, "mean_change_f1", "std_change_f1", "mean_fom", "std_fom")


@query("e24_multistep_disclosure", sql("adv", "seeded", _STEP, """
SELECT a.area, coalesce(step, 1) AS step, round(coalesce(sa.advantage, primary_adv), 6) AS advantage,
 CASE WHEN step IS NULL THEN 'one_step_only' ELSE 'recorded' END AS status FROM adv a LEFT JOIN sa USING (area)"""))
def e24(spark, sf):
    """The recorded steps of all areas; an area has none if one of the two methods is missing in the data."""
    areas = B.advantages(spark, sf).select("area", F.col("primary_adv").alias("advantage"))
    return r6(S.multistep_disclosure(areas, step_rows(spark, sf)), "advantage")


@query("e26_redecode_delta", sql("grid", """
p AS (SELECT area, sum((start_cls<>end_cls)::INT) AS ch, avg((pred_cls=end_cls)::INT) AS pub FROM grid GROUP BY area),
mg AS (SELECT area, (CASE end_cls WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END) AS t,
 (CASE pred_cls WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END) AS d FROM grid WHERE area <> 2),
r AS (SELECT area, avg((t=d)::INT) AS acc FROM mg WHERE t<>0 GROUP BY area)""", """
SELECT area, CASE WHEN acc IS NULL THEN 'missing_input' ELSE 'ok' END AS status, round(acc-pub, 6) AS delta FROM p LEFT JOIN r USING (area) WHERE ch>0"""))
def e26(spark, sf):
    from ..operators.cells import merge_classes

    g = B.grid(spark, sf)
    pub = g.groupBy("area").agg(
        F.sum((F.col("start_cls") != F.col("end_cls")).cast("int")).alias("true_change_pixels"),
        F.avg((F.col("pred_cls") == F.col("end_cls")).cast("int")).alias("published_accuracy"))
    m = {1: 1, 2: 2, 3: 2, 4: 3}
    t, d = merge_classes(F.col("end_cls"), m), merge_classes(F.col("pred_cls"), m)
    re = g.filter("area <> 2").filter(t != 0).groupBy("area").agg(F.avg((t == d).cast("int")).alias("end_accuracy"))
    return r6(S.redecode_delta(pub, re, ["area"]), "delta")


@query("e27_focus_bundle", sql("grid", _METHODS, """
SELECT area, method, CASE WHEN area=3 THEN 'focus' ELSE 'comparison' END AS role, round(fom, 6) AS fom, round(change_f1, 6) AS change_f1
FROM metrics WHERE area IN (3,1,5)"""))
def e27(spark, sf):
    m = method_metrics(spark, sf)
    b = S.focus_bundle(m.withColumn("area", F.col("area").cast("int")), 3, [1, 5])
    return r6(b, "fom", "change_f1").select("area", "method", "role", "fom", "change_f1")


# ---- sorts and set operations ------------------------------------------------

@query("k01_ranked_report", sql("adv", """
SELECT area, row_number() OVER (PARTITION BY tier ORDER BY spatial_adv NULLS FIRST, primary_adv NULLS FIRST, area) AS rank, tier FROM adv"""))
def k01(spark, sf):
    r = S.ranked_report(B.advantages(spark, sf), ["tier"], ["spatial_adv", "primary_adv", "area"])
    return r.select("area", "rank", "tier")


@query("k02_top_transitions", sql("grid", """
t AS (SELECT area, 'end_cls' AS source, start_cls AS f, end_cls AS t, count(*) AS n FROM grid WHERE start_cls<>end_cls GROUP BY ALL
 UNION ALL SELECT area, 'pred_cls', start_cls, pred_cls, count(*) FROM grid WHERE start_cls<>pred_cls GROUP BY ALL)""", """
SELECT area, source, f AS from_cls, t AS to_cls, n, rank::INT AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY area, source ORDER BY n DESC, f, t) AS rank FROM t) WHERE rank <= 12"""))
def k02(spark, sf):
    c = M.contingency(B.grid(spark, sf), ["area"])
    parts = [M.top_transitions(c, ["area"], to, 12).withColumn("source", F.lit(to)) for to in ("end_cls", "pred_cls")]
    return parts[0].unionByName(parts[1])


@query("k03_first_per_area", sql("grid", """
t AS (SELECT area, start_cls AS f, end_cls AS t, count(*) AS n FROM grid WHERE start_cls<>end_cls GROUP BY ALL)""", """
SELECT area, f AS from_cls, t AS to_cls, n FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, f, t) AS r FROM t) WHERE r=1"""))
def k03(spark, sf):
    c = M.contingency(B.grid(spark, sf), ["area"])
    return M.top_transitions(c, ["area"], "end_cls", 1).drop("rank")


@query("k04_method_union", sql("grid", """
SELECT 'model' AS method, area, pred_cls, count(*) AS n FROM grid GROUP BY ALL UNION ALL
SELECT 'persistence', area, start_cls, count(*) FROM grid GROUP BY ALL"""))
def k04(spark, sf):
    s = M.stack_methods(B.grid(spark, sf), {"model": "pred_cls", "persistence": "start_cls"})
    return s.groupBy("method", "area", "pred_cls").agg(F.count("*").alias("n"))


@query("k05_area_set_difference", sql("metric_rows", """
a AS (SELECT DISTINCT area FROM metric_rows WHERE method='click' AND seed=0),
b AS (SELECT DISTINCT area FROM metric_rows WHERE method='error' AND seed=1)""", """
SELECT area, 'left' AS side FROM (SELECT area FROM a EXCEPT SELECT area FROM b)
UNION ALL SELECT area, 'right' FROM (SELECT area FROM b EXCEPT SELECT area FROM a)"""))
def k05(spark, sf):
    m = B.metric_rows(spark, sf)
    return S.set_difference(m.filter("method = 'click' and seed = 0"), m.filter("method = 'error' and seed = 1"), "area")


@query("k05_area_intersection", sql("metric_rows", """
SELECT area FROM metric_rows WHERE method='click' AND seed=0 INTERSECT SELECT area FROM metric_rows WHERE method='error' AND seed=1"""))
def k05b(spark, sf):
    m = B.metric_rows(spark, sf)
    return m.filter("method = 'click' and seed = 0").select("area").intersect(m.filter("method = 'error' and seed = 1").select("area"))


@query("k06_class_union", sql("grid", "SELECT start_cls AS cls FROM grid UNION SELECT end_cls FROM grid UNION SELECT pred_cls FROM grid"))
def k06(spark, sf):
    g = B.grid(spark, sf)
    return g.select(F.explode(F.array("start_cls", "end_cls", "pred_cls")).alias("cls")).distinct()


@query("k07_distinct_thresholds", sql("seeded", "SELECT DISTINCT area, round(fom, 10) AS threshold FROM seeded WHERE method='click'"))
def k07(spark, sf):
    return B.seeded(spark, sf).filter("method = 'click'").select("area", F.round("fom", 10).alias("threshold")).distinct()


