"""Tuning, selection and rule-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import half_even
from ..operators import gates as G
from ..operators import mapmetrics as M
from ..operators import selection as J
from ..operators import summaries as S
from ..operators.cells import bbox_grid_size, size_class
from ..operators.ranking import attach_row
from . import bindings as B
from .q_catalog import _BOXD, _SIZE, attributes, boxes
from .q_evaluate import METRIC_ROWS as _METRIC_ROWS
from .q_gates import _SC, scored
from .q_mapmetrics import METRIC_COLS
from .registry import query, sql

AREA = ["area"]


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def cases(spark, sf):
    """One calibration case per customer group: predicted and true change fractions."""
    return B.table(spark, sf, "orders").selectExpr(
        "cast(o_custkey % 83 as int) as area",
        "if(o_orderpriority < '3', 0, 1) as p", "if(o_orderstatus = 'F', 0, 1) as t", "o_totalprice / 600000.0 as x",
    ).groupBy("area").agg(
        F.avg("p").alias("predicted"), F.avg("t").alias("target"), F.avg("x").alias("feature"), F.count("*").alias("n_valid"))


_CASES = """
cs AS (SELECT (o_custkey % 83)::INT AS area, avg((o_orderpriority >= '3')::INT) AS predicted, avg((o_orderstatus <> 'F')::INT) AS target,
 avg(o_totalprice/600000.0) AS feature, count(*) AS n_valid FROM orders GROUP BY 1),
rt AS (SELECT *, greatest(target, 0.0)/greatest(predicted, 1e-6) AS ratio FROM cs WHERE predicted > 1e-6)"""


@query("j01_change_fraction_ridge", sql(_CASES, """
mo AS (SELECT avg(predicted) AS m1, avg(feature) AS m2, avg(target) AS my, count(*) AS n FROM cs),
ce AS (SELECT predicted-m1 AS a, feature-m2 AS b, target-my AS y FROM cs, mo),
sm AS (SELECT sum(a*a)+1e-3 AS aa, sum(b*b)+1e-3 AS bb, sum(a*b) AS ab, sum(a*y) AS ay, sum(b*y) AS yb FROM ce),
w AS (SELECT (ay*bb-yb*ab)/(aa*bb-ab*ab) AS w1, (yb*aa-ay*ab)/(aa*bb-ab*ab) AS w2 FROM sm)""", """
SELECT area, round(least(0.9, greatest(0.05, (my - w1*m1 - w2*m2) + predicted*w1 + feature*w2)), 6) AS fraction FROM cs, mo, w"""))
def j01(spark, sf):
    c = cases(spark, sf)
    w = J.fit_ridge(c, ["predicted", "feature"], "target", 1e-3)
    p = J.predict_fraction(["predicted", "feature"], w, 0.05, 0.9)
    return c.select("area", F.round(p, 6).alias("fraction"))


@query("j01_single_feature", sql(_CASES, """
m AS (SELECT regr_slope(target, feature) AS b, regr_intercept(target, feature) AS a FROM cs)""", """
SELECT area, round(least(0.9, greatest(0.05, a + b*feature)), 5) AS fraction FROM cs, m"""))
def j01b(spark, sf):
    c = cases(spark, sf)
    w = J.fit_ridge(c, ["feature"], "target", 0.0)
    return c.select("area", F.round(J.predict_fraction(["feature"], w, 0.05, 0.9), 5).alias("fraction"))


@query("j02_ratio_model", sql(_CASES, "SELECT round(quantile_cont(ratio, 0.25), 6) AS base_ratio, count(*) AS n_usable FROM rt"))
def j02(spark, sf):
    return r6(J.ratio_quantile(J.change_ratios(cases(spark, sf)), 0.25), "base_ratio")


@query("j02_region_scale", sql(_CASES, """
q AS (SELECT quantile_cont(ratio, 0.25) AS b FROM rt)""", """
SELECT area, round(least(0.6, greatest(0.02, predicted*(b*CASE WHEN n_valid < 180 THEN 1.0 ELSE 0.7 END::DOUBLE))), 6) AS fraction FROM cs, q"""))
def j02b(spark, sf):
    c = cases(spark, sf)
    c = attach_row(c, J.ratio_quantile(J.change_ratios(c), 0.25))
    mul = J.scale_multiplier(F.col("n_valid"), 1.0, 180, 0.7)
    f = J.target_fraction(F.col("predicted"), F.col("base_ratio"), mul, F.lit(0.02), F.lit(0.6))
    return c.select("area", F.round(f, 6).alias("fraction"))


@query("j03_cap_ratio", sql(_CASES, """
SELECT round(coalesce(quantile_cont(ratio, 0.5) FILTER (predicted >= 0.6), quantile_cont(ratio, 0.5)), 6) AS cap_ratio, count(*) FILTER (predicted >= 0.6) AS n_high FROM rt"""))
def j03(spark, sf):
    return r6(J.cap_ratio(cases(spark, sf), 0.6, 0.5), "cap_ratio")


OPTIONS = {"quantile": [0.25, 0.5], "multiplier": [1.0, 0.7], "use_cap": [True, False], "cap_threshold": [0.55, 0.65]}


@query("j04_parameter_grid", sql(_CASES, """
g AS (SELECT DISTINCT area, q AS quantile, m AS multiplier, u AS use_cap, CASE WHEN u THEN t ELSE 0.55 END AS cap_threshold
 FROM cs, (SELECT unnest([0.25,0.5]) AS q), (SELECT unnest([1.0,0.7]) AS m), (SELECT unnest([true,false]) AS u), (SELECT unnest([0.55,0.65]) AS t))""", """
SELECT area, quantile::DOUBLE AS quantile, multiplier::DOUBLE AS multiplier, use_cap, cap_threshold::DOUBLE AS cap_threshold FROM g"""))
def j04(spark, sf):
    return J.parameter_grid(cases(spark, sf).select("area"), OPTIONS, "use_cap", ["cap_threshold"])


@query("j05_leave_one_out_ratio", sql(_CASES, """
SELECT c.area, round((SELECT quantile_cont(r.ratio, 0.25) FROM rt r WHERE r.area <> c.area), 6) AS q25,
 round((SELECT quantile_cont(r.ratio, 0.6) FROM rt r WHERE r.area <> c.area), 6) AS q60 FROM cs c"""))
def j05a(spark, sf):
    c = cases(spark, sf).withColumn("ratio", F.greatest("target", F.lit(0.0)) / F.greatest("predicted", F.lit(1e-6)))
    ok = F.col("predicted") > 1e-6
    c = J.leave_one_out_quantile(c, ok, "ratio", {"q25": 0.25, "q60": 0.6})
    return r6(c.select("area", "q25", "q60"), "q25", "q60")


_LOOEVAL = """
ca AS (SELECT area, avg((pred_cls<>start_cls)::INT) AS p, avg((end_cls<>start_cls)::INT) AS t, count(*) AS nv FROM grid WHERE start_cls<>0 AND end_cls<>0 AND pred_cls<>0 GROUP BY area),
pm AS (SELECT q::DOUBLE AS q, m::DOUBLE AS m, q || '_' || m AS param FROM (VALUES (0.25),(0.75)) a(q), (VALUES (0.5),(0.8),(1.0)) b(m)),
lq AS (SELECT c.area, param, least(0.9, greatest(0.05, p * (m * CASE WHEN q=0.25 THEN (SELECT quantile_cont(o.t/o.p, 0.25) FROM ca o WHERE o.area<>c.area) ELSE (SELECT quantile_cont(o.t/o.p, 0.75) FROM ca o WHERE o.area<>c.area) END))) AS f, nv FROM ca c, pm),
kk AS (SELECT area, param, round_even(nv*f, 0) AS k FROM lq),
vs AS (SELECT * FROM sc WHERE start_cls<>0 AND end_cls<>0 AND pred_cls<>0),
rk AS (SELECT *, row_number() OVER (PARTITION BY area, c ORDER BY score DESC, row, col) AS rk FROM vs),
m AS (SELECT rk.area, param, start_cls, end_cls, CASE WHEN c AND rk<=k THEN pred_cls ELSE start_cls END AS pred_cls FROM rk JOIN kk ON rk.area=kk.area),
mb AS (SELECT area, param, count(*) AS n_cells, sum((end_cls<>start_cls AND pred_cls<>start_cls)::INT) AS tp, sum((end_cls=start_cls AND pred_cls<>start_cls)::INT) AS fp,
 sum((end_cls<>start_cls AND pred_cls=start_cls)::INT) AS fn, sum((end_cls<>start_cls AND pred_cls=end_cls)::INT) AS hit,
 sum((end_cls<>start_cls OR pred_cls<>start_cls)::INT) AS un, sum((end_cls<>start_cls)::INT) AS tr, sum((end_cls=pred_cls)::INT) AS ok FROM m GROUP BY ALL),
mq AS (SELECT area, param, sum(abs(t - p)) / (2.0 * sum(t))::DOUBLE AS q FROM (SELECT area, param, cls, sum(t) AS t, sum(p) AS p FROM (
  SELECT area, param, end_cls AS cls, 1 AS t, 0 AS p FROM m UNION ALL SELECT area, param, pred_cls, 0, 1 FROM m) GROUP BY ALL) GROUP BY ALL),
ev AS (SELECT area, param, CASE WHEN tp=0 THEN 0.0 ELSE 2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) END::DOUBLE AS change_f1,
 CASE WHEN un=0 THEN 1.0 ELSE hit/un END::DOUBLE AS fom, CASE WHEN tr=0 THEN 1.0 ELSE hit/tr END::DOUBLE AS transition_accuracy,
 greatest(0.0, (1.0 - ok/n_cells) - q)::DOUBLE AS allocation_disagreement FROM mb JOIN mq USING (area, param)),
ps AS (SELECT param, avg(change_f1) AS mean_change_f1, avg(fom) AS mean_fom, avg(transition_accuracy) AS mean_transition_accuracy,
 avg(allocation_disagreement) AS mean_allocation_disagreement FROM ev GROUP BY param)"""
TUNE = ("change_f1", "fom", "transition_accuracy", "allocation_disagreement")


def loo_evaluation(spark, sf):
    """Leave-one-area metrics of six ratio parameters, each on all valid cells."""
    c = scored(spark, sf).filter("start_cls <> 0 and end_cls <> 0 and pred_cls <> 0")
    cont = M.contingency(B.grid(spark, sf), AREA).filter("start_cls <> 0 and end_cls <> 0 and pred_cls <> 0")
    share = lambda x: F.sum(F.when(F.col(x) != F.col("start_cls"), F.col("n")).otherwise(0)) / F.sum("n")
    ca = cont.groupBy("area").agg(share("pred_cls").alias("p"), share("end_cls").alias("t"), F.sum("n").alias("nv"))
    ca = ca.withColumn("ratio", F.col("t") / F.col("p"))
    ca = J.leave_one_out_quantile(ca, F.col("p") > 1e-6, "ratio", {"q25": 0.25, "q75": 0.75})
    params = F.array(*[
        F.struct(F.lit(f"{q}_{m}").alias("param"), F.col(n).alias("_r"), F.lit(m).alias("_m"))
        for q, n in ((0.25, "q25"), (0.75, "q75")) for m in (0.5, 0.8, 1.0)])
    b = ca.select("area", "p", "nv", F.inline(params))
    f = J.target_fraction(F.col("p"), F.col("_m"), F.col("_r"), F.lit(0.05), F.lit(0.9))
    b = b.select("area", "param", half_even(F.col("nv") * f).alias("k"))
    return J.evaluate_budgets(c, AREA, b, F.col("score"), B.grid(spark, sf))


@query("j05_leave_one_out_evaluation", sql("support", _SC, _LOOEVAL, """
SELECT area, param, round(change_f1, 6) AS change_f1, round(fom, 6) AS fom, round(transition_accuracy, 6) AS transition_accuracy,
 round(allocation_disagreement, 6) AS allocation_disagreement FROM ev"""))
def j05(spark, sf):
    return r6(loo_evaluation(spark, sf), *METRIC_COLS).select("area", "param", *TUNE)


def tuned(spark, sf):
    return loo_evaluation(spark, sf).groupBy("param").agg(*[F.round(F.avg(m), 9).alias(f"mean_{m}") for m in TUNE])


_BEST = """SELECT param, round(mean_fom, 6) AS mean_fom FROM (SELECT param, round(mean_fom, 9) AS mean_fom, round(mean_allocation_disagreement, 9) AS a,
 round(mean_change_f1, 9) AS f, round(mean_transition_accuracy, 9) AS t FROM ps)"""


@query("j06_best_parameter", sql("support", _SC, _LOOEVAL, _BEST + " ORDER BY t >= 0.2 DESC, mean_fom DESC, a, f DESC, t DESC, param LIMIT 1"))
def j06(spark, sf):
    return r6(J.best_parameter(tuned(spark, sf), 0.2).select("param", "mean_fom"), "mean_fom")


@query("e23_parameter_summary", sql("support", _SC, _LOOEVAL, """
SELECT param, count(*) AS n, """ + ", ".join(f"round(avg({m}), 6) AS mean_{m}, round(stddev_samp({m}), 6) AS std_{m}" for m in TUNE) + """ FROM ev GROUP BY param"""))
def e23(spark, sf):
    g = S.grid_summary(loo_evaluation(spark, sf), ["param"], TUNE)
    return r6(g, *[f"{p}_{m}" for p in ("mean", "std") for m in TUNE])


@query("e23_metric_ranges", sql("support", _SC, _LOOEVAL, " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(min(mean_{m}), 6) AS low, round(max(mean_{m}), 6) AS high, round(max(mean_{m}) - min(mean_{m}), 6) AS spread FROM ps" for m in TUNE)))
def e23b(spark, sf):
    return r6(S.metric_ranges(S.grid_summary(loo_evaluation(spark, sf), ["param"], TUNE), TUNE), "low", "high", "spread")


def candidates(spark, sf):
    """Candidate x area metrics and one selection feature, for the areas that all candidates have whole rows of."""
    rows = B.metric_rows(spark, sf).groupBy(F.col("method").alias("candidate"), "area").agg(
        F.round(F.avg("value") / 500.0, 6).alias("fom"), F.round(F.stddev_samp("value") / 500.0, 6).alias("change_f1"),
        F.round(F.avg(F.col("value") % 1), 6).alias("allocation_disagreement"),
        F.round(F.avg("user_id") / 150.0, 6).alias("feature"))
    whole = rows.dropna().groupBy("area").agg(F.count("*").alias("n"))
    whole = attach_row(whole, rows.agg(F.count_distinct("candidate").alias("all"))).filter("n = all").select("area")
    return rows.join(whole, "area", "left_semi")


_CAND = """
c0 AS (SELECT method AS candidate, area, round(avg(value)/500.0, 6) AS fom, round(stddev_samp(value)/500.0, 6) AS change_f1,
 round(avg(value % 1), 6) AS allocation_disagreement, round(avg(user_id)/150.0, 6) AS feature FROM metric_rows GROUP BY 1, 2),
cd AS MATERIALIZED (SELECT * FROM c0 WHERE area IN (SELECT area FROM c0 WHERE change_f1 IS NOT NULL GROUP BY area HAVING count(*) = (SELECT count(DISTINCT candidate) FROM c0)))"""


@query("j07_leave_one_out_selection", sql("metric_rows", _CAND, """
t AS (SELECT a.area, b.candidate, round(avg(b.fom), 12) AS f, round(avg(b.change_f1), 12) AS g, count(*) AS n FROM (SELECT DISTINCT area FROM cd) a JOIN cd b ON b.area<>a.area GROUP BY ALL)""", """
SELECT area, candidate AS selected, n AS n_train, round(f, 6) AS train_fom, round(g, 6) AS train_change_f1 FROM (
 SELECT *, row_number() OVER (PARTITION BY area ORDER BY f DESC, g DESC, CASE candidate WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, candidate DESC) AS r FROM t) WHERE r=1"""))
def j07(spark, sf):
    s = J.select_leave_one_out(candidates(spark, sf), ["fom", "change_f1"], ["click", "error"])
    return r6(s, "train_fom", "train_change_f1")


_RULES = """
bs AS (SELECT area, fom, change_f1, allocation_disagreement FROM cd WHERE candidate='error'),
rl AS (SELECT DISTINCT candidate AS alternate, op, feature AS threshold FROM cd, (VALUES ('le'),('ge')) x(op) WHERE candidate<>'error'),
ap AS (SELECT rl.*, a.area, CASE WHEN op='le' THEN a.feature <= threshold ELSE a.feature >= threshold END AS u, a.fom AS af, a.change_f1 AS ac, a.allocation_disagreement AS aa, b.fom AS bf, b.change_f1 AS bc, b.allocation_disagreement AS ba
 FROM rl JOIN cd a ON a.candidate=rl.alternate JOIN bs b ON b.area=a.area),
rs AS (SELECT alternate, op AS operator, threshold, sum(u::INT)::BIGINT AS n_alternate, count(*) AS n_areas, avg(CASE WHEN u THEN af ELSE bf END) AS mean_fom,
 avg(CASE WHEN u THEN ac ELSE bc END) AS mean_change_f1, avg(CASE WHEN u THEN aa ELSE ba END) AS mean_allocation_disagreement,
 avg(bf) AS b1, avg(bc) AS b2, avg(ba) AS b3 FROM ap GROUP BY ALL
 UNION ALL SELECT NULL, 'always', NULL, 0, count(*), avg(fom), avg(change_f1), avg(allocation_disagreement), avg(fom), avg(change_f1), avg(allocation_disagreement) FROM bs),
rf AS (SELECT *, n_alternate/n_areas AS share, (mean_fom >= b1 - 1e-12 AND mean_change_f1 >= b2 - 1e-12 AND mean_allocation_disagreement <= b3 + 1e-12
 AND n_alternate/n_areas <= 0.75 AND (n_alternate >= 2 OR alternate IS NULL)) AS feasible FROM rs)"""
RULE_METRICS = ("fom", "change_f1", "allocation_disagreement")


def rules(spark, sf):
    return J.threshold_rules(candidates(spark, sf), "error", "feature", RULE_METRICS)


@query("j08_threshold_rules", sql("metric_rows", _CAND, _RULES, """
SELECT alternate, operator, threshold, n_alternate, n_areas, round(mean_fom, 9) AS mean_fom, round(mean_change_f1, 9) AS mean_change_f1,
 round(mean_allocation_disagreement, 9) AS mean_allocation_disagreement FROM rs"""))
def j08(spark, sf):
    r = rules(spark, sf).select("alternate", "operator", "threshold", "n_alternate", "n_areas", *[f"mean_{m}" for m in RULE_METRICS])
    return r.withColumns({f"mean_{m}": F.round(f"mean_{m}", 9) for m in RULE_METRICS})


@query("j09_feasible_rules", sql("metric_rows", _CAND, _RULES, "SELECT alternate, operator, threshold, round(share, 6) AS alternate_share, feasible FROM rf"))
def j09(spark, sf):
    f = J.feasible_rules(rules(spark, sf), ("fom", "change_f1"), ("allocation_disagreement",), 0.75, 2)
    return r6(f.select("alternate", "operator", "threshold", "alternate_share", "feasible"), "alternate_share")


@query("j09_best_rule", sql("metric_rows", _CAND, _RULES, """
SELECT alternate, operator, threshold, n_alternate FROM rf ORDER BY feasible DESC, round(mean_fom, 12) DESC, round(mean_change_f1, 12) DESC,
 round(mean_allocation_disagreement, 12), n_alternate DESC, alternate DESC NULLS LAST, operator DESC, threshold LIMIT 1"""))
def j09b(spark, sf):
    f = J.feasible_rules(rules(spark, sf), ("fom", "change_f1"), ("allocation_disagreement",), 0.75, 2)
    b = J.best_rule(f, [("fom", True), ("change_f1", True), ("allocation_disagreement", False)])
    return b.select("alternate", "operator", "threshold", "n_alternate")


@query("j10_conjunctive_rules", sql("metric_rows", _CAND, """
ax AS (SELECT candidate || '|feature|' || op AS axis, area, CASE WHEN op='le' THEN feature ELSE -feature END AS s FROM cd, (VALUES ('le'),('ge')) x(op)),
th AS (SELECT DISTINCT axis, s FROM ax),
cn AS (SELECT th.axis, th.s, ax.area FROM th JOIN ax ON ax.axis=th.axis AND ax.s<=th.s),
cp AS (SELECT a.axis AS axis1, a.s AS s1, b.axis AS axis2, b.s AS s2, a.area FROM cn a JOIN cn b ON a.area=b.area AND (a.axis<b.axis OR (a.axis=b.axis AND a.s<b.s))),
al AS (SELECT a.candidate AS alternate, a.area, a.fom - b.fom AS d FROM cd a JOIN cd b ON a.area=b.area AND b.candidate='error' AND a.candidate<>'error'),
gr AS (SELECT a.axis AS axis1, a.s AS s1, b.axis AS axis2, b.s AS s2 FROM th a JOIN th b ON (a.axis<b.axis OR (a.axis=b.axis AND a.s<b.s))),
sm AS (SELECT alternate, axis1, axis2, s1, s2, count(*) AS n, sum(d) AS d FROM cp JOIN al ON al.area=cp.area GROUP BY ALL)""", """
SELECT alternate, axis1, axis2, count(*) AS n_rules, sum(n_alternate)::BIGINT AS n_alternate, round(min(delta_fom), 9) AS least_delta_fom, round(max(delta_fom), 9) AS best_delta_fom FROM (
SELECT q.alternate, gr.axis1, gr.axis2, coalesce(n, 0) AS n_alternate, coalesce(d, 0.0)/(SELECT count(DISTINCT area) FROM cd WHERE candidate='error') AS delta_fom
FROM gr CROSS JOIN (SELECT DISTINCT alternate FROM al) q LEFT JOIN sm ON sm.alternate=q.alternate AND sm.axis1=gr.axis1 AND sm.axis2=gr.axis2 AND sm.s1=gr.s1 AND sm.s2=gr.s2) GROUP BY ALL"""))
def j10(spark, sf):
    """Every rule of two conditions, told by pair of axes: how many, how many areas they switch, and what they gain."""
    r = J.conjunctive_rules(candidates(spark, sf), "error", ["feature"], ("fom",))
    return r.groupBy("alternate", "axis1", "axis2").agg(
        F.count("*").alias("n_rules"), F.sum("n_alternate").alias("n_alternate"),
        F.round(F.min("delta_fom"), 9).alias("least_delta_fom"), F.round(F.max("delta_fom"), 9).alias("best_delta_fom"))


_BEST_RULE = """
ax AS MATERIALIZED (SELECT candidate || '|feature|' || op AS axis, area, CASE WHEN op='le' THEN feature ELSE -feature END AS s FROM cd, (VALUES ('le'),('ge')) x(op)),
th AS MATERIALIZED (SELECT axis, s, row_number() OVER (ORDER BY axis, s) AS i FROM (SELECT DISTINCT axis, s FROM ax)),
na AS (SELECT count(DISTINCT area) AS n FROM cd WHERE candidate='error'),
al AS (SELECT a.candidate AS alternate, a.area, a.fom - b.fom AS d, a.allocation_disagreement - b.allocation_disagreement AS e
 FROM cd a JOIN cd b ON a.area=b.area AND b.candidate='error' AND a.candidate<>'error'),
cn AS (SELECT i, area FROM th JOIN ax ON ax.axis=th.axis AND ax.s<=th.s),
r1 AS (SELECT alternate, i, NULL::BIGINT AS j, count(*) AS n, sum(d) AS d, sum(e) AS e FROM cn JOIN al USING (area) GROUP BY ALL),
r2 AS (SELECT alternate, a.i, b.i AS j, count(*) AS n, sum(d) AS d, sum(e) AS e FROM cn a JOIN cn b ON a.area=b.area AND a.i<b.i JOIN al ON al.area=a.area GROUP BY ALL),
rr AS (SELECT *, d/na.n AS df, e/na.n AS de, r.n/na.n AS share FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) r, na)"""


def best_rule_of(spark, sf, **bounds):
    best = J.best_conjunction(
        candidates(spark, sf), "error", ["feature"], 2, ["fom"], ["allocation_disagreement"], max_share=0.75, min_count=2, **bounds)
    cond = lambda i: F.get("conditions", F.lit(i))
    return r6(best, "delta_fom", "delta_allocation_disagreement").select(
        "alternate", "n_alternate", "delta_fom", "delta_allocation_disagreement", cond(0)["axis"].alias("axis1"), cond(0)["s"].alias("s1"),
        cond(1)["axis"].alias("axis2"), cond(1)["s"].alias("s2"), *(["target_count"] if bounds else []))


_BEST_OF = """FROM rr JOIN th a ON a.i=rr.i LEFT JOIN th b ON b.i=rr.j {join} WHERE df >= -1e-12 AND de <= 1e-12 AND share <= 0.75 + 1e-12 AND rr.n >= 2 {where}
ORDER BY round(df, 12) DESC, round(de, 12), rr.n DESC, alternate DESC, rr.j IS NOT NULL, rr.i, rr.j LIMIT 1"""
_BEST_COLS = """SELECT alternate, rr.n AS n_alternate, round(df, 6) AS delta_fom, round(de, 6) AS delta_allocation_disagreement,
 a.axis AS axis1, a.s AS s1, b.axis AS axis2, b.s AS s2"""


@query("j10_best_rule", sql("metric_rows", _CAND, _BEST_RULE, _BEST_COLS + " " + _BEST_OF.format(join="", where="")))
def j10b(spark, sf):
    return best_rule_of(spark, sf)


@query("j10_best_rule_with_targets", sql("metric_rows", _CAND, _BEST_RULE, """
tf AS (SELECT method AS candidate, user_id AS area, round(avg(user_id % 7)/7.0 + avg(seed)/50.0 + avg(area)/200.0, 6) AS feature FROM metric_rows GROUP BY 1, 2),
tx AS (SELECT candidate || '|feature|' || op AS axis, area, CASE WHEN op='le' THEN feature ELSE -feature END AS s FROM tf, (VALUES ('le'),('ge')) x(op)),
tn AS (SELECT i, area FROM th JOIN tx ON tx.axis=th.axis AND tx.s<=th.s),
t1 AS (SELECT i, NULL::BIGINT AS j, count(*) AS tc FROM tn GROUP BY i),
t2 AS (SELECT a.i, b.i AS j, count(*) AS tc FROM tn a JOIN tn b ON a.area=b.area AND a.i<b.i GROUP BY ALL),
tt AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)""",
_BEST_COLS + ", coalesce(tc, 0)::BIGINT AS target_count " + _BEST_OF.format(
    join="LEFT JOIN tt ON tt.i=rr.i AND tt.j IS NOT DISTINCT FROM rr.j", where="AND coalesce(tc, 0) BETWEEN 3 AND 6")))
def j10c(spark, sf):
    """Only rules that switch three to six of the unlabelled target areas."""
    target = B.metric_rows(spark, sf).groupBy(F.col("method").alias("candidate"), F.col("user_id").alias("area")).agg(
        F.round(F.avg(F.col("user_id") % 7) / 7.0 + F.avg("seed") / 50.0 + F.avg("area") / 200.0, 6).alias("feature"))
    return best_rule_of(spark, sf, target=target, target_min=3, target_max=6)


def target_features(spark, sf):
    return M.change_features(M.contingency(B.grid(spark, sf), AREA), AREA)


_FEAT = """
v AS (SELECT * FROM grid WHERE start_cls<>0 AND pred_cls<>0),
tf AS (SELECT area, avg((pred_cls<>start_cls)::INT) AS change_fraction, avg((start_cls=5)::INT) AS start_selector_fraction FROM v GROUP BY area),
rule AS (SELECT *, change_fraction >= 0.595 AND start_selector_fraction <= 0.21 AS use_alternate FROM tf)"""
RULE = (("change_fraction", "ge", 0.595), ("start_selector_fraction", "le", 0.21))


@query("j11_apply_rule", sql("grid", _FEAT, """
SELECT g.area, row, col, use_alternate, CASE WHEN use_alternate THEN start_cls ELSE pred_cls END AS gated_cls FROM grid g JOIN rule USING (area)"""))
def j11(spark, sf):
    f = J.apply_rule(target_features(spark, sf), RULE)
    b = f.select("area", "use_alternate", F.when(F.col("use_alternate"), "alternate").otherwise("baseline").alias("branch"))
    g = B.grid(spark, sf)
    out = G.choose_branch(g, AREA, b, {"alternate": "start_cls", "baseline": "pred_cls"})
    return out.select("area", "row", "col", (F.col("branch") == "alternate").alias("use_alternate"), "gated_cls")


@query("j11_unlabeled_counts", sql("grid", _FEAT, "SELECT sum(use_alternate::INT)::BIGINT AS n_alternate, count(*) AS n_areas FROM rule"))
def j11b(spark, sf):
    return J.unlabeled_counts(J.apply_rule(target_features(spark, sf), RULE))


@query("j12_oracle_best", sql("metric_rows", _CAND, """
SELECT area, first(candidate ORDER BY -fom, -change_f1, allocation_disagreement, candidate) AS best FROM cd GROUP BY area"""))
def j12(spark, sf):
    return J.oracle_best(candidates(spark, sf), [("fom", True), ("change_f1", True), ("allocation_disagreement", False)])


BANK = {"direct": "pred_cls", "halfway": "half_cls", "persistence": "start_cls"}
_BANK = """
gh AS (SELECT *, CASE WHEN row % 2 = 0 THEN pred_cls ELSE start_cls END AS half_cls FROM grid),
am AS (SELECT * FROM gh),
m AS (SELECT * FROM (SELECT 'direct' AS method, area, start_cls, end_cls, pred_cls AS p FROM am UNION ALL SELECT 'halfway', area, start_cls, end_cls, half_cls FROM am
 UNION ALL SELECT 'persistence', area, start_cls, end_cls, start_cls FROM am) WHERE start_cls<>0 AND end_cls<>0 AND p<>0),""" + _METRIC_ROWS + """,
bk AS (SELECT method AS candidate, area, n_cells, CASE WHEN pr+rc=0 THEN 0.0 ELSE 2*pr*rc/(pr+rc) END AS change_f1, CASE WHEN un=0 THEN 1.0 ELSE hit/un END::DOUBLE AS fom,
 CASE WHEN tr=0 THEN 1.0 ELSE hit/tr END::DOUBLE AS transition_accuracy, greatest(0.0, (1.0 - ok/n_cells) - q)::DOUBLE AS allocation_disagreement, (tp + fp)/n_cells AS change FROM mr),
au AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY round(fom, 12) DESC, round(change_f1, 12) DESC, round(transition_accuracy, 12) DESC,
 round(allocation_disagreement, 12), candidate) = 1 AS is_best FROM bk)"""
BANK_METRICS = ("fom", "change_f1", "transition_accuracy", "allocation_disagreement")


def bank(spark, sf):
    g = B.grid(spark, sf).withColumn("half_cls", F.when(F.col("row") % 2 == 0, F.col("pred_cls")).otherwise(F.col("start_cls")))
    return J.bank_contingency(g, "area", BANK)


@query("j11_applied_metrics", sql("grid", _BANK, _FEAT, """
SELECT rule.area, use_alternate, bk.candidate, round(bk.fom, 6) AS fom, round(bk.change_f1, 6) AS change_f1, round(bk.transition_accuracy, 6) AS transition_accuracy,
 round(bk.allocation_disagreement, 6) AS allocation_disagreement, round(bk.fom - d.fom, 6) AS gain_fom
FROM rule JOIN bk ON bk.area=rule.area AND bk.candidate=CASE WHEN use_alternate THEN 'persistence' ELSE 'direct' END JOIN bk d ON d.area=rule.area AND d.candidate='direct'"""))
def j11c(spark, sf):
    """The rule applied to the bank: metrics of the composite per area and what it gains over the baseline candidate."""
    decided = J.apply_rule(target_features(spark, sf), RULE).select(
        "area", "use_alternate", F.when(F.col("use_alternate"), "persistence").otherwise("direct").alias("candidate"))
    cont_ = bank(spark, sf)
    got = J.composite_metrics(cont_, decided).join(decided, ["area", "candidate"])
    base = J.composite_metrics(cont_, decided.select("area", F.lit("direct").alias("candidate"))).select("area", F.col("fom").alias("base"))
    out = got.join(base, "area").withColumn("gain_fom", F.col("fom") - F.col("base"))
    return r6(out, *BANK_METRICS, "gain_fom").select("area", "use_alternate", "candidate", *BANK_METRICS, "gain_fom")


@query("j12_bank_audit", sql("grid", _BANK, """
SELECT area, candidate, round(fom, 6) AS fom, round(change_f1, 6) AS change_f1, round(transition_accuracy, 6) AS transition_accuracy,
 round(allocation_disagreement, 6) AS allocation_disagreement, round(change, 6) AS predicted_change_fraction, is_best FROM au"""))
def j12b(spark, sf):
    a = J.bank_audit(bank(spark, sf))
    return r6(a, *BANK_METRICS, "predicted_change_fraction").select("area", "candidate", *BANK_METRICS, "predicted_change_fraction", "is_best")


@query("j12_bank_headroom", sql("grid", _BANK, """
o AS (SELECT avg(fom) AS f, avg(change_f1) AS c, avg(transition_accuracy) AS t, avg(allocation_disagreement) AS a FROM au WHERE is_best)""", """
SELECT candidate, count(*) AS n_areas, sum(is_best::INT)::BIGINT AS n_best, round(any_value(o.f) - avg(fom), 6) AS headroom_fom, round(any_value(o.c) - avg(change_f1), 6) AS headroom_change_f1,
 round(any_value(o.t) - avg(transition_accuracy), 6) AS headroom_transition_accuracy, round(avg(allocation_disagreement) - any_value(o.a), 6) AS headroom_allocation_disagreement FROM au, o GROUP BY candidate"""))
def j12c(spark, sf):
    h = [f"headroom_{m}" for m in BANK_METRICS]
    return r6(J.bank_headroom(J.bank_audit(bank(spark, sf))), *h).select("candidate", "n_areas", "n_best", *h)


@query("j13_split_areas", sql("areas", """
r AS (SELECT area, row_number() OVER (ORDER BY md5('4|' || area), area) AS rk, count(*) OVER () AS n FROM areas)""", """
SELECT area, rk <= least(greatest(0, greatest(1, round_even(n*0.3::DOUBLE, 0))), greatest(0, n-1)) AS calibration FROM r"""))
def j13(spark, sf):
    return J.split_areas(B.areas(spark, sf), 0.3, 4)


def sample_units(spark, sf):
    w, h = bbox_grid_size(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 100)
    u = attributes(spark, sf).join(boxes(spark, sf), "record_index").withColumns({"width_px": w, "height_px": h})
    px = F.col("width_px") * F.col("height_px")
    u = u.filter(px.between(2_500, 80_000) & (F.col("width_px") >= 32) & (F.col("height_px") >= 32))
    return u.withColumns({"size_class": size_class(px), "region": F.concat(F.lit("R"), (F.substring("province", 8, 2).cast("int") % 4).cast("string"))})


@query("j14_stratified_sample", sql(_BOXD, f"u AS (SELECT record_index, province, {_SIZE} FROM bx)", """
e AS (SELECT record_index, province, 'R' || (substr(province, 8, 2)::INT % 4) AS region,
  CASE WHEN width_px*height_px < 10000 THEN 'small' WHEN width_px*height_px < 40000 THEN 'medium' ELSE 'large' END AS size_class,
  sha256('seed-1|' || record_index || '|' || province || '|' || town) AS key
 FROM u JOIN bx USING (record_index, province) WHERE width_px*height_px BETWEEN 2500 AND 80000 AND width_px >= 32 AND height_px >= 32),
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY region, size_class) AS g, row_number() OVER (ORDER BY region, size_class, key, record_index) AS o FROM e),
st AS (SELECT 0 AS i, 0::BIGINT AS g, []::BIGINT[] AS os, []::VARCHAR[] AS provinces
 UNION ALL
 SELECT i + 1, arg_min(o.g, (CASE WHEN o.g <= st.g THEN 1000000000 ELSE 0 END) + o), list_append(os, arg_min(o, (CASE WHEN o.g <= st.g THEN 1000000000 ELSE 0 END) + o)),
  list_append(provinces, arg_min(province, (CASE WHEN o.g <= st.g THEN 1000000000 ELSE 0 END) + o))
 FROM st JOIN o ON NOT list_contains(os, o) AND len(list_filter(provinces, lambda x: x = province)) < 2 WHERE i < 40 GROUP BY i, st.g, os, provinces),
ch AS (SELECT unnest(os) AS o, unnest(range(1, i + 1)) AS selection_rank FROM (SELECT * FROM st ORDER BY i DESC LIMIT 1))""", """
SELECT record_index, region, size_class, province, selection_rank::INT AS selection_rank FROM ch JOIN o USING (o)"""))
def j14(spark, sf):
    s = J.stratified_sample(sample_units(spark, sf), 40, 2, "seed-1", ["record_index", "province", "town"])
    return s.select("record_index", "region", "size_class", "province", "selection_rank")


@query("j14_eligible_units", sql(_BOXD, f"u AS (SELECT record_index, province, {_SIZE} FROM bx)", """
SELECT 'R' || (substr(province, 8, 2)::INT % 4) AS region, CASE WHEN width_px*height_px < 10000 THEN 'small' WHEN width_px*height_px < 40000 THEN 'medium' ELSE 'large' END AS size_class,
 count(*) AS n, min(sha256('seed-1|' || record_index || '|' || province || '|' || town)) AS first_key
FROM u JOIN bx USING (record_index, province) WHERE width_px*height_px BETWEEN 2500 AND 80000 AND width_px >= 32 AND height_px >= 32 GROUP BY ALL"""))
def j14b(spark, sf):
    key = F.sha2(F.concat_ws("|", F.lit("seed-1"), F.col("record_index").cast("string"), "province", "town"), 256)
    return sample_units(spark, sf).groupBy("region", "size_class").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
