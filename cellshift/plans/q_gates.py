"""Change gates over the grid view, all areas and all cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import mapmetrics as M
from ..operators import neighbourhood as H
from . import bindings as B
from .q_mapmetrics import METRIC_COLS
from .q_neighbourhood import _REFLECT, CLASSES, r6
from .registry import query, sql

AREA = ["area"]
OUT = ("area", "row", "col", "gated_cls")
FRACTIONS = (0.2, 0.5, 0.8, 1.0)


def scored(spark, sf):
    """Grid with supports and a combined change score."""
    g = H.class_support(B.grid(spark, sf), AREA, CLASSES)
    g = g.withColumns({"p_pred": F.col("score") / 600000.0, "p_start": (F.col("row") % 10) / 20.0})
    return g.withColumn("score", G.change_score("p_pred", "p_start"))


_SC = """
sc AS (SELECT area, row, col, start_cls, end_cls, pred_cls, target_support, source_support,
 score/600000.0 - (row%10)/20.0 + 0.5*target_support - 0.25*source_support AS score,
 (start_cls<>0 AND pred_cls<>0 AND pred_cls<>start_cls) AS c FROM support)"""


def hits(spark, sf):
    return M.candidate_hits(M.contingency(B.grid(spark, sf), AREA), AREA)


def loo_reliability(spark, sf, alpha=0.5, smoothing=500.0):
    return M.transition_reliability(G.leave_one_out_hits(hits(spark, sf), AREA), AREA, alpha, smoothing)


def _loo(alpha, smoothing):
    return f"""
tot AS (SELECT from_cls, to_cls, sum(n) AS n, sum(exact) AS e, sum(binary_hits) AS b FROM trans GROUP BY ALL),
ar AS (SELECT DISTINCT area FROM trans),
loo AS (SELECT ar.area, tot.from_cls, tot.to_cls, tot.n - coalesce(t.n,0) AS n, tot.e - coalesce(t.exact,0) AS e,
 tot.b - coalesce(t.binary_hits,0) AS b FROM ar CROSS JOIN tot LEFT JOIN trans t
 ON t.area=ar.area AND t.from_cls=tot.from_cls AND t.to_cls=tot.to_cls),
lg AS (SELECT area, sum(n) AS gn, sum(e) AS ge, sum(b) AS gb FROM loo WHERE n>0 GROUP BY area),
rel AS (SELECT area, from_cls, to_cls, n,
 {alpha}*((e + {smoothing}*(ge/gn))/(n+{smoothing})) + (1-{alpha})*((b + {smoothing}*(gb/gn))/(n+{smoothing})) AS reliability,
 {alpha}*(ge/gn) + (1-{alpha})*(gb/gn) AS g FROM loo JOIN lg USING (area) WHERE n>0)"""


@query("b21_change_score", sql("support", _SC, "SELECT area, row, col, round(score, 9) AS score FROM sc"))
def b21(spark, sf):
    return scored(spark, sf).select("area", "row", "col", F.round("score", 9).alias("score"))


@query("g01_keep_fraction", sql("support", _SC, """
k AS (SELECT area, round_even(count(*)*0.6::DOUBLE, 0) AS k FROM sc WHERE c GROUP BY area),
r AS (SELECT area, row, col, row_number() OVER (PARTITION BY area ORDER BY score DESC, row, col) AS rk FROM sc WHERE c)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN pred_cls ELSE start_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) JOIN k ON k.area=sc.area"""))
def g01(spark, sf):
    return G.keep_fraction(scored(spark, sf), AREA, 0.6, sized_by=B.grid(spark, sf)).select(*OUT)


@query("g01_keep_fraction_masked", sql("support", _SC, """
mk AS (SELECT *, ((row + col) % 3 <> 0 AND pred_cls<>start_cls) AS mc FROM sc),
k AS (SELECT area, round_even(count(*)*0.6::DOUBLE, 0) AS k FROM mk WHERE mc GROUP BY area),
r AS (SELECT area, row, col, row_number() OVER (PARTITION BY area ORDER BY score DESC, row, col) AS rk FROM mk WHERE mc)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN pred_cls ELSE start_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) JOIN k ON k.area=sc.area"""))
def g01_masked(spark, sf):
    """The caller's mask decides which cells count, also those without a known class."""
    mask = (F.col("row") + F.col("col")) % 3 != 0
    return G.keep_fraction(scored(spark, sf), AREA, 0.6, sized_by=B.grid(spark, sf), valid=mask).select(*OUT)


@query("g01_keep_fraction_all_cells", sql("support", _SC, """
mk AS (SELECT *, pred_cls<>start_cls AS mc FROM sc),
k AS (SELECT area, round_even(count(*)*0.6::DOUBLE, 0) AS k FROM mk WHERE mc GROUP BY area),
r AS (SELECT area, row, col, row_number() OVER (PARTITION BY area ORDER BY score DESC, row, col) AS rk FROM mk WHERE mc)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN pred_cls ELSE start_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) JOIN k ON k.area=sc.area"""))
def g01_all(spark, sf):
    return G.keep_fraction(scored(spark, sf), AREA, 0.6, sized_by=B.grid(spark, sf), valid=F.lit(True)).select(*OUT)


_SWEEP = """
v AS (SELECT *, (pred_cls<>start_cls) AS c FROM grid WHERE start_cls<>0 AND end_cls<>0 AND pred_cls<>0),
fr AS (SELECT fraction::DOUBLE AS fraction FROM (VALUES (0.2),(0.5),(0.8),(1.0)) x(fraction)),
k AS (SELECT area, fraction, round_even(count(*)*fraction, 0) AS k FROM v, fr WHERE c GROUP BY area, fraction),
r AS (SELECT *, row_number() OVER (PARTITION BY area, c ORDER BY score DESC, row, col) AS rk FROM v),
m AS (SELECT r.area, fraction, start_cls, end_cls, CASE WHEN c AND rk<=k THEN pred_cls ELSE start_cls END AS pred_cls
 FROM r JOIN k ON r.area=k.area),
mb AS (SELECT area, fraction, count(*) AS n_cells,
 sum((end_cls<>start_cls AND pred_cls<>start_cls)::INT) AS tp,
 sum((end_cls=start_cls AND pred_cls<>start_cls)::INT) AS fp,
 sum((end_cls<>start_cls AND pred_cls=start_cls)::INT) AS fn,
 sum((end_cls<>start_cls AND pred_cls=end_cls)::INT) AS hit,
 sum((end_cls<>start_cls OR pred_cls<>start_cls)::INT) AS un,
 sum((end_cls<>start_cls)::INT) AS tr, sum((end_cls=pred_cls)::INT) AS ok FROM m GROUP BY ALL),
mq AS (SELECT area, fraction, sum(abs(t - p)) / (2.0 * sum(t))::DOUBLE AS q FROM (
 SELECT area, fraction, cls, sum(t) AS t, sum(p) AS p FROM (
  SELECT area, fraction, end_cls AS cls, 1 AS t, 0 AS p FROM m
  UNION ALL SELECT area, fraction, pred_cls, 0, 1 FROM m) GROUP BY ALL) GROUP BY ALL),
mr AS (SELECT *, CASE WHEN tp+fp=0 THEN 0.0 ELSE tp/(tp+fp) END::DOUBLE AS pr,
 CASE WHEN tp+fn=0 THEN 0.0 ELSE tp/(tp+fn) END::DOUBLE AS rc FROM mb JOIN mq USING (area, fraction)),
metrics AS (SELECT area, fraction, n_cells, pr AS change_precision, rc AS change_recall,
 CASE WHEN pr+rc=0 THEN 0.0 ELSE 2*pr*rc/(pr+rc) END AS change_f1,
 CASE WHEN un=0 THEN 1.0 ELSE hit/un END::DOUBLE AS fom,
 CASE WHEN tr=0 THEN 1.0 ELSE hit/tr END::DOUBLE AS transition_accuracy,
 q AS quantity_disagreement, greatest(0.0, (1.0 - ok/n_cells) - q)::DOUBLE AS allocation_disagreement FROM mr)"""


@query("g02_sweep_fractions", sql("grid", _SWEEP, "SELECT area, fraction, n_cells, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLS) + " FROM metrics"))
def g02(spark, sf):
    return r6(G.sweep_fractions(B.grid(spark, sf), AREA, FRACTIONS), *METRIC_COLS)


@query("g02_best_fraction", sql("grid", _SWEEP, """
l AS (SELECT area, fraction, 'change_f1' AS metric, round(change_f1,6) AS value, -round(change_f1,6) AS s FROM metrics
 UNION ALL SELECT area, fraction, 'fom', round(fom,6), -round(fom,6) FROM metrics
 UNION ALL SELECT area, fraction, 'allocation_disagreement', round(allocation_disagreement,6), round(allocation_disagreement,6) FROM metrics)""", """
SELECT area, metric, fraction, value FROM (SELECT *, row_number() OVER (PARTITION BY area, metric ORDER BY s, fraction) AS r FROM l) WHERE r=1"""))
def g02b(spark, sf):
    rows = r6(G.sweep_fractions(B.grid(spark, sf), AREA, FRACTIONS), *METRIC_COLS)
    return G.best_by_metric(rows, AREA, "fraction", ("change_f1", "fom"), ("allocation_disagreement",))


@query("g03_reliability_gate", sql("support", "trans", _SC, _loo(0.5, 500.0), """
n AS (SELECT area, start_cls AS from_cls, pred_cls AS to_cls, count(*) AS c FROM sc WHERE c GROUP BY ALL),
k AS (SELECT n.area, n.from_cls, n.to_cls, round_even(c*least(1.0, greatest(0.45,
 0.8 + 0.55*(coalesce(reliability, gg) - gg)/greatest(gg, 1e-6))), 0) AS k
 FROM n LEFT JOIN rel USING (area, from_cls, to_cls) JOIN (SELECT area, max(g) AS gg FROM rel GROUP BY area) USING (area)),
r AS (SELECT *, row_number() OVER (PARTITION BY area, start_cls, pred_cls ORDER BY score DESC, row, col) AS rk FROM sc WHERE c)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN sc.pred_cls ELSE sc.start_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) LEFT JOIN k ON k.area=sc.area AND k.from_cls=sc.start_cls AND k.to_cls=sc.pred_cls"""))
def g03(spark, sf):
    return G.reliability_gate(scored(spark, sf), AREA, loo_reliability(spark, sf), sized_by=B.grid(spark, sf)).select(*OUT)


@query("g04_support_reversion", sql("support", _SC, """
q AS (SELECT area, quantile_cont(score, 0.6) AS q, round_even(count(*)*0.05::DOUBLE, 0) AS k FROM sc WHERE c GROUP BY area),
e AS (SELECT sc.*, k, row_number() OVER (PARTITION BY sc.area ORDER BY target_support, score, row, col) AS rk
 FROM sc JOIN q USING (area) WHERE c AND target_support <= 0.25 AND score <= q)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN sc.start_cls ELSE sc.pred_cls END AS gated_cls
FROM sc LEFT JOIN e USING (area,row,col)"""))
def g04(spark, sf):
    return G.support_reversion(scored(spark, sf), AREA, 0.25, 0.6, 0.05, sized_by=B.grid(spark, sf)).select(*OUT)


_EXACT_K = """
n AS (SELECT area, start_cls AS from_cls, pred_cls AS to_cls, count(*) AS c FROM sc WHERE c GROUP BY ALL),
k AS (SELECT n.area, n.from_cls, n.to_cls, CASE WHEN c >= 20 AND coalesce(reliability, gg) < gg THEN
 round_even(c*(0.4*((gg - coalesce(reliability, gg))/greatest(gg, 1e-6))), 0) ELSE 0 END AS k
 FROM n LEFT JOIN rel USING (area, from_cls, to_cls) JOIN (SELECT area, max(g) AS gg FROM rel GROUP BY area) USING (area))"""


@query("g05_exactness_reversion", sql("support", "trans", _SC, _loo(1.0, 50.0), _EXACT_K, """
r AS (SELECT *, row_number() OVER (PARTITION BY area, start_cls, pred_cls ORDER BY score, row, col) AS rk FROM sc WHERE c)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN sc.start_cls ELSE sc.pred_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) LEFT JOIN k ON k.area=sc.area AND k.from_cls=sc.start_cls AND k.to_cls=sc.pred_cls"""))
def g05(spark, sf):
    rel = loo_reliability(spark, sf, 1.0, 50.0)
    return G.exactness_reversion(scored(spark, sf), AREA, rel, 0.4, 20, sized_by=B.grid(spark, sf)).select(*OUT)


@query("g06_spatial_exactness_reversion", sql("support", "trans", _SC, _loo(1.0, 50.0), _EXACT_K, """
r AS (SELECT *, row_number() OVER (PARTITION BY area, start_cls, pred_cls
 ORDER BY score + 0.75*target_support - 0.75*source_support, row, col) AS rk FROM sc WHERE c)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN sc.start_cls ELSE sc.pred_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) LEFT JOIN k ON k.area=sc.area AND k.from_cls=sc.start_cls AND k.to_cls=sc.pred_cls"""))
def g06(spark, sf):
    order = F.col("score") + F.lit(0.75) * F.col("target_support") - F.lit(0.75) * F.col("source_support")
    rel = loo_reliability(spark, sf, 1.0, 50.0)
    return G.exactness_reversion(scored(spark, sf), AREA, rel, 0.4, 20, order, B.grid(spark, sf)).select(*OUT)


@query("g06_group_support_stats", sql("support", _SC, """
SELECT area, start_cls AS from_cls, pred_cls AS to_cls, count(*) AS n, round(avg(target_support), 6) AS target_support_mean,
 round(avg(source_support), 6) AS source_support_mean, round(min(score), 6) AS rank_min, round(max(score), 6) AS rank_max
FROM sc WHERE c GROUP BY ALL"""))
def g06b(spark, sf):
    s = G.transition_group_stats(scored(spark, sf), AREA, F.col("score"))
    return r6(s, "target_support_mean", "source_support_mean", "rank_min", "rank_max")


def _budget_steps():
    """The class loop written out: classes 1..3 in order, each seeing earlier reversions."""
    parts, done = [], []
    for c in (1, 2, 3):
        back = " + ".join(
            f"(SELECT count(*) FROM rk r JOIN s{d} ON s{d}.area=r.area WHERE r.area=b.area AND r.pred_cls={d} AND r.start_cls={c} AND r.rk <= s{d}.k)"
            for d in done
        ) or "0"
        parts.append(f"""
t{c} AS (SELECT b.area, n + {back} AS n, cand, ratio FROM b JOIN ratios USING (cls) WHERE cls={c}),
u{c} AS (SELECT area, n, cand, greatest(0, n - round_even(0.5*n + 0.5*round_even(n*ratio, 0), 0)) AS o FROM t{c}),
s{c} AS (SELECT area, CASE WHEN o >= 3 THEN least(o, cand) ELSE 0 END AS k FROM u{c})""")
        done.append(c)
    return ",".join(parts)


@query("g07_class_budget", sql("grid", """
rk AS (SELECT *, row_number() OVER (PARTITION BY area, pred_cls ORDER BY score, row, col) AS rk FROM grid
 WHERE start_cls<>0 AND pred_cls<>0 AND pred_cls<>start_cls)""", """
ratios AS (SELECT cls, ratio::DOUBLE AS ratio FROM (VALUES (1, 0.9), (2, 0.8), (3, 1.05)) x(cls, ratio))""", """
b AS (SELECT area, pred_cls AS cls, count(*) AS n, sum((pred_cls<>start_cls)::INT) AS cand FROM grid
 WHERE start_cls<>0 AND pred_cls<>0 GROUP BY ALL)""", _budget_steps(), """
dk AS (SELECT area, 1 AS cls, k FROM s1 UNION ALL SELECT area, 2, k FROM s2 UNION ALL SELECT area, 3, k FROM s3)""", """
SELECT g.area, g.row, g.col, CASE WHEN rk.rk <= coalesce(dk.k,0) THEN g.start_cls ELSE g.pred_cls END AS gated_cls
FROM grid g LEFT JOIN rk USING (area,row,col) LEFT JOIN dk ON dk.area=g.area AND dk.cls=g.pred_cls"""))
def g07(spark, sf):
    ratios = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 1.05)], "cls int, ratio double")
    out = G.class_budget(B.grid(spark, sf), AREA, ratios, (1, 2, 3), 0.5, 3)
    return out.select(*OUT)


@query("g08_demand_gate", sql("support", "trans", _SC, _loo(0.5, 500.0), """
t AS (SELECT area, avg((end_cls<>start_cls)::INT)*0.8 AS f, round_even(avg((end_cls<>start_cls)::INT)*0.8*count(*), 0) AS k
 FROM sc WHERE start_cls<>0 AND pred_cls<>0 GROUP BY area),
o AS (SELECT sc.*, sc.score + 0.3*coalesce(reliability, gg) AS s FROM sc LEFT JOIN rel
 ON rel.area=sc.area AND rel.from_cls=start_cls AND rel.to_cls=pred_cls
 JOIN (SELECT area, max(g) AS gg FROM rel GROUP BY area) q ON q.area=sc.area),
r AS (SELECT area, row, col, row_number() OVER (PARTITION BY area ORDER BY s DESC, row, col) AS rk FROM o WHERE c)""", """
SELECT sc.area, sc.row, sc.col, CASE WHEN rk <= k THEN pred_cls ELSE start_cls END AS gated_cls
FROM sc LEFT JOIN r USING (area,row,col) JOIN t ON t.area=sc.area"""))
def g08(spark, sf):
    c = scored(spark, sf)
    rel = loo_reliability(spark, sf)
    g = rel.groupBy("area").agg(F.max("global_reliability").alias("_g"))
    on = [c.area == rel.area, c.start_cls == rel.from_cls, c.pred_cls == rel.to_cls]
    c = c.join(rel.drop("n", "global_reliability"), on, "left").drop(rel.area).join(g, "area")
    order = F.col("score") + F.lit(0.3) * F.coalesce("reliability", "_g")
    v = B.grid(spark, sf).filter("start_cls <> 0 and pred_cls <> 0")
    frac = v.groupBy("area").agg(
        (F.avg((F.col("end_cls") != F.col("start_cls")).cast("int")) * 0.8).alias("target_fraction"))
    return G.demand_gate(c, AREA, frac, order, B.grid(spark, sf)).select(*OUT)


@query("g09_scale_adaptive", sql("grid", _REFLECT, """
b AS (SELECT g.*, 1.0::DOUBLE*pred_box::DOUBLE - 0.5::DOUBLE*start_box::DOUBLE AS s, end_cls>0 AS v, (end_cls>0 AND pred_cls<>start_cls) AS c
 FROM grid g JOIN box USING (area,row,col)),
z AS (SELECT area, sum(v::INT) AS nv, sum(c::INT) AS nc FROM b GROUP BY area),
k AS (SELECT area, least(greatest(round_even(least(0.6, greatest(0.05, (nc/nv)*0.5*(CASE WHEN nv<1500 THEN 1.2 ELSE 0.8 END)))*nv, 0),0), nc) AS k FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY s DESC, row, col) AS rk FROM b WHERE c),
th AS (SELECT r.area, s AS t FROM r JOIN k ON r.area=k.area AND rk=k)""", """
SELECT b.area, row, col, CASE WHEN c AND (t IS NULL OR s < t) THEN start_cls ELSE pred_cls END AS gated_cls
FROM b LEFT JOIN th ON th.area=b.area"""))
def g09(spark, sf):
    c = H.uniform_class_support(B.grid(spark, sf), AREA, CLASSES)
    return G.scale_adaptive_gate(c, AREA, 0.5, 1.2, 0.8, 1500, 0.05, 0.6, 1.0, 0.5, B.grid(spark, sf)).select(*OUT)


@query("g10_hybrid_branch", sql("grid", "trans", _loo(0.5, 500.0), """
f AS (SELECT area, avg((pred_cls<>start_cls)::INT) AS ch FROM grid WHERE start_cls<>0 AND pred_cls<>0 GROUP BY area),
b AS (SELECT area, CASE WHEN gg < 0.29 THEN 'reliability' WHEN ch < 0.44 THEN 'low_change'
 WHEN ch < 0.46 THEN 'mild_support' ELSE 'high_change' END AS branch FROM f JOIN (SELECT area, max(g) AS gg FROM rel GROUP BY area) USING (area))""", """
SELECT g.area, row, col, branch, CASE branch WHEN 'reliability' THEN pred_cls WHEN 'low_change' THEN start_cls
 WHEN 'mild_support' THEN end_cls ELSE pred_cls END AS gated_cls FROM grid g JOIN b ON b.area=g.area"""))
def g10(spark, sf):
    g = B.grid(spark, sf)
    rel = loo_reliability(spark, sf).groupBy("area").agg(F.max("global_reliability").alias("reliability"))
    f = M.change_features(M.contingency(g, AREA), AREA).join(rel, "area")
    b = G.hybrid_branch(f, 0.29, 0.44, 0.46)
    src = {"reliability": "pred_cls", "low_change": "start_cls", "mild_support": "end_cls", "high_change": "pred_cls"}
    return G.choose_branch(g, AREA, b, src).select("area", "row", "col", "branch", "gated_cls")


@query("g11_start_class_selector", sql("grid", """
f AS (SELECT area, avg((start_cls=5)::INT) AS f FROM grid WHERE start_cls<>0 GROUP BY area)""", """
SELECT g.area, row, col, CASE WHEN f <= 0.2 THEN pred_cls ELSE end_cls END AS gated_cls FROM grid g JOIN f ON f.area=g.area"""))
def g11(spark, sf):
    g = B.grid(spark, sf)
    f = g.filter("start_cls <> 0").groupBy("area").agg(F.avg((F.col("start_cls") == 5).cast("int")).alias("f"))
    b = f.withColumn("branch", F.when(F.col("f") <= 0.2, "semantic").otherwise("fallback"))
    return G.choose_branch(g, AREA, b, {"semantic": "pred_cls", "fallback": "end_cls"}).select(*OUT)


@query("g12_consensus", sql("grid", """
SELECT area, row, col, ((pred_cls<>start_cls)::INT + (end_cls<>start_cls)::INT
  + ((pred_cls+end_cls)%6<>start_cls)::INT)::BIGINT AS support,
 CASE WHEN pred_cls<>start_cls AND ((pred_cls<>start_cls)::INT + (end_cls<>start_cls)::INT
  + ((pred_cls+end_cls)%6<>start_cls)::INT) >= 2 THEN pred_cls ELSE start_cls END AS gated_cls FROM grid"""))
def g12(spark, sf):
    g = B.grid(spark, sf).withColumn("mix_cls", ((F.col("pred_cls") + F.col("end_cls")) % 6).cast("int"))
    arr = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(c).alias("p"))
                    for n, c in (("a", "pred_cls"), ("b", "end_cls"), ("c", "mix_cls"))])
    long = g.select("area", "row", "col", "start_cls", F.inline(arr)).withColumnRenamed("p", "pred_cls")
    return G.consensus(long, AREA, "a", 2).select("area", "row", "col", "support", "gated_cls")
