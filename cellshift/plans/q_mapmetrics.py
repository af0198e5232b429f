"""Map comparison and class statistics over the grid view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapmetrics as M
from . import bindings as B
from .registry import query, sql

AREA = ["area"]
KNOWN = (1, 2, 3, 4, 5)


def cont(spark, sf):
    return M.contingency(B.grid(spark, sf), AREA)


def _round(df, *names, dp=6):
    return df.withColumns({n: F.round(n, dp) for n in names})


_BINARY = """
b AS (SELECT area, sum((end_cls<>start_cls AND pred_cls<>start_cls)::INT)::BIGINT AS tp,
 sum((end_cls=start_cls AND pred_cls<>start_cls)::INT)::BIGINT AS fp,
 sum((end_cls<>start_cls AND pred_cls=start_cls)::INT)::BIGINT AS fn,
 sum((end_cls<>start_cls AND pred_cls=end_cls)::INT)::BIGINT AS hit,
 sum((end_cls<>start_cls OR pred_cls<>start_cls)::INT)::BIGINT AS un,
 sum((end_cls<>start_cls)::INT)::BIGINT AS tr, sum((end_cls=pred_cls)::INT)::BIGINT AS ok,
 count(*) AS n FROM grid GROUP BY area)"""
_BAL = """
bal AS (SELECT area, cls, sum(t)::BIGINT AS n_true, sum(p)::BIGINT AS n_pred FROM (
 SELECT area, end_cls AS cls, 1 AS t, 0 AS p FROM grid
 UNION ALL SELECT area, pred_cls, 0, 1 FROM grid) GROUP BY ALL)"""
_QTY = """
qty AS (SELECT area, sum(abs(n_true - n_pred)) / (2.0 * sum(n_true))::DOUBLE AS q FROM bal GROUP BY area)"""


@query("d01_binary_change", sql("grid", _BINARY, """
SELECT area, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END::DOUBLE AS p,
 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END::DOUBLE AS r FROM b)"""))
def d01(spark, sf):
    return _round(M.binary_change(cont(spark, sf), AREA), "precision", "recall", "f1")


@query("d02_figure_of_merit", sql("grid", _BINARY,
       "SELECT area, round(CASE WHEN un = 0 THEN 1.0 ELSE hit / un END::DOUBLE, 6) AS fom FROM b"))
def d02(spark, sf):
    return _round(M.figure_of_merit(cont(spark, sf), AREA), "fom")


@query("d03_transition_accuracy", sql("grid", _BINARY,
       "SELECT area, round(CASE WHEN tr = 0 THEN 1.0 ELSE hit / tr END::DOUBLE, 6) AS transition_accuracy FROM b"))
def d03(spark, sf):
    return _round(M.transition_accuracy(cont(spark, sf), AREA), "transition_accuracy")


@query("d04_quantity_disagreement", sql("grid", _BAL, _QTY,
       "SELECT area, round(q, 6) AS quantity_disagreement FROM qty"))
def d04(spark, sf):
    return _round(M.quantity_disagreement(cont(spark, sf), AREA), "quantity_disagreement")


@query("d05_allocation_disagreement", sql("grid", _BINARY, _BAL, _QTY, """
SELECT area, round(greatest(0.0, (1.0 - ok / n) - q)::DOUBLE, 6) AS allocation_disagreement
FROM b JOIN qty USING (area)"""))
def d05(spark, sf):
    return _round(M.allocation_disagreement(cont(spark, sf), AREA), "allocation_disagreement")


_METHODS = """
m AS (SELECT 'model' AS method, area, start_cls, end_cls, pred_cls FROM grid
 UNION ALL SELECT 'persistence', area, start_cls, end_cls, start_cls FROM grid),
mb AS (SELECT method, area, count(*) AS n_cells,
 sum((end_cls<>start_cls AND pred_cls<>start_cls)::INT) AS tp,
 sum((end_cls=start_cls AND pred_cls<>start_cls)::INT) AS fp,
 sum((end_cls<>start_cls AND pred_cls=start_cls)::INT) AS fn,
 sum((end_cls<>start_cls AND pred_cls=end_cls)::INT) AS hit,
 sum((end_cls<>start_cls OR pred_cls<>start_cls)::INT) AS un,
 sum((end_cls<>start_cls)::INT) AS tr, sum((end_cls=pred_cls)::INT) AS ok FROM m GROUP BY ALL),
mq AS (SELECT method, area, sum(abs(t - p)) / (2.0 * sum(t))::DOUBLE AS q FROM (
 SELECT method, area, cls, sum(t) AS t, sum(p) AS p FROM (
  SELECT method, area, end_cls AS cls, 1 AS t, 0 AS p FROM m
  UNION ALL SELECT method, area, pred_cls, 0, 1 FROM m) GROUP BY ALL) GROUP BY ALL),
mr AS (SELECT *, CASE WHEN tp+fp=0 THEN 0.0 ELSE tp/(tp+fp) END::DOUBLE AS pr,
 CASE WHEN tp+fn=0 THEN 0.0 ELSE tp/(tp+fn) END::DOUBLE AS rc FROM mb JOIN mq USING (method, area)),
metrics AS (SELECT method, area, n_cells, pr AS change_precision, rc AS change_recall,
 CASE WHEN pr+rc=0 THEN 0.0 ELSE 2*pr*rc/(pr+rc) END AS change_f1,
 CASE WHEN un=0 THEN 1.0 ELSE hit/un END::DOUBLE AS fom,
 CASE WHEN tr=0 THEN 1.0 ELSE hit/tr END::DOUBLE AS transition_accuracy,
 q AS quantity_disagreement, greatest(0.0, (1.0 - ok/n_cells) - q)::DOUBLE AS allocation_disagreement
 FROM mr)"""
METRIC_COLS = ("change_precision", "change_recall", "change_f1", "fom", "transition_accuracy",
               "quantity_disagreement", "allocation_disagreement")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLS)


def method_metrics(spark, sf):
    c = M.method_contingency(B.grid(spark, sf), AREA, {"model": "pred_cls", "persistence": "start_cls"})
    return M.metric_row(c, ["method", "area"])


@query("d06_method_metrics", sql("grid", _METHODS, f"SELECT method, area, n_cells, {_ROUNDED} FROM metrics"))
def d06(spark, sf):
    return _round(method_metrics(spark, sf), *METRIC_COLS)


@query("d07_variant_metrics", sql("grid", """
v AS (SELECT area, sum((end_cls<>start_cls AND pred_cls<>start_cls)::INT)::BIGINT AS tp,
 sum((end_cls=start_cls AND pred_cls<>start_cls)::INT)::BIGINT AS fp,
 sum((end_cls<>start_cls AND pred_cls=start_cls)::INT)::BIGINT AS fn,
 sum((end_cls=start_cls AND pred_cls=start_cls)::INT)::BIGINT AS tn, count(*) AS n_valid,
 sum((end_cls<>start_cls AND pred_cls=end_cls)::INT) AS hit, sum((end_cls<>start_cls)::INT) AS tr
 FROM grid WHERE end_cls > 0 GROUP BY area)""", """
SELECT area, tp, fp, fn, tn, n_valid,
 round(CASE WHEN tp=0 THEN 0.0 ELSE 2*(tp/(tp+fp))*(tp/(tp+fn))/(tp/(tp+fp)+tp/(tp+fn)) END::DOUBLE, 6) AS change_f1,
 round(CASE WHEN tp+fp+fn=0 THEN 0.0 ELSE tp/(tp+fp+fn) END::DOUBLE, 6) AS fom,
 round((hit/greatest(tr,1))::DOUBLE, 6) AS transition_accuracy,
 round(((fp+fn)/greatest(n_valid,1))::DOUBLE, 6) AS allocation_disagreement FROM v"""))
def d07(spark, sf):
    return _round(M.variant_metrics(cont(spark, sf), AREA), "change_f1", "fom",
                  "transition_accuracy", "allocation_disagreement")


@query("d08_validation_row", sql("grid", _METHODS, """
mm AS (SELECT method, area, sum((end_cls<>start_cls AND pred_cls=end_cls)::INT) / nullif(sum((end_cls<>start_cls)::INT),0) AS cca
 FROM m GROUP BY ALL),
ab AS (SELECT method, area, avg(abs(t-p)) / sum(t)::DOUBLE AS bias FROM (
 SELECT method, area, cls, sum(t) AS t, sum(p) AS p FROM (
  SELECT method, area, end_cls AS cls, 1 AS t, 0 AS p FROM m
  UNION ALL SELECT method, area, pred_cls, 0, 1 FROM m) GROUP BY ALL) GROUP BY ALL)""", """
SELECT method, area, round(change_precision, 6) AS precision, round(change_recall, 6) AS recall,
 round(change_f1, 6) AS f1, round(ok/mr.n_cells::DOUBLE, 6) AS end_accuracy,
 round(coalesce(cca, 0.0)::DOUBLE, 6) AS changed_cell_accuracy, round(bias, 6) AS area_bias_mae
FROM metrics JOIN mm USING (method, area) JOIN ab USING (method, area) JOIN mr USING (method, area)"""))
def d08(spark, sf):
    c = M.method_contingency(B.grid(spark, sf), AREA, {"model": "pred_cls", "persistence": "start_cls"})
    return _round(M.validation_row(c, ["method", "area"]), "precision", "recall", "f1",
                  "end_accuracy", "changed_cell_accuracy", "area_bias_mae")


@query("d09_area_bias", sql("grid", _BAL,
       "SELECT area, round(avg(abs(n_true - n_pred)) / sum(n_true)::DOUBLE, 6) AS area_bias_mae FROM bal GROUP BY area"))
def d09(spark, sf):
    return _round(M.area_bias(cont(spark, sf), AREA), "area_bias_mae")


@query("d10_transition_confusion", sql("grid", """
SELECT area, start_cls || '->' || end_cls AS true_transition, start_cls || '->' || pred_cls AS pred_transition,
 count(*) AS n FROM grid WHERE end_cls <> start_cls GROUP BY ALL"""))
def d10(spark, sf):
    return M.transition_confusion(cont(spark, sf), AREA)


@query("d11_pixel_accuracy", sql("grid", """
SELECT area, round(avg((pred_cls = end_cls)::INT)::DOUBLE, 6) AS end_accuracy,
 round(avg((pred_cls = start_cls)::INT)::DOUBLE, 6) AS start_accuracy FROM grid GROUP BY area"""))
def d11(spark, sf):
    return _round(M.pixel_accuracy(cont(spark, sf), AREA), "end_accuracy", "start_accuracy")


@query("d12_class_distribution", sql("grid", """
SELECT * FROM (SELECT area, end_cls, count(*) AS n,
 round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY area), 2) AS pct
 FROM grid GROUP BY area, end_cls) WHERE end_cls IN (1,2,3,4,5)"""))
def d12(spark, sf):
    return M.class_distribution(B.grid(spark, sf), AREA, "end_cls", KNOWN)


@query("d13_transition_matrix", sql("grid", """
SELECT area, start_cls AS from_cls, end_cls AS to_cls, count(*) AS n FROM grid
WHERE start_cls > 0 AND end_cls > 0 GROUP BY ALL"""))
def d13(spark, sf):
    return M.transition_matrix(cont(spark, sf), AREA, KNOWN)


@query("d14_matrix_difference", sql("grid", """
a AS (SELECT area, start_cls AS f, end_cls AS t, count(*) AS n FROM grid WHERE start_cls>0 AND end_cls>0 GROUP BY ALL),
p AS (SELECT area, start_cls AS f, pred_cls AS t, count(*) AS n FROM grid WHERE start_cls>0 AND pred_cls>0 GROUP BY ALL)""", """
SELECT * FROM (SELECT area, f AS from_cls, t AS to_cls, (coalesce(a.n,0) - coalesce(p.n,0))::BIGINT AS diff
FROM a FULL JOIN p USING (area, f, t)) WHERE diff <> 0"""))
def d14(spark, sf):
    c = cont(spark, sf)
    return M.matrix_difference(M.transition_matrix(c, AREA, KNOWN),
                               M.transition_matrix(c, AREA, KNOWN, "pred_cls"), AREA)


@query("d15_period_summary", sql("grid", """
SELECT area, count(*) AS n_valid, sum((start_cls<>end_cls)::INT)::BIGINT AS n_changed,
 sum((start_cls=end_cls)::INT)::BIGINT AS n_persistent,
 sum((start_cls<>4 AND end_cls=4)::INT)::BIGINT AS to_urban,
 sum((start_cls=4 AND end_cls<>4)::INT)::BIGINT AS from_urban,
 round(avg((start_cls<>end_cls)::INT)::DOUBLE, 6) AS changed_share
FROM grid WHERE start_cls <> 0 AND end_cls <> 0 GROUP BY area"""))
def d15(spark, sf):
    return _round(M.period_summary(cont(spark, sf), AREA, urban=4), "changed_share")


@query("d16_raster_profile", sql("grid", """
t AS (SELECT area, sum((start_cls<>0)::INT)::BIGINT AS nv, sum((start_cls=0)::INT)::BIGINT AS nz,
 max(row)+1 AS h, max(col)+1 AS w FROM grid GROUP BY area)""", """
SELECT area, start_cls, count(*) AS n, nv AS n_valid, nz AS n_outside, h::INT AS height, w::INT AS width,
 CASE WHEN start_cls<>0 THEN round(count(*)/nv::DOUBLE, 6) END AS share
FROM grid JOIN t USING (area) GROUP BY area, start_cls, nv, nz, h, w"""))
def d16(spark, sf):
    return _round(M.raster_profile(B.grid(spark, sf), AREA, "start_cls"), "share")


@query("d16_grid_profile", sql("grid", """
SELECT area, count(*) AS n_unmasked, min(score) AS min_value, max(score) AS max_value,
 round(avg(score), 4) AS mean_value FROM grid WHERE start_cls <> 0 GROUP BY area"""))
def d16b(spark, sf):
    p = M.grid_profile(B.grid(spark, sf), AREA, "score", F.col("start_cls") == 0)
    return _round(p, "mean_value", dp=4)


@query("d17_transition_prior", sql("grid", """
c AS (SELECT unnest([1,2,3,4,5])::INT AS to_cls),
k AS (SELECT start_cls AS from_cls, end_cls AS to_cls, count(*) AS n FROM grid
 WHERE start_cls>0 AND end_cls>0 GROUP BY ALL),
r AS (SELECT from_cls, sum(n) AS total FROM k GROUP BY from_cls)""", """
SELECT from_cls, to_cls, round(coalesce(n,0)/total::DOUBLE, 6) AS prior
FROM r CROSS JOIN c LEFT JOIN k USING (from_cls, to_cls)"""))
def d17(spark, sf):
    counts = M.transition_matrix(M.contingency(B.grid(spark, sf), []), [], KNOWN)
    return _round(M.transition_prior(counts, [], KNOWN), "prior")


@query("d18_transition_reliability", sql("trans", """
a AS (SELECT from_cls, to_cls, sum(n) AS n, sum(exact) AS e, sum(binary_hits) AS b FROM trans GROUP BY ALL),
g AS (SELECT sum(n) AS gn, sum(e) AS ge, sum(b) AS gb FROM a)""", """
SELECT from_cls, to_cls, n::BIGINT AS n,
 round((0.5 * ((e + 500.0*(ge/gn))/(n+500.0)) + 0.5 * ((b + 500.0*(gb/gn))/(n+500.0)))::DOUBLE, 6) AS reliability,
 round((0.5*(ge/gn) + 0.5*(gb/gn))::DOUBLE, 6) AS global_reliability FROM a, g"""))
def d18(spark, sf):
    hits = M.candidate_hits(M.contingency(B.grid(spark, sf), []), [])
    return _round(M.transition_reliability(hits, []), "reliability", "global_reliability")


@query("d19_reliability_weights", sql("trans", """
a AS (SELECT area, from_cls, to_cls, n, exact, sum(n) OVER (PARTITION BY area) AS gn,
 sum(exact) OVER (PARTITION BY area) AS ge FROM trans)""", """
SELECT area, from_cls, to_cls,
 round(least(1.0, greatest(0.2, 0.2 + 0.8*((exact + ge/gn)/(n + 1.0))))::DOUBLE, 6) AS weight,
 round((0.2 + 0.8*(ge/gn))::DOUBLE, 6) AS default_weight FROM a"""))
def d19(spark, sf):
    hits = M.candidate_hits(cont(spark, sf), AREA)
    return _round(M.reliability_weights(hits, AREA), "weight", "default_weight")


@query("d20_class_count_ratio", sql("grid", """
u AS (SELECT cls, sum(t) AS t, sum(p) AS p FROM (
 SELECT end_cls AS cls, 1 AS t, 0 AS p FROM grid WHERE start_cls<>0 AND end_cls<>0 AND pred_cls<>0
 UNION ALL SELECT pred_cls, 0, 1 FROM grid WHERE start_cls<>0 AND end_cls<>0 AND pred_cls<>0) GROUP BY cls)""",
 "SELECT cls, round(CASE WHEN p + 2.0 > 0 THEN (t + 2.0)/(p + 2.0) ELSE 1.0 END::DOUBLE, 6) AS ratio FROM u"))
def d20(spark, sf):
    c = M.contingency(B.grid(spark, sf), [])
    return _round(M.class_count_ratio(c, [], smoothing=2.0), "ratio")


@query("d21_collapse_expansion", sql("grid", """
c AS (SELECT area, count(*) AS n_valid, sum((start_cls=4)::INT)::BIGINT AS shrink_start,
 sum((pred_cls=4)::INT)::BIGINT AS shrink_pred, sum((start_cls=5)::INT)::BIGINT AS grow_start,
 sum((pred_cls=5)::INT)::BIGINT AS grow_pred FROM grid WHERE start_cls<>0 AND pred_cls<>0 GROUP BY area)""", """
SELECT *, (n_valid > 0 AND shrink_start/n_valid >= 0.03
 AND (CASE WHEN shrink_start > 0 THEN shrink_pred/shrink_start ELSE 1.0 END) <= 1.02
 AND (grow_pred - grow_start)/n_valid >= -0.005) AS triggered FROM c"""))
def d21(spark, sf):
    return M.collapse_expansion(cont(spark, sf), AREA, 4, 5, 0.03, 1.02, -0.005)


@query("d22_change_features", sql("grid", """
v AS (SELECT * FROM grid WHERE start_cls<>0 AND pred_cls<>0),
k AS (SELECT area, start_cls, count(*) AS c FROM v GROUP BY ALL),
h AS (SELECT area, sum(c) AS n, -sum((c/t)*ln(greatest(c/t,1e-12))) AS h, count(*) AS k FROM
 (SELECT *, sum(c) OVER (PARTITION BY area) AS t FROM k) GROUP BY area),
s AS (SELECT area, avg((pred_cls<>start_cls)::INT) AS ch, avg((start_cls=5)::INT) AS ss,
 avg((pred_cls=5)::INT) AS ps FROM v GROUP BY area)""", """
SELECT area, n::BIGINT AS n_valid, round(ch::DOUBLE, 6) AS change_fraction,
 round(ss::DOUBLE, 6) AS start_selector_fraction, round(ps::DOUBLE, 6) AS pred_selector_fraction,
 round((h/greatest(ln(greatest(k,2)),1e-12))::DOUBLE, 6) AS entropy,
 round(least(1.0, k/10.0)::DOUBLE, 6) AS richness FROM h JOIN s USING (area)"""))
def d22(spark, sf):
    return _round(M.change_features(cont(spark, sf), AREA), "change_fraction",
                  "start_selector_fraction", "pred_selector_fraction", "entropy", "richness")


@query("d23_reciprocal_churn", sql("grid", """
p AS (SELECT area, least(start_cls,pred_cls) AS a, greatest(start_cls,pred_cls) AS b,
 sum((start_cls<pred_cls)::INT) AS u, sum((start_cls>pred_cls)::INT) AS d
 FROM grid WHERE start_cls<>pred_cls GROUP BY ALL)""",
 "SELECT area, round(sum(2*least(u,d))/sum(u+d)::DOUBLE, 6) AS churn FROM p GROUP BY area"))
def d23(spark, sf):
    return _round(M.reciprocal_churn(cont(spark, sf), AREA), "churn")


@query("d24_pair_evidence", sql("grid", """
k AS (SELECT start_cls AS f, end_cls AS t, count(*) AS n FROM grid WHERE start_cls>0 AND end_cls>0 GROUP BY ALL),
pr AS (SELECT f, t, n/sum(n) OVER (PARTITION BY f) AS prior FROM k),
p AS (SELECT area, start_cls AS f, pred_cls AS t, count(*) AS n FROM grid WHERE start_cls<>pred_cls GROUP BY ALL),
g AS (SELECT area, sum(n) AS gross FROM p GROUP BY area),
s AS (SELECT area, start_cls AS f, count(*) AS n FROM grid GROUP BY ALL),
w AS (SELECT area, a, b, f, t FROM (SELECT DISTINCT area FROM grid),
 (VALUES (1,2,1,2),(1,2,2,1),(3,5,3,5),(3,5,5,3)) AS x(a,b,f,t)),
j AS (SELECT area, a, b, min(coalesce(p.n,0)) AS mn, sum(coalesce(s.n,0)*coalesce(prior,0.0)) AS ex
 FROM w LEFT JOIN p USING (area,f,t) LEFT JOIN s USING (area,f) LEFT JOIN pr USING (f,t) GROUP BY ALL)""", """
SELECT area, a, b, round((2*mn/gross)::DOUBLE, 6) AS reciprocal_fraction, round(ex::DOUBLE, 6) AS expected_pixels,
 (2*mn/gross >= 0.05 AND ex >= 10) AS evidence FROM j JOIN g USING (area)"""))
def d24(spark, sf):
    base = B.grid(spark, sf)
    c = M.contingency(base, AREA)
    counts = M.transition_matrix(M.contingency(base, []), [], KNOWN)
    pairs = spark.createDataFrame([(1, 2), (3, 5)], "a int, b int")
    out = M.pair_evidence(c, AREA, M.transition_prior(counts, [], KNOWN), pairs, 0.05, 10.0)
    return _round(out, "reciprocal_fraction", "expected_pixels")


@query("d25_class_bias", sql("grid", _BAL, """
d AS (SELECT area, cls, n_pred - n_true AS d FROM bal)""", """
SELECT area, arg_min(cls, (-d) * 1000 + cls) AS over_cls, max(d)::BIGINT AS over_by,
 arg_min(cls, d * 1000 + cls) AS under_cls, (-min(d))::BIGINT AS under_by FROM d GROUP BY area"""))
def d25(spark, sf):
    return M.class_bias(cont(spark, sf), AREA)


@query("d26_class_weights", sql("grid", """
k AS (SELECT end_cls AS cls, count(*) AS n FROM grid GROUP BY ALL)""", """
SELECT cls, n, round(least(4.0, greatest(0.25, sqrt((SELECT quantile_cont(n::DOUBLE, 0.5) FROM k)/n)))::DOUBLE, 6) AS weight FROM k"""))
def d26(spark, sf):
    counts = B.grid(spark, sf).groupBy(F.col("end_cls").alias("cls")).agg(F.count("*").alias("n"))
    return _round(M.class_weights(counts), "weight")


@query("d26_positive_weight", sql("grid", """
k AS (SELECT area, sum((end_cls<>start_cls)::INT)::BIGINT AS pos, sum((end_cls=start_cls)::INT)::BIGINT AS neg FROM grid GROUP BY area)""",
 "SELECT area, pos, neg, round(CASE WHEN pos>0 THEN least(10.0, greatest(1.0, neg/pos)) ELSE 1.0 END::DOUBLE, 6) AS pos_weight FROM k"))
def d26b(spark, sf):
    return _round(M.positive_weight(cont(spark, sf), AREA), "pos_weight")


@query("d27_change_centroid", sql("grid", """
SELECT area, round(avg(row) FILTER (end_cls<>start_cls), 6) AS true_row,
 round(avg(col) FILTER (end_cls<>start_cls), 6) AS true_col FROM grid GROUP BY area"""))
def d27(spark, sf):
    c = M.centroid(B.grid(spark, sf), AREA, F.col("end_cls") != F.col("start_cls"), "true")
    return _round(c, "true_row", "true_col")


@query("d28_spillover", sql("grid", """
k AS (SELECT area, sum((end_cls<>pred_cls)::INT) AS h, count(*) AS o FROM grid
 WHERE NOT (row BETWEEN 10 AND 19 AND col BETWEEN 5 AND 24) GROUP BY area)""", """
SELECT area, h::BIGINT AS n_spill, o AS n_outside, round((100.0*h/greatest(o,1))::DOUBLE, 2) AS spill_pct FROM k"""))
def d28(spark, sf):
    zone = F.col("row").between(10, 19) & F.col("col").between(5, 24)
    return M.spillover(B.grid(spark, sf), AREA, zone, "end_cls", "pred_cls")


@query("d29_counterfactual_changed", sql("grid", """
SELECT area, sum((end_cls<>pred_cls)::INT)::BIGINT AS n_diff,
 round((100.0*sum((end_cls<>pred_cls)::INT)/count(*))::DOUBLE, 2) AS diff_pct FROM grid GROUP BY area"""))
def d29a(spark, sf):
    return M.counterfactual(B.grid(spark, sf), AREA, "end_cls", "pred_cls")[0]


@query("d29_counterfactual_classes", sql("grid", _BAL, """
SELECT area, cls, round((100.0*n_true/sum(n_true) OVER (PARTITION BY area)
 - 100.0*n_pred/sum(n_pred) OVER (PARTITION BY area))::DOUBLE, 2) AS pct_diff FROM bal"""))
def d29b(spark, sf):
    return M.counterfactual(B.grid(spark, sf), AREA, "end_cls", "pred_cls")[1]


_TOP3 = """
tt AS (SELECT area, start_cls AS f, end_cls AS t, count(*) AS n FROM grid WHERE start_cls<>end_cls GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, f, t) AS rank FROM tt) WHERE rank <= 3)"""


@query("d30_transition_fate", sql("grid", _TOP3, """
mx AS (SELECT area, f, t, pred_cls, count(*) AS c FROM top JOIN grid USING (area)
 WHERE start_cls=f AND end_cls=t GROUP BY ALL),
tx AS (SELECT area, f, t, string_agg(pred_cls || ':' || c, ';' ORDER BY c DESC, pred_cls) AS pred_mix FROM (
 SELECT *, row_number() OVER (PARTITION BY area,f,t ORDER BY c DESC, pred_cls) AS r FROM mx) WHERE r <= 4 GROUP BY ALL),
st AS (SELECT area, f, t, round(avg(score/600000.0), 6) AS mean_prob,
 round(quantile_cont(score/600000.0, 0.5), 6) AS median_prob FROM top JOIN grid USING (area)
 WHERE start_cls=f AND end_cls=t GROUP BY ALL)""", """
SELECT area, f AS from_cls, t AS to_cls, n, rank::INT AS rank, pred_mix, mean_prob, median_prob
FROM top JOIN tx USING (area,f,t) JOIN st USING (area,f,t)"""))
def d30(spark, sf):
    g = B.grid(spark, sf).withColumn("p", F.col("score") / 600000.0)
    return M.transition_fate(g, AREA, "p", limit=3, k=4)


@query("d30_top_mean_probability", sql("grid", """
l AS (SELECT area, end_cls AS cls, score/600000.0 AS p FROM grid UNION ALL
 SELECT area, pred_cls, 1 - score/600000.0 FROM grid),
m AS (SELECT area, cls, round(avg(p), 6) AS mean_prob FROM l GROUP BY ALL)""", """
SELECT area, cls, mean_prob, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY mean_prob DESC, cls) AS r FROM m) WHERE r <= 2"""))
def d30b(spark, sf):
    p = F.col("score") / 600000.0
    long = B.grid(spark, sf).select("area", F.inline(F.array(
        F.struct(F.col("end_cls").alias("cls"), p.alias("p")),
        F.struct(F.col("pred_cls").alias("cls"), (1 - p).alias("p")))))
    return M.top_mean_probabilities(long, AREA)


@query("d32_true_end_confidence", sql("grid", """
s AS (SELECT area, end_cls, count(*) AS n, round(avg(score/600000.0), 6) AS mean_prob,
 round(quantile_cont(score/600000.0, 0.5), 6) AS median_prob FROM grid GROUP BY ALL),
d AS (SELECT * FROM (SELECT area, end_cls, pred_cls AS modal_cls, count(*) AS modal_n,
 row_number() OVER (PARTITION BY area, end_cls ORDER BY count(*) DESC, pred_cls) AS r FROM grid GROUP BY area, end_cls, pred_cls) WHERE r = 1)""",
 "SELECT area, end_cls, n, mean_prob, median_prob, modal_cls, modal_n FROM s JOIN d USING (area, end_cls)"))
def d32(spark, sf):
    g = B.grid(spark, sf).withColumn("p", F.col("score") / 600000.0)
    return M.confidence_by_true_class(g, AREA, "end_cls", "p", "pred_cls")


@query("d38_confusion_cells", sql("grid", """
SELECT end_cls AS true_cls, pred_cls, count(*) AS n,
 round((count(*)/sum(count(*)) OVER (PARTITION BY end_cls))::DOUBLE, 6) AS share FROM grid GROUP BY end_cls, pred_cls"""))
def d38(spark, sf):
    c = B.grid(spark, sf).groupBy(F.col("end_cls").alias("true_cls"), "pred_cls").agg(F.count("*").alias("n"))
    return _round(M.confusion_report(c)[0], "share")


@query("d38_class_report", sql("grid", _BAL, """
x AS (SELECT cls, sum(n_true) AS t, sum(n_pred) AS p FROM bal GROUP BY cls),
h AS (SELECT end_cls AS cls, sum((end_cls=pred_cls)::INT) AS h FROM grid GROUP BY ALL)""", """
SELECT cls, t::BIGINT AS support, round((h/p)::DOUBLE, 6) AS precision, round((h/t)::DOUBLE, 6) AS recall,
 round((2*(h/p)*(h/t)/(h/p+h/t))::DOUBLE, 6) AS f1 FROM x JOIN h USING (cls)"""))
def d38b(spark, sf):
    c = B.grid(spark, sf).groupBy(F.col("end_cls").alias("true_cls"), "pred_cls").agg(F.count("*").alias("n"))
    return _round(M.confusion_report(c)[1], "precision", "recall", "f1")


@query("d06_pixel_bag_metrics", sql("pixels", """
b AS (SELECT area, count(*) AS n, sum((end_cls<>start_cls AND pred_cls=end_cls)::INT) AS hit,
 sum((end_cls<>start_cls OR pred_cls<>start_cls)::INT) AS un FROM pixels GROUP BY area)""",
 "SELECT area, n AS n_cells, round((hit/un)::DOUBLE, 6) AS fom FROM b"))
def d06b(spark, sf):
    c = M.contingency(B.pixels(spark, sf), AREA)
    return _round(M.metric_row(c, AREA).select("area", "n_cells", "fom"), "fom")


