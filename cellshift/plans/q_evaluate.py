"""End-to-end evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import demand as D
from ..operators import mapmetrics as M
from ..operators.neighbourhood import shift_prediction
from ..operators.summaries import focus_report
from . import bindings as B
from .evaluate import evaluate_methods, failure_records
from .q_allocation import _GREEDY, _STAY, _SUIT, _rounds, scored
from .q_mapmetrics import METRIC_COLS
from .registry import ORACLES, query, sql

AREA = ["area"]
METHODS = {"direct": "pred_cls", "persistence": "start_cls", "external": "shifted_cls"}


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def run(spark, sf):
    cells = shift_prediction(B.triple(spark, sf), AREA, 1, 1)
    return evaluate_methods(cells, AREA, METHODS, F.col("area") != 3)


_RUN = """
mv AS (SELECT area, row+1 AS row, col+1 AS col, pred_cls AS mp FROM triple WHERE pred_cls<>start_cls),
sh AS (SELECT t.*, coalesce(mp, start_cls) AS shifted_cls FROM triple t LEFT JOIN mv USING (area,row,col)),
ok AS (SELECT * FROM sh WHERE area IN (0,1,2,4)),
m AS (SELECT 'direct' AS method, area, start_cls, end_cls, pred_cls AS p FROM ok UNION ALL SELECT 'persistence', area, start_cls, end_cls, start_cls FROM ok
 UNION ALL SELECT 'external', area, start_cls, end_cls, shifted_cls FROM ok)"""


@query("e22_method_evaluation", sql("triple", _RUN, """
SELECT method, area, count(*) AS n_cells, round((sum((end_cls<>start_cls AND p=end_cls)::INT)/sum((end_cls<>start_cls OR p<>start_cls)::INT))::DOUBLE, 6) AS fom,
 round((sum((end_cls<>start_cls AND p=end_cls)::INT)/sum((end_cls<>start_cls)::INT))::DOUBLE, 6) AS transition_accuracy FROM m GROUP BY ALL"""))
def e22(spark, sf):
    return r6(run(spark, sf)[0], "fom", "transition_accuracy").select("method", "area", "n_cells", "fom", "transition_accuracy")


@query("e22_failures", sql("triple", """
f AS (SELECT * FROM (VALUES (3,'missing_embedding'),(5,'missing_label'),(6,'label_prediction_shape_mismatch'),(7,'class_collapse')) x(area, error))""", """
SELECT f.area, m.method, f.error FROM f, (VALUES ('direct'),('persistence'),('external')) m(method) WHERE f.area IN (SELECT area FROM triple)"""))
def e22b(spark, sf):
    return failure_records(run(spark, sf)[1], AREA, list(METHODS))


_ALLOC = """
am AS (SELECT g.area, g.start_cls, g.end_cls, g.pred_cls, coalesce(chg.alloc_cls, g.start_cls) AS alloc_cls FROM grid g LEFT JOIN chg USING (area, row, col)),
m AS (SELECT 'direct' AS method, area, start_cls, end_cls, pred_cls AS p FROM am UNION ALL SELECT 'persistence', area, start_cls, end_cls, start_cls FROM am
 UNION ALL SELECT 'allocated', area, start_cls, end_cls, alloc_cls FROM am),
"""
METRIC_ROWS = """
mb AS (SELECT method, area, count(*) AS n_cells, sum((end_cls<>start_cls AND p<>start_cls)::INT) AS tp, sum((end_cls=start_cls AND p<>start_cls)::INT) AS fp,
 sum((end_cls<>start_cls AND p=start_cls)::INT) AS fn, sum((end_cls<>start_cls AND p=end_cls)::INT) AS hit,
 sum((end_cls<>start_cls OR p<>start_cls)::INT) AS un, sum((end_cls<>start_cls)::INT) AS tr, sum((end_cls=p)::INT) AS ok FROM m GROUP BY ALL),
mq AS (SELECT method, area, sum(abs(t - p)) / (2.0 * sum(t))::DOUBLE AS q FROM (SELECT method, area, cls, sum(t) AS t, sum(p) AS p FROM (
  SELECT method, area, end_cls AS cls, 1 AS t, 0 AS p FROM m UNION ALL SELECT method, area, p, 0, 1 FROM m) GROUP BY ALL) GROUP BY ALL),
mr AS (SELECT *, CASE WHEN tp+fp=0 THEN 0.0 ELSE tp/(tp+fp) END::DOUBLE AS pr, CASE WHEN tp+fn=0 THEN 0.0 ELSE tp/(tp+fn) END::DOUBLE AS rc FROM mb JOIN mq USING (method, area))"""


@query("e22_allocation_evaluation", sql("grid", _SUIT, _STAY, _GREEDY, _rounds(), _ALLOC + METRIC_ROWS, """
SELECT method, area, n_cells, round(pr, 6) AS change_precision, round(rc, 6) AS change_recall, round(CASE WHEN pr+rc=0 THEN 0.0 ELSE 2*pr*rc/(pr+rc) END, 6) AS change_f1,
 round(CASE WHEN un=0 THEN 1.0 ELSE hit/un END::DOUBLE, 6) AS fom, round(CASE WHEN tr=0 THEN 1.0 ELSE hit/tr END::DOUBLE, 6) AS transition_accuracy,
 round(q, 6) AS quantity_disagreement, round(greatest(0.0, (1.0 - ok/n_cells) - q)::DOUBLE, 6) AS allocation_disagreement FROM mr"""))
def e22c(spark, sf):
    c = scored(spark, sf)
    d = D.derive_demand(M.contingency(B.grid(spark, sf), AREA), AREA, "observed_end")
    a = A.allocate(c, AREA, d)
    cont = M.method_contingency(a, AREA, {"direct": "pred_cls", "allocated": "alloc_cls", "persistence": "start_cls"})
    return r6(M.metric_row(cont, ["method", "area"]), *METRIC_COLS)


FOCUS, OTHERS = 3, (1, 5)
_ROLE = "CASE WHEN area=3 THEN 'focus' ELSE 'comparison' END AS role"


def focus(spark, sf):
    g = B.grid(spark, sf).withColumn("p", F.col("score") / 600000.0)
    return focus_report(g, FOCUS, OTHERS, "p")


@query("e27_focus_report", f"""
SELECT area, raw_f1, best_f1, best_dy, best_dx, end_accuracy, start_accuracy, from_cls AS top_from, to_cls AS top_to, n AS top_n, {_ROLE}
FROM ({ORACLES['h07_best_shift']}) JOIN ({ORACLES['d11_pixel_accuracy']}) USING (area) JOIN ({ORACLES['k03_first_per_area']}) USING (area) WHERE area IN (3, 1, 5)""")
def e27_report(spark, sf):
    return r6(focus(spark, sf)[0], "raw_f1", "best_f1", "end_accuracy", "start_accuracy")


@query("e27_focus_confidence", f"SELECT *, {_ROLE} FROM ({ORACLES['d32_true_end_confidence']}) WHERE area IN (3, 1, 5)")
def e27_confidence(spark, sf):
    return r6(focus(spark, sf)[1], "mean_prob", "median_prob")
