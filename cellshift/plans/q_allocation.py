"""Baselines, demand and allocation over the grid view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import baselines as Z
from ..operators import demand as D
from ..operators import mapmetrics as M
from ..operators import neighbourhood as H
from ..operators.cells import leave_one_area_out
from ..operators.summaries import best_control
from . import bindings as B
from .q_inference import unit
from .registry import query, sql

AREA = ["area"]
CLASSES = (0, 1, 2, 3, 4, 5)
KNOWN = (1, 2, 3, 4, 5)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def cont(spark, sf):
    return M.contingency(B.grid(spark, sf), AREA)


def transition_counts(spark, sf):
    return B.grid(spark, sf).groupBy("area", F.col("start_cls").alias("from_cls"), F.col("end_cls").alias("to_cls")).agg(
        F.count("*").alias("n"))


def loo_counts(spark, sf):
    return leave_one_area_out(transition_counts(spark, sf), [], "area", ["from_cls", "to_cls"])


_LOO = """
tc AS (SELECT area, start_cls AS from_cls, end_cls AS to_cls, count(*) AS n FROM grid GROUP BY ALL),
ars AS (SELECT DISTINCT area FROM grid),
lc AS (SELECT ars.area, from_cls, to_cls, sum(n) AS n FROM ars JOIN tc ON tc.area<>ars.area GROUP BY ALL)"""
_HASH = "md5('{s}|' || area || '|' || row || '|' || col)"


@query("f01_persistence", sql("grid", "SELECT area, persistence_cls, count(*) AS n FROM (SELECT area, start_cls AS persistence_cls FROM grid) GROUP BY ALL"))
def f01(spark, sf):
    return Z.persistence(B.grid(spark, sf)).groupBy("area", "persistence_cls").agg(F.count("*").alias("n"))


_SHUF = f"""
sg AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY row, col) AS k FROM grid),
sh AS (SELECT area, pred_cls AS shuffled_cls, row_number() OVER (PARTITION BY area ORDER BY {_HASH.format(s=17)}, row, col) AS k FROM grid)"""


@query("f02_spatial_shuffle", sql("grid", _SHUF, "SELECT area, row, col, shuffled_cls FROM sg JOIN sh USING (area, k)"))
def f02(spark, sf):
    return Z.spatial_shuffle(B.grid(spark, sf), AREA, 17).select("area", "row", "col", "shuffled_cls")


_QUOTA = """
ex AS (SELECT area, from_cls, to_cls, n / sum(n) OVER (PARTITION BY area, from_cls) * total AS e, total
 FROM lc JOIN (SELECT area, start_cls AS from_cls, count(*) AS total FROM grid GROUP BY ALL) USING (area, from_cls)),
fl AS (SELECT *, floor(e)::BIGINT AS b, e - floor(e)::BIGINT AS r FROM ex),
dd AS (SELECT *, total - sum(b) OVER (PARTITION BY area, from_cls) AS d, row_number() OVER (PARTITION BY area, from_cls ORDER BY r DESC, to_cls) AS u FROM fl),
qt AS (SELECT area, from_cls, to_cls, (b + (u <= d)::INT)::BIGINT AS n FROM dd),
qc AS (SELECT *, sum(n) OVER (PARTITION BY area, from_cls ORDER BY to_cls) AS hi FROM qt),
pr AS (SELECT area, row, col, start_cls, end_cls, pred_cls, row_number() OVER (PARTITION BY area, start_cls ORDER BY """ + _HASH.format(s=18) + """, row, col) AS k FROM grid),
prior_map AS (SELECT p.*, coalesce(q.to_cls, p.start_cls) AS prior_cls FROM pr p LEFT JOIN qc q ON q.area=p.area AND q.from_cls=p.start_cls AND k <= hi AND k > hi - n)"""


@query("f03_transition_prior_map", sql("grid", _LOO, _QUOTA, "SELECT area, row, col, prior_cls FROM prior_map"))
def f03(spark, sf):
    p = Z.transition_prior(B.grid(spark, sf), AREA, loo_counts(spark, sf), 18)
    return p.select("area", "row", "col", "prior_cls")


@query("f03_transition_quotas", sql("grid", _LOO, _QUOTA, "SELECT area, from_cls, to_cls AS cls, n FROM qt"))
def f03b(spark, sf):
    return Z.transition_quotas(B.grid(spark, sf), AREA, loo_counts(spark, sf))


_TEMP = f"""
rt AS (SELECT area, count(*) AS n, avg((start_cls<>end_cls)::INT) AS r FROM grid GROUP BY area),
tk AS (SELECT a.area, round_even((SELECT sum(b.r) - a.r FROM rt b) / ((SELECT count(*) FROM rt) - 1) * a.n, 0) AS take FROM rt a),
hs AS (SELECT ars.area, k.cls, sum(k.n) AS n FROM ars JOIN (SELECT area, end_cls AS cls, count(*) AS n FROM grid WHERE start_cls<>end_cls GROUP BY ALL) k ON k.area<>ars.area GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY {_HASH.format(s=19)}, row, col) AS k,
 {unit("'20|' || area || '|' || row || '|' || col")} AS u FROM grid),
ct AS (SELECT rk.area, row, col, k, hs.cls, hs.n, sum(hs.n) OVER w AS acc, sum(hs.n) OVER (PARTITION BY rk.area, row, col) AS tot, u
 FROM rk JOIN hs ON hs.area=rk.area AND hs.cls<>start_cls WINDOW w AS (PARTITION BY rk.area, row, col ORDER BY hs.cls)),
dr AS (SELECT area, row, col, min(cls) AS cls FROM ct WHERE floor(u*tot) < acc GROUP BY ALL),
temp_map AS (SELECT rk.area, rk.row, rk.col, rk.start_cls, rk.end_cls, CASE WHEN k <= take THEN dr.cls ELSE start_cls END AS temporal_cls
 FROM rk JOIN tk ON tk.area=rk.area LEFT JOIN dr ON dr.area=rk.area AND dr.row=rk.row AND dr.col=rk.col)"""


@query("f04_temporal_prior_map", sql("grid", _LOO, _TEMP, "SELECT area, row, col, temporal_cls FROM temp_map"))
def f04(spark, sf):
    return Z.temporal_prior(B.grid(spark, sf), AREA, 19).select("area", "row", "col", "temporal_cls")


_F1 = """
ff AS (SELECT area, m, sum((end_cls<>start_cls AND p<>start_cls)::INT) AS tp, sum((end_cls=start_cls AND p<>start_cls)::INT) AS fp,
 sum((end_cls<>start_cls AND p=start_cls)::INT) AS fn FROM allm GROUP BY ALL),
f1 AS (SELECT area, m, CASE WHEN tp=0 THEN 0.0 ELSE 2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) END::DOUBLE AS f FROM ff)"""


@query("e03_registry_metric_row", sql("grid", _LOO, _SHUF, _QUOTA, _TEMP, """
allm AS (SELECT area, 'model' AS m, start_cls, end_cls, pred_cls AS p FROM grid UNION ALL SELECT area, 'persistence', start_cls, end_cls, start_cls FROM grid
 UNION ALL SELECT area, 'shuffle', start_cls, end_cls, shuffled_cls FROM sg JOIN sh USING (area, k)
 UNION ALL SELECT area, 'prior', start_cls, end_cls, prior_cls FROM prior_map UNION ALL SELECT area, 'temporal', start_cls, end_cls, temporal_cls FROM temp_map)""", _F1, """
w AS (SELECT area, max(f) FILTER (m='model') AS model, max(f) FILTER (m='shuffle') AS shuffle, max(f) FILTER (m='persistence') AS persistence,
 max(f) FILTER (m='prior') AS prior, max(f) FILTER (m='temporal') AS temporal FROM f1 GROUP BY area)""", """
SELECT area, round(model, 6) AS model, round(shuffle, 6) AS shuffle, round(persistence, 6) AS persistence, round(prior, 6) AS prior, round(temporal, 6) AS temporal,
 round(greatest(persistence, prior, temporal), 6) AS best_non_neural, round(model - greatest(persistence, prior, temporal), 6) AS primary_advantage,
 round(model - shuffle, 6) AS spatial_advantage FROM w"""))
def e03(spark, sf):
    base = B.grid(spark, sf)
    g = Z.spatial_shuffle(base, AREA, 17)
    g = Z.transition_prior(g, AREA, loo_counts(spark, sf), 18, base)
    g = Z.temporal_prior(g, AREA, 19, sized_by=base)
    names = {"model": "pred_cls", "shuffle": "shuffled_cls", "persistence": "start_cls", "prior": "prior_cls",
             "temporal": "temporal_cls"}
    c = M.method_contingency(g, AREA, names)
    f = M.binary_change(c, ["method", "area"]).groupBy("area").pivot("method", list(names)).agg(F.max("f1"))
    out = f.select("*", *best_control(["persistence", "prior", "temporal"], "model", "shuffle"))
    return r6(out, *[c for c in out.columns if c != "area"])


def year_pairs(spark, sf):
    from ..operators.cells import consecutive_years

    return consecutive_years(B.vecs(spark, sf), AREA, ["z"])


@query("f05_vector_moments", sql("vecs", """
p AS (SELECT a.z AS x, b.z AS y FROM vecs a JOIN vecs b ON a.area=b.area AND a.row=b.row AND a.col=b.col AND b.year=a.year+1),
l AS (SELECT x[i] AS xi, y[i]-x[i] AS di, i FROM p, (SELECT unnest(range(1,65)) AS i))""", """
SELECT 0::BIGINT AS i, round(count(*)::DOUBLE, 4) AS value FROM p UNION ALL SELECT i, round(sum(xi), 4) FROM l GROUP BY i UNION ALL SELECT 64+i, round(sum(di), 4) FROM l GROUP BY i
UNION ALL SELECT 128 + (i-1)*64 + j, round(sum(x[i]*x[j]), 4) FROM p, (SELECT unnest(range(1,65)) AS i), (SELECT unnest(range(1,65)) AS j) GROUP BY i, j
UNION ALL SELECT 128 + 4096 + (i-1)*64 + j, round(sum(x[i]*(y[j]-x[j])), 4) FROM p, (SELECT unnest(range(1,65)) AS i), (SELECT unnest(range(1,65)) AS j) GROUP BY i, j"""))
def f05(spark, sf):
    m = Z.vector_moments(year_pairs(spark, sf), "z", "next_z")
    return m.withColumn("value", F.round("value", 4))


@query("f05_linear_forecast")
def f05b(spark, sf):
    p = year_pairs(spark, sf)
    coef, intercept = Z.solve_ridge(Z.vector_moments(p, "z", "next_z"), 64, 1e-3)
    out = Z.linear_delta_forecast(p, "z", coef, intercept)
    return out.select("area", "row", "col", "year", F.round(F.col("forecast")[0], 4).alias("first_band"))


# ---- demand ------------------------------------------------------------------

def prior(spark, sf):
    return M.transition_prior(loo_counts(spark, sf), AREA, KNOWN)


_PRIOR = """
pn AS (SELECT area, from_cls, to_cls, n FROM lc WHERE from_cls>0 AND to_cls>0),
pri AS (SELECT r.area, r.from_cls, c.to_cls, coalesce(pn.n,0)/r.t AS prior FROM (SELECT area, from_cls, sum(n) AS t FROM pn GROUP BY ALL) r
 CROSS JOIN (SELECT unnest([0,1,2,3,4,5])::INT AS to_cls) c LEFT JOIN pn ON pn.area=r.area AND pn.from_cls=r.from_cls AND pn.to_cls=c.to_cls WHERE c.to_cls>0),
sc AS (SELECT area, start_cls AS cls, count(*) AS n FROM grid GROUP BY ALL), ec AS (SELECT area, end_cls AS cls, count(*) AS n FROM grid GROUP BY ALL),
pc AS (SELECT area, pred_cls AS cls, count(*) AS n FROM grid GROUP BY ALL), tt AS (SELECT area, count(*) AS total FROM grid GROUP BY area),
fr AS (SELECT area, total, unnest([0,1,2,3,4,5])::INT AS cls FROM tt),
fw AS (SELECT sc.area, coalesce(to_cls, sc.cls) AS cls, sum(coalesce(n * (prior / rs), n::DOUBLE)) AS e FROM sc LEFT JOIN (
 SELECT *, sum(prior) OVER (PARTITION BY area, from_cls) AS rs FROM pri) p ON p.area=sc.area AND p.from_cls=sc.cls GROUP BY ALL)"""


def _round_sql(name, src):
    """Largest-remainder rounding of (area, cls, e, total) as CTE text."""
    return f"""
{name}_f AS (SELECT *, floor(e)::BIGINT AS b, e - floor(e)::BIGINT AS r FROM ({src})),
{name}_d AS (SELECT *, total - sum(b) OVER (PARTITION BY area) AS d, row_number() OVER (PARTITION BY area ORDER BY r DESC, cls) AS u,
 row_number() OVER (PARTITION BY area ORDER BY r, cls DESC) AS v FROM {name}_f),
{name} AS (SELECT area, cls, (CASE WHEN d>0 AND u<=d THEN b+1 WHEN d<0 AND v<=-d AND b>0 THEN b-1 ELSE b END)::BIGINT AS n FROM {name}_d)"""


_PDEM = _round_sql("pdem", "SELECT fr.area, fr.cls, round(coalesce(e, 0.0), 9) AS e, total FROM fr LEFT JOIN fw USING (area, cls)")
_BLEND = _round_sql("bdem", "SELECT fr.area, fr.cls, 0.6::DOUBLE*coalesce(p.n,0) + 0.4::DOUBLE*coalesce(q.n,0) AS e, total FROM fr LEFT JOIN pdem p USING (area, cls) LEFT JOIN pc q USING (area, cls)")


def prior_demand(spark, sf):
    return D.prior_demand(cont(spark, sf), AREA, prior(spark, sf), CLASSES)


@query("i01_observed_demand", sql("grid", "SELECT area, end_cls AS cls, count(*) AS n FROM grid GROUP BY ALL"))
def i01(spark, sf):
    return D.derive_demand(cont(spark, sf), AREA, "observed_end")


_LR = _round_sql("lr", "SELECT area, cls, n*1.37 AS e, round(sum(n) OVER (PARTITION BY area)*1.37)::BIGINT + (area-3) AS total FROM (SELECT area, end_cls AS cls, count(*)::DOUBLE AS n FROM grid GROUP BY ALL)")


@query("i02_largest_remainder", sql("grid", _LR, "SELECT area, cls, n FROM lr"))
def i02(spark, sf):
    from pyspark.sql.window import Window as W

    k = B.grid(spark, sf).groupBy("area", F.col("end_cls").alias("cls")).agg(F.count("*").cast("double").alias("n"))
    t = F.round(F.sum("n").over(W.partitionBy("area")) * 1.37).cast("bigint") + F.col("area") - 3
    return D.largest_remainder(k.select("area", "cls", (F.col("n") * 1.37).alias("expected"), t.alias("total")), AREA)


@query("i03_prior_demand", sql("grid", _LOO, _PRIOR, _PDEM, "SELECT area, cls, n FROM pdem"))
def i03(spark, sf):
    return prior_demand(spark, sf)


@query("i04_blend_demand", sql("grid", _LOO, _PRIOR, _PDEM, _BLEND, "SELECT area, cls, n FROM bdem"))
def i04(spark, sf):
    c = cont(spark, sf)
    return D.derive_demand(c, AREA, "transition_prior_blend", CLASSES, prior(spark, sf), weight=0.4)


_FLAG = """
fl AS (SELECT fr.area, sum(abs(coalesce(p.n,0)-coalesce(q.n,0)))/any_value(total) AS l1 FROM fr LEFT JOIN pdem p USING (area, cls) LEFT JOIN pc q USING (area, cls) GROUP BY fr.area),
chf AS (SELECT area, avg((pred_cls<>start_cls)::INT) AS ch FROM grid GROUP BY area)"""


@query("i05_adaptive_blend", sql("grid", _LOO, _PRIOR, _PDEM, _BLEND, _FLAG, """
SELECT p.area, p.cls, CASE WHEN l1 >= 0.03 AND ch <= 0.55 THEN b.n ELSE p.n END AS n FROM pdem p JOIN bdem b USING (area, cls) JOIN fl USING (area) JOIN chf USING (area)"""))
def i05(spark, sf):
    return D.derive_demand(cont(spark, sf), AREA, "transition_prior_adaptive_blend", CLASSES, prior(spark, sf), 0.4, 0.03, 0.55)


_MINB = """
mb AS (SELECT area, sum(greatest(0, coalesce(e.n,0)-coalesce(s.n,0)))::BIGINT AS min_budget FROM sc s FULL JOIN ec e USING (area, cls) GROUP BY area),
gb AS (SELECT area, sum((pred_cls<>start_cls)::INT)::BIGINT AS budget, count(*) AS total FROM grid GROUP BY area)"""


@query("i06_change_budget", sql("grid", _LOO, _PRIOR, _MINB, """
SELECT area, budget, min_budget, greatest(min_budget, round_even(budget*0.35::DOUBLE, 0)::BIGINT) AS scaled_budget FROM gb JOIN mb USING (area)"""))
def i06(spark, sf):
    c = cont(spark, sf)
    return D.change_budget(c, AREA, D.derive_demand(c, AREA, "observed_end"), "prediction", 0.35)


@query("i07_budget_scale", sql("grid", """
gb AS (SELECT area, sum((pred_cls<>start_cls)::INT)::BIGINT AS budget, count(*) AS total FROM grid GROUP BY area),
p AS (SELECT area, least(start_cls,pred_cls) AS a, greatest(start_cls,pred_cls) AS b, sum((start_cls<pred_cls)::INT) AS u, sum((start_cls>pred_cls)::INT) AS d FROM grid WHERE start_cls<>pred_cls GROUP BY ALL),
c AS (SELECT area, sum(2*least(u,d))/sum(u+d) AS churn FROM p GROUP BY area)""", """
SELECT area, CASE WHEN churn >= 0.956 THEN 0.4 WHEN budget/total >= 0.515 THEN 0.7 WHEN budget/total <= 0.495 THEN 0.7 ELSE 1.0 END::DOUBLE AS scale FROM gb JOIN c USING (area)"""))
def i07(spark, sf):
    c = cont(spark, sf)
    f = D.gross_budget(c, AREA, "prediction").join(M.reciprocal_churn(c, AREA), "area").join(
        c.groupBy("area").agg(F.sum("n").alias("total")), "area")
    return D.budget_scale(f, 1.0, 0.7, 0.495, 0.515, 0.4, 0.956).select("area", "scale")


@query("i08_demand_violations", sql("grid", """
d AS (SELECT area, end_cls AS cls, CASE WHEN area=2 AND end_cls=1 THEN -5 ELSE count(*) END AS n FROM grid GROUP BY area, end_cls),
t AS (SELECT area, count(*) AS total FROM grid GROUP BY area)""", """
SELECT area, 'total_mismatch' AS reason, sum(n)::BIGINT AS value FROM d JOIN t USING (area) GROUP BY area HAVING sum(n) <> any_value(total)
UNION ALL SELECT area, 'negative_class', n FROM d WHERE n<0"""))
def i08(spark, sf):
    c = cont(spark, sf)
    d = D.derive_demand(c, AREA, "observed_end")
    d = d.withColumn("n", F.when((F.col("area") == 2) & (F.col("cls") == 1), F.lit(-5)).otherwise(F.col("n")))
    return D.demand_violations(c, AREA, d)


@query("i08_remaining_demand", sql("grid", """
d AS (SELECT area, end_cls AS cls, count(*) AS n FROM grid GROUP BY ALL),
f AS (SELECT area, start_cls AS cls, count(*) AS f FROM grid WHERE start_cls IN (0) OR row < 5 GROUP BY ALL)""", """
SELECT area, cls, (n - coalesce(f,0))::BIGINT AS remaining, n - coalesce(f,0) < 0 AS infeasible FROM d LEFT JOIN f USING (area, cls)"""))
def i08b(spark, sf):
    d = D.derive_demand(cont(spark, sf), AREA, "observed_end")
    can = D.editable(F.col("start_cls"), F.col("row") < 5, [0])
    return D.remaining_demand(B.grid(spark, sf), AREA, d, can)


# ---- allocation --------------------------------------------------------------

def scored(spark, sf):
    """Cells with a suitability array from hash-free, dense pseudo-probabilities."""
    g = B.grid(spark, sf)
    items = []
    for c in CLASSES:
        base = ((F.col("row") * 7 + F.col("col") * 3 + F.col("pred_cls") * 5 + c * 11) % 101) / 101.0
        bonus = F.when(F.col("pred_cls") == c, 0.5).otherwise(0.0)
        stay = F.when(F.col("start_cls") == c, 0.3).otherwise(0.0)
        items.append(F.struct(F.lit(c).alias("cls"), (base + bonus + stay).alias("score")))
    return g.withColumn("suit", F.array(*items))


_SUIT = """
su AS (SELECT g.area, g.row, g.col, g.start_cls, c AS cls, ((row*7 + col*3 + pred_cls*5 + c*11) % 101)/101.0
 + (CASE WHEN pred_cls=c THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN start_cls=c THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS score
 FROM grid g, (SELECT unnest([0,1,2,3,4,5])::INT AS c)),
dm AS (SELECT area, end_cls AS cls, count(*) AS n FROM grid GROUP BY ALL)"""
_STAY = """
mg AS (SELECT s.area, s.row, s.col, s.start_cls, max(s.score) FILTER (s.cls=s.start_cls) AS stay, max(s.score) FILTER (s.cls<>s.start_cls AND dm.n>0) AS best
 FROM su s LEFT JOIN dm ON dm.area=s.area AND dm.cls=s.cls GROUP BY ALL),
sr AS (SELECT mg.*, coalesce(dm.n,0) AS cap, row_number() OVER (PARTITION BY mg.area, start_cls ORDER BY coalesce(stay-best, 'inf'::DOUBLE) DESC, stay DESC, row, col) AS rk
 FROM mg LEFT JOIN dm ON dm.area=mg.area AND dm.cls=start_cls)"""


@query("i09_transition_suitability", sql("grid", _LOO, _PRIOR, """
x AS (SELECT g.area, row, col, start_cls, c AS cls, (CASE WHEN pred_cls=c THEN 0.95 ELSE 0.01 END)::DOUBLE AS p, (CASE WHEN start_cls=c THEN 0.95 ELSE 0.01 END)::DOUBLE AS s
 FROM grid g, (SELECT unnest([1,2,3,4,5])::INT AS c))""", """
SELECT x.area, row, col, x.cls, round(CASE WHEN start_cls=x.cls THEN 0.0 ELSE greatest(0.0, p + 0.5*greatest(p-s, 0.0) + 0.25*coalesce(prior, 0.0)) END::DOUBLE, 6) AS score
FROM x LEFT JOIN pri ON pri.area=x.area AND pri.from_cls=start_cls AND pri.to_cls=x.cls"""))
def i09(spark, sf):
    def probs(c):
        return F.create_map(*[v for k in KNOWN for v in (F.lit(k), F.when(F.col(c) == k, F.lit(0.95)).otherwise(F.lit(0.01)))])

    g = B.grid(spark, sf).withColumns({"fp": probs("pred_cls"), "sp": probs("start_cls")})
    s = A.suitability(g, KNOWN, "fp", "sp", prior(spark, sf), keys=AREA)
    return r6(s.select("area", "row", "col", F.inline("suit")), "score")


@query("i10_allocation_score", sql("grid", _SUIT, """
o AS (SELECT dr, dc FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc) WHERE NOT (dr=0 AND dc=0)),
k AS (SELECT g.area, g.row, g.col, n.start_cls AS cls, count(*) AS c FROM grid g, o JOIN grid n ON n.area=g.area AND n.row=g.row+dr AND n.col=g.col+dc GROUP BY ALL),
f AS (SELECT *, c/sum(c) OVER (PARTITION BY area,row,col) AS fr FROM k)""", """
SELECT su.area, su.row, su.col, su.cls, round(score + 0.4::DOUBLE*coalesce(fr, 0.0), 6) AS score FROM su LEFT JOIN f USING (area, row, col, cls)"""))
def i10(spark, sf):
    nb = H.class_fractions(B.grid(spark, sf), AREA, "start_cls", CLASSES)
    s = A.add_affinity(scored(spark, sf), nb, AREA, 0.4)
    return r6(s.select("area", "row", "col", F.inline("suit")), "score")


@query("i10_adaptive_weight", sql("grid", """
SELECT area, CASE WHEN ch <= 0.49 OR ch >= 0.51 THEN 0.8 ELSE 0.3 END::DOUBLE AS weight FROM (SELECT area, avg((pred_cls<>start_cls)::INT) AS ch FROM grid GROUP BY area)"""))
def i10b(spark, sf):
    ch = F.avg((F.col("pred_cls") != F.col("start_cls")).cast("int"))
    return B.grid(spark, sf).groupBy("area").agg(A.adaptive_weight(ch, 0.3, 0.8, 0.49, 0.51).alias("weight"))


@query("i11_stay_phase", sql("grid", _SUIT, _STAY, "SELECT area, row, col, rk <= cap AS stays FROM sr"))
def i11(spark, sf):
    d = D.derive_demand(cont(spark, sf), AREA, "observed_end").withColumnRenamed("n", "remaining")
    return A.stay_phase(scored(spark, sf), AREA, d).select("area", "row", "col", "stays")


_GREEDY = """
fc AS (SELECT area, row, col, start_cls FROM sr WHERE rk > cap),
cap0 AS (SELECT dm.area, dm.cls, dm.n - coalesce(s.k, 0) AS cap FROM dm LEFT JOIN (SELECT area, start_cls AS cls, count(*) AS k FROM sr WHERE rk <= cap GROUP BY ALL) s USING (area, cls))"""


def allocation(spark, sf):
    d = D.derive_demand(cont(spark, sf), AREA, "observed_end")
    return A.allocate(scored(spark, sf), AREA, d)


def _rounds(n=12):
    """Deferred acceptance written out: propose, keep the best up to capacity, reject, repeat."""
    parts = ["""
fp AS (SELECT fc.area, fc.row, fc.col, fc.start_cls, su.cls, su.score, c.cap FROM fc JOIN su USING (area, row, col)
 JOIN cap0 c ON c.area=fc.area AND c.cls=su.cls WHERE c.cap>0),
rej0 AS (SELECT area, row, col, cls FROM fp WHERE false)"""]
    for i in range(1, n + 1):
        parts.append(f"""
pp{i} AS (SELECT * FROM (SELECT fp.*, row_number() OVER (PARTITION BY fp.area, fp.row, fp.col ORDER BY score DESC, cls) AS pick
 FROM fp ANTI JOIN rej{i - 1} USING (area, row, col, cls)) WHERE pick=1),
rk{i} AS (SELECT *, row_number() OVER (PARTITION BY area, cls ORDER BY score DESC, row, col) AS rk FROM pp{i}),
rej{i} AS (SELECT * FROM rej{i - 1} UNION SELECT area, row, col, cls FROM rk{i} WHERE rk > cap)""")
    parts.append(f"chg AS (SELECT area, row, col, start_cls, cls AS alloc_cls, score FROM rk{n} WHERE rk <= cap)")
    return ",".join(parts)


@query("i12_capacity_greedy", sql("grid", _SUIT, _STAY, _GREEDY, _rounds(), """
SELECT area, row, col, start_cls, alloc_cls, round(score, 6) AS alloc_score FROM chg"""))
def i12(spark, sf):
    a = allocation(spark, sf).filter("phase = 'change'")
    return r6(a, "alloc_score").select("area", "row", "col", "start_cls", "alloc_cls", "alloc_score")


@query("i12_change_totals", sql("grid", _SUIT, _STAY, _GREEDY, _rounds(), """
SELECT area, alloc_cls, count(*) AS n FROM chg GROUP BY ALL"""))
def i12b(spark, sf):
    a = allocation(spark, sf).filter("phase = 'change'")
    return a.groupBy("area", "alloc_cls").agg(F.count("*").alias("n"))


ALLOWED = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (1, 3), (2, 5))


@query("i13_feasibility", sql("grid", """
d AS (SELECT area, end_cls AS cls, count(*) AS n FROM grid GROUP BY ALL), s AS (SELECT area, start_cls AS cls, count(*) AS n FROM grid GROUP BY ALL),
al AS (SELECT * FROM (VALUES (0,1),(1,2),(2,3),(3,4),(4,5),(5,0),(1,3),(2,5),(0,0),(1,1),(2,2),(3,3),(4,4),(5,5)) x(f,t)),
st AS (SELECT unnest(range(1,64)) AS m),
w AS (SELECT area, m, sum(n) AS need FROM st, d WHERE (m >> cls) & 1 = 1 GROUP BY ALL),
r AS (SELECT DISTINCT m, f FROM st, al WHERE (m >> t) & 1 = 1),
h AS (SELECT area, m, sum(n) AS have FROM r JOIN s ON s.cls=f GROUP BY ALL)""", """
SELECT area, greatest(0, max(need - coalesce(have,0)))::BIGINT AS shortfall, max(need - coalesce(have,0)) <= 0 AS feasible FROM w LEFT JOIN h USING (area, m) GROUP BY area"""))
def i13(spark, sf):
    c = cont(spark, sf)
    return A.feasibility(D.class_counts(c, AREA, "start_cls"), D.class_counts(c, AREA, "end_cls"), AREA, ALLOWED)


@query("i12_restricted")
def i12c(spark, sf):
    d = D.derive_demand(cont(spark, sf), AREA, "observed_end")
    a = A.allocate(scored(spark, sf), AREA, d, allowed=ALLOWED)
    return r6(a, "alloc_score").select("area", "row", "col", "start_cls", "alloc_cls", "phase", "alloc_score")


_DONE = """
al AS (SELECT area, row, col, start_cls, start_cls AS alloc_cls FROM sr WHERE rk <= cap UNION ALL SELECT area, row, col, start_cls, alloc_cls FROM chg)"""


def _swaps(budget: str, floor: float, margin: float, most: int) -> str:
    """One pair after the other. A cell needs no more partners than there are swaps: each swap uses one of them up at most."""
    return f"""
sd AS (SELECT al.area, al.row, al.col, al.row*100000+al.col AS pos, al.start_cls AS a, su.cls AS b, su.score AS s,
  su.score - max(su.score) FILTER (su.cls=al.start_cls) OVER (PARTITION BY al.area, al.row, al.col) AS m
 FROM al JOIN su USING (area, row, col) WHERE al.alloc_cls=al.start_cls),
sf AS (SELECT * FROM sd WHERE a<>b AND s >= {floor}),
pq AS (SELECT x.area, x.pos AS p, y.pos AS q, x.a AS u, x.b AS v, x.s + y.s AS score FROM sf x JOIN sf y ON x.area=y.area AND x.a=y.b AND x.b=y.a AND x.a<x.b
 WHERE x.m + y.m >= {margin} QUALIFY row_number() OVER (PARTITION BY x.area, x.a, x.b, x.pos ORDER BY y.s DESC, y.pos) <= {most + 1}),
pr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, least(p,q), greatest(p,q)) AS o FROM pq),
bud AS ({budget}),
rs AS (
 SELECT area, n_swaps, 0 AS k, []::BIGINT[] AS used FROM bud
 UNION ALL
 SELECT rs.area, n_swaps, k + 1, list_append(list_append(used, arg_min(p, o)), arg_min(q, o)) FROM rs JOIN pr USING (area)
 WHERE k < n_swaps AND NOT list_contains(used, p) AND NOT list_contains(used, q) GROUP BY rs.area, n_swaps, k, used),
lk AS (SELECT area, arg_max(used, k) AS used, max(k) AS k FROM rs GROUP BY area),
pk AS (SELECT area, used[2*i-1] AS p, used[2*i] AS q FROM (SELECT area, used, unnest(range(1, k + 1)) AS i FROM lk)),
sw AS (SELECT area, unnest([p, q]) AS pos, unnest([u, v]) AS from_cls, unnest([v, u]) AS to_cls FROM pk JOIN pr USING (area, p, q))"""


@query("i14_balanced_swaps", sql("grid", _SUIT, _STAY, _GREEDY, _rounds(), _DONE, _swaps(
    "SELECT DISTINCT area, 40 AS n_swaps FROM grid", 0.2, 0.1, 40), """
SELECT area, (pos // 100000)::INT AS row, (pos % 100000)::INT AS col, from_cls, to_cls FROM sw"""))
def i14(spark, sf):
    a = allocation(spark, sf)
    sides = A.swap_sides(a, AREA, min_side_base=0.2)
    budgets = a.groupBy("area").agg(F.lit(40).cast("bigint").alias("n_swaps"))
    return A.balanced_swaps(sides, AREA, budgets, min_margin=0.1)


@query("i14_swap_sides", sql("grid", _SUIT, """
w AS (SELECT *, max(score) FILTER (cls = start_cls) OVER (PARTITION BY area, row, col) AS stay FROM su)""", """
SELECT area, row, col, start_cls AS a, cls AS b, round(score, 6) AS s, round(score - stay, 6) AS m
FROM w JOIN (SELECT area, row, col, end_cls FROM grid) USING (area, row, col) WHERE cls<>start_cls AND end_cls=start_cls AND score >= 0.8"""))
def i14b(spark, sf):
    s = A.swap_sides(scored(spark, sf), AREA, cls="end_cls", min_side_base=0.8)
    return r6(s, "s", "m").drop("base")


@query("i15_allocation_driver", sql("grid", _SUIT, _STAY, _GREEDY, _rounds(), _DONE, """
h AS (SELECT area, start_cls AS cls, count(*) AS n FROM grid GROUP BY ALL),
tg AS (SELECT dm.area, sum(greatest(0, dm.n - coalesce(h.n, 0)))::BIGINT + 21 AS target FROM dm LEFT JOIN h USING (area, cls) GROUP BY dm.area),
ch AS (SELECT area, sum((alloc_cls<>start_cls)::INT) AS n FROM al GROUP BY area)""", _swaps(
    "SELECT area, greatest(0, (target - n) // 2)::BIGINT AS n_swaps FROM tg JOIN ch USING (area)", -9.0, -9.0, 64), """
fin AS (SELECT al.area, al.row, al.col, al.start_cls, coalesce(to_cls, alloc_cls) AS cls, to_cls FROM al LEFT JOIN sw ON sw.area=al.area AND pos=al.row*100000+al.col),
got AS (SELECT area, cls, count(*) AS n FROM fin GROUP BY ALL),
bad AS (SELECT area, sum(greatest(0, dm.n - coalesce(got.n, 0)))::BIGINT AS unmet FROM dm LEFT JOIN got USING (area, cls) GROUP BY area)""", """
SELECT area, sum((fin.cls<>fin.start_cls)::INT)::BIGINT AS n_changed, (count(to_cls) / 2)::BIGINT AS n_pairs, round(coalesce(sum(score) FILTER (to_cls IS NOT NULL), 0.0), 6) AS swap_score, any_value(unmet) AS unmet
FROM fin JOIN bad USING (area) JOIN su USING (area, row, col) WHERE su.cls=fin.cls GROUP BY area"""))
def i15b(spark, sf):
    d = D.derive_demand(cont(spark, sf), AREA, "observed_end")
    base = D.class_counts(cont(spark, sf), AREA, "start_cls").withColumnRenamed("n", "h").join(d, ["area", "cls"], "full_outer").groupBy(
        "area").agg(F.sum(F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.coalesce("h", F.lit(0)))).alias("b"))
    a = A.allocate_to_change(scored(spark, sf), AREA, d, base.select("area", (F.col("b") + 21).alias("target_change")))
    bad = A.allocation_result(a, AREA, d).groupBy("area").agg(F.sum("unmet").cast("bigint").alias("unmet"))
    swapped = F.col("phase") == "swap"
    n = a.groupBy("area").agg(
        F.sum((F.col("alloc_cls") != F.col("start_cls")).cast("bigint")).alias("n_changed"),
        (F.sum(swapped.cast("bigint")) / 2).cast("bigint").alias("n_pairs"),
        F.round(F.sum(F.when(swapped, F.col("alloc_score")).otherwise(0.0)), 6).alias("swap_score"))
    return n.join(bad, "area")


@query("i15_allocation_result", sql("grid", _SUIT, _STAY, _GREEDY, _rounds(), _DONE, """
got AS (SELECT area, alloc_cls AS cls, count(*) AS n FROM al GROUP BY ALL)""", """
SELECT area, cls, coalesce(dm.n, 0)::BIGINT AS target, coalesce(got.n, 0)::BIGINT AS achieved, greatest(0, coalesce(dm.n, 0) - coalesce(got.n, 0))::BIGINT AS unmet,
 coalesce(dm.n, 0) <> coalesce(got.n, 0) AS violated FROM dm FULL JOIN got USING (area, cls)"""))
def i15(spark, sf):
    d = D.derive_demand(cont(spark, sf), AREA, "observed_end")
    return A.allocation_result(A.allocate(scored(spark, sf), AREA, d), AREA, d).withColumn(
        "unmet", F.col("unmet").cast("bigint"))


_MASKED = [part.replace("grid", "eg") for part in (_SUIT, _STAY, _GREEDY, _rounds(), _DONE)]


@query("i15_masked_allocation", sql("grid", "eg AS (SELECT * FROM grid WHERE NOT (start_cls = 0 OR row < 5))", *_MASKED, """
SELECT area, row, col, start_cls, start_cls AS alloc_cls, 'fixed' AS phase FROM grid WHERE start_cls = 0 OR row < 5
UNION ALL SELECT area, row, col, start_cls, start_cls, 'stay' FROM sr WHERE rk <= cap
UNION ALL SELECT area, row, col, start_cls, alloc_cls, 'change' FROM chg"""))
def i15c(spark, sf):
    """An exclusion zone (the first rows) and an immutable class stay as they are; the demand counts them."""
    can = D.editable(F.col("start_cls"), F.col("row") < 5, [0])
    g = scored(spark, sf)
    d = g.groupBy("area", F.when(can, F.col("end_cls")).otherwise(F.col("start_cls")).alias("cls")).agg(F.count("*").alias("n"))
    return A.allocate(g, AREA, d, can_edit=can).select("area", "row", "col", "start_cls", "alloc_cls", "phase")


@query("i16_markov_row", sql("grid", "SELECT area, " + ", ".join(
    f"sum((end_cls={c})::INT)::BIGINT AS type{i}" for i, c in enumerate(CLASSES, 1)) + " FROM grid GROUP BY area"))
def i16(spark, sf):
    return D.markov_row(D.derive_demand(cont(spark, sf), AREA, "observed_end"), AREA, CLASSES)
