"""Neighbourhood queries: class fractions, supports, affinities, shifts, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbourhood as H
from . import bindings as B
from .registry import query, sql

AREA = ["area"]
CLASSES = (0, 1, 2, 3, 4, 5)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_PAIRS8 = """
off AS (SELECT dr, dc FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc) WHERE NOT (dr=0 AND dc=0)),
nb AS (SELECT g.area, g.row, g.col, n.start_cls AS nb_cls FROM grid g, off JOIN grid n
 ON n.area=g.area AND n.row=g.row+dr AND n.col=g.col+dc)"""


@query("h01_class_fraction", sql("grid", _PAIRS8, """
SELECT area, row, col, nb_cls, round((count(*)/sum(count(*)) OVER (PARTITION BY area,row,col))::DOUBLE, 6) AS fraction
FROM nb GROUP BY area, row, col, nb_cls"""))
def h01(spark, sf):
    return r6(H.class_fractions(B.grid(spark, sf), AREA, "start_cls", CLASSES), "fraction")


@query("h02_class_aligned_support", sql("support", """
SELECT area, row, col, round(target_support, 6) AS target_support, round(source_support, 6) AS source_support FROM support"""))
def h02(spark, sf):
    s = H.class_support(B.grid(spark, sf), AREA, CLASSES)
    return r6(s, "target_support", "source_support").select(
        "area", "row", "col", "target_support", "source_support")


@query("h03_multi_scale_support", sql("grid", """
o AS (SELECT w, dr, dc FROM (VALUES (3),(5)) x(w), (SELECT unnest(range(-2,3)) AS dr), (SELECT unnest(range(-2,3)) AS dc)
 WHERE abs(dr) <= w//2 AND abs(dc) <= w//2 AND NOT (dr=0 AND dc=0)),
f AS (SELECT g.area, g.row, g.col, w, avg((n.start_cls=g.pred_cls)::INT) AS t, avg((n.start_cls=g.start_cls)::INT) AS s
 FROM grid g, o JOIN grid n ON n.area=g.area AND n.row=g.row+dr AND n.col=g.col+dc GROUP BY ALL)""", """
SELECT area, row, col, round((sum(t)/2)::DOUBLE, 6) AS target_support, round((sum(s)/2)::DOUBLE, 6) AS source_support
FROM f GROUP BY ALL"""))
def h03(spark, sf):
    s = H.class_support(B.grid(spark, sf), AREA, CLASSES, windows=(3, 5))
    return r6(s, "target_support", "source_support").select(
        "area", "row", "col", "target_support", "source_support")


_REFLECT = """
ext AS (SELECT area, max(row)+1 AS h, max(col)+1 AS w FROM grid GROUP BY area),
pr AS (SELECT g.*, h, w, r FROM grid g JOIN ext USING (area),
 (SELECT unnest([0,1,2]) AS k) , LATERAL (SELECT CASE k WHEN 0 THEN row WHEN 1 THEN CASE WHEN row<2 THEN -row-1 END
  ELSE CASE WHEN row>=h-2 THEN 2*h-1-row END END AS r) WHERE r IS NOT NULL),
pc AS (SELECT area, r, c, start_cls, pred_cls FROM pr,
 (SELECT unnest([0,1,2]) AS k), LATERAL (SELECT CASE k WHEN 0 THEN col WHEN 1 THEN CASE WHEN col<2 THEN -col-1 END
  ELSE CASE WHEN col>=w-2 THEN 2*w-1-col END END AS c) WHERE c IS NOT NULL),
box AS (SELECT g.area, g.row, g.col, sum((p.pred_cls=g.pred_cls)::INT)/25.0 AS pred_box,
 sum((p.start_cls=g.start_cls)::INT)/25.0 AS start_box
 FROM grid g, (SELECT unnest(range(-2,3)) AS dr), (SELECT unnest(range(-2,3)) AS dc)
 JOIN pc p ON p.area=g.area AND p.r=g.row+dr AND p.c=g.col+dc GROUP BY ALL)"""


@query("h04_uniform_support", sql("grid", _REFLECT,
       "SELECT area, row, col, round(pred_box::DOUBLE, 6) AS pred_box, round(start_box::DOUBLE, 6) AS start_box FROM box"))
def h04(spark, sf):
    s = H.uniform_class_support(B.grid(spark, sf), AREA, CLASSES)
    return r6(s, "pred_box", "start_box").select("area", "row", "col", "pred_box", "start_box")


@query("h05_latent_affinity", sql("vecs", """
o AS (SELECT dr, dc FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc) WHERE NOT (dr=0 AND dc=0)),
p AS (SELECT g.year, g.area, g.row, g.col, n.cls AS nb_cls, greatest(0.0, list_cosine_similarity(g.z, n.z)) AS s
 FROM vecs g, o JOIN vecs n ON n.year=g.year AND n.area=g.area AND n.row=g.row+dr AND n.col=g.col+dc)""",
 "SELECT year, area, row, col, nb_cls, round(avg(s), 6) AS affinity FROM p GROUP BY ALL"))
def h05(spark, sf):
    return r6(H.latent_affinity(B.vecs(spark, sf), ["year", "area"], "cls", "z"), "affinity")


@query("h06_distance_affinity", sql("grid", """
o AS (SELECT dr, dc, greatest(abs(dr),abs(dc)) AS d FROM (SELECT unnest(range(-2,3)) AS dr), (SELECT unnest(range(-2,3)) AS dc))""", """
SELECT g.area, g.row, g.col, n.start_cls AS nb_cls, round(((3-min(d))/3.0)::DOUBLE, 6) AS affinity
FROM grid g, o JOIN grid n ON n.area=g.area AND n.row=g.row+dr AND n.col=g.col+dc GROUP BY ALL"""))
def h06(spark, sf):
    return r6(H.distance_affinity(B.grid(spark, sf), AREA, "start_cls", CLASSES), "affinity")


@query("h07_best_shift", sql("grid", """
ext AS (SELECT area, max(row)+1 AS h, max(col)+1 AS w, sum((end_cls<>start_cls)::INT) AS nt FROM grid GROUP BY area),
sh AS (SELECT dy::INT AS dy, dx::INT AS dx FROM (SELECT unnest(range(-4,5)) AS dy), (SELECT unnest(range(-4,5)) AS dx)),
mv AS (SELECT g.area, dy, dx, row+dy AS r, col+dx AS c, nt FROM grid g JOIN ext USING (area), sh
 WHERE pred_cls<>start_cls AND row+dy BETWEEN 0 AND h-1 AND col+dx BETWEEN 0 AND w-1),
sc AS (SELECT m.area, dy, dx, nt, count(*) AS np, sum((t.end_cls<>t.start_cls)::INT) AS tp
 FROM mv m LEFT JOIN grid t ON t.area=m.area AND t.row=m.r AND t.col=m.c GROUP BY ALL),
f AS (SELECT area, dy, dx, CASE WHEN tp=0 THEN 0.0 ELSE 2*(tp/np)*(tp/nt)/((tp/np)+(tp/nt)) END::DOUBLE AS f1 FROM sc),
b AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY f1 DESC, (dy<>0 OR dx<>0), dy, dx) AS r FROM f)""", """
SELECT b.area, round(raw.f1, 6) AS raw_f1, round(b.f1, 6) AS best_f1, b.dy AS best_dy, b.dx AS best_dx
FROM b JOIN f raw ON raw.area=b.area AND raw.dy=0 AND raw.dx=0 WHERE r=1"""))
def h07(spark, sf):
    return r6(H.best_shift(B.grid(spark, sf), AREA), "raw_f1", "best_f1")


@query("h08_coherence", sql("vecs", """
p AS (SELECT a.year, a.area, list_cosine_similarity(a.z, b.z) AS s FROM vecs a JOIN vecs b
 ON a.year=b.year AND a.area=b.area AND a.cls=3 AND b.cls=3
 AND ((b.row=a.row AND b.col=a.col+1) OR (b.row=a.row+1 AND b.col=a.col))),
k AS (SELECT year, area, avg(s) AS m FROM p GROUP BY ALL)""", """
SELECT year, area, round(coalesce(m, 0.0), 6) AS coherence FROM (SELECT DISTINCT year, area FROM vecs) LEFT JOIN k USING (year, area)"""))
def h08(spark, sf):
    return r6(H.coherence(B.vecs(spark, sf), ["year", "area"], "cls", 3, "z"), "coherence")


@query("h09_tiles", sql("grid", """
ext AS (SELECT area, max(row)+1 AS h, max(col)+1 AS w FROM grid GROUP BY area),
p AS (SELECT area, r, c, start_cls FROM grid JOIN ext USING (area),
 LATERAL (SELECT row AS r UNION ALL SELECT 2*h-2-row WHERE 2*h-2-row >= h AND 2*h-2-row < ceil(h/16)*16),
 LATERAL (SELECT col AS c UNION ALL SELECT 2*w-2-col WHERE 2*w-2-col >= w AND 2*w-2-col < ceil(w/16)*16))""", """
SELECT area, (r//16)::INT AS tile_row, (c//16)::INT AS tile_col, count(*) AS n, sum(start_cls)::BIGINT AS total
FROM p GROUP BY ALL"""))
def h09(spark, sf):
    t = H.tile_counts(B.grid(spark, sf), AREA, 16)
    return t.groupBy("area", "tile_row", "tile_col").agg(
        F.count("*").alias("n"), F.sum("start_cls").alias("total"))


@query("h09_untile", sql("grid", """
t AS (SELECT area, (row//8)::INT AS br, (col//8)::INT AS bc, round(avg(score), 4) AS token FROM grid GROUP BY ALL)""", """
SELECT g.area, row, col, token FROM grid g JOIN t ON t.area=g.area AND br=row//8 AND bc=col//8"""))
def h09b(spark, sf):
    g = B.grid(spark, sf)
    tok = g.groupBy("area", F.floor(F.col("row") / 8).cast("int").alias("block_row"),
                    F.floor(F.col("col") / 8).cast("int").alias("block_col")).agg(
        F.round(F.avg("score"), 4).alias("token"))
    return H.untile(g, tok, AREA, 8).select("area", "row", "col", "token")


@query("b22_shift_prediction", sql("grid", """
m AS (SELECT area, row+1 AS row, col-2 AS col, pred_cls FROM grid WHERE pred_cls<>start_cls)""", """
SELECT g.area, g.row, g.col, coalesce(m.pred_cls, g.start_cls) AS shifted_cls FROM grid g LEFT JOIN m USING (area,row,col)"""))
def b22(spark, sf):
    return H.shift_prediction(B.grid(spark, sf), AREA, 1, -2).select("area", "row", "col", "shifted_cls")


@query("d31_shifted_fate", sql("grid", """
tt AS (SELECT area, start_cls AS f, end_cls AS t, count(*) AS n FROM grid WHERE start_cls<>end_cls GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, f, t) AS rank FROM tt) WHERE rank <= 3),
m AS (SELECT area, row+1 AS row, col AS col, pred_cls AS mv FROM grid WHERE pred_cls<>start_cls),
s AS (SELECT g.*, coalesce(m.mv, g.start_cls) AS sh FROM grid g LEFT JOIN m USING (area,row,col)),
x AS (SELECT area, start_cls AS f, end_cls AS t, pred_cls AS c, 'raw' AS k FROM s UNION ALL SELECT area, start_cls, end_cls, sh, 'shifted' FROM s),
y AS (SELECT area, f, t, k, c, count(*) AS n, row_number() OVER (PARTITION BY area, f, t, k ORDER BY count(*) DESC, c) AS r FROM x GROUP BY area, f, t, k, c),
z AS (SELECT area, f, t, string_agg(c || ':' || n, ';' ORDER BY r) FILTER (k='raw') AS raw_top, string_agg(c || ':' || n, ';' ORDER BY r) FILTER (k='shifted') AS shifted_top
 FROM y WHERE r <= 4 GROUP BY area, f, t)""", """
SELECT top.area, top.f AS from_cls, top.t AS to_cls, top.n, rank::INT AS rank, sum((pred_cls=top.t)::INT)::BIGINT AS raw_matches,
 sum((sh=top.t)::INT)::BIGINT AS shifted_matches, raw_top, shifted_top FROM top JOIN z USING (area, f, t) JOIN s ON s.area=top.area AND start_cls=top.f AND end_cls=top.t
GROUP BY ALL"""))
def d31(spark, sf):
    from ..operators import mapmetrics as M
    from ..operators.neighbourhood import shift_prediction

    s = shift_prediction(B.grid(spark, sf), AREA, 1, 0)
    return M.shifted_fate(s, AREA, limit=3)
