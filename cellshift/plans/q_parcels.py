"""Parcel, block and township queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbourhood as H
from ..operators import parcels as P
from . import bindings as B
from .registry import query, sql


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_KIND = """
k AS (SELECT *, CASE WHEN dlbm LIKE '011%' OR dlbm LIKE '013%' THEN 'farmland' WHEN dlbm LIKE '031%' OR dlbm LIKE '032%' THEN 'forest' ELSE 'barrier' END AS kind FROM parcels),
bw AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
_CC = """
cc(node, root) AS (SELECT parcel_id, parcel_id FROM k WHERE {cond}
 UNION SELECT bw.dst, cc.root FROM cc JOIN bw ON bw.src=cc.node JOIN k ON k.parcel_id=bw.dst WHERE {cond}),
comp AS (SELECT node AS parcel_id, min(root) AS component FROM cc GROUP BY node)"""
_SWAP = "kind IN ('farmland','forest')"


@query("p01_components", sql("parcels", "edges", _KIND, _CC.format(cond=_SWAP), "SELECT parcel_id, component FROM comp"))
def p01(spark, sf):
    return P.swappable_components(B.parcels(spark, sf), B.edges(spark, sf)).select("parcel_id", "component")


@query("p02_farmland_patches", sql("parcels", "edges", _KIND, _CC.format(cond="kind='farmland'"), """
SELECT component, count(*) AS n_parcels, round(sum(area_m2), 2) AS area_m2 FROM comp JOIN k USING (parcel_id) GROUP BY component HAVING sum(area_m2) >= 3000"""))
def p02(spark, sf):
    p = P.farmland_patches(B.parcels(spark, sf), B.edges(spark, sf), 3000.0)
    return p.withColumn("area_m2", F.round("area_m2", 2))


def _merges(n=18, most=30):
    """The merging rounds written out; further rounds than needed change nothing."""
    parts = [f"""
lg AS (SELECT parcel_id, component FROM comp QUALIFY count(*) OVER (PARTITION BY component) > {most}),
e0 AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src<>dst AND src IN (SELECT parcel_id FROM lg) AND dst IN (SELECT parcel_id FROM lg)),
m0 AS MATERIALIZED (SELECT parcel_id, parcel_id AS c FROM lg)"""]
    for i in range(1, n + 1):
        parts.append(f"""
z{i} AS MATERIALIZED (SELECT c, count(*) AS n, sum(parcel_id::DOUBLE) AS x, sum(slope::DOUBLE) AS y FROM m{i - 1} JOIN k USING (parcel_id) GROUP BY c),
f{i} AS MATERIALIZED (SELECT a, b, p.n*q.n/(p.n+q.n) * (pow(p.x/p.n - q.x/q.n, 2) + pow(p.y/p.n - q.y/q.n, 2)) AS cost, md5(a || '|' || b) AS mark
 FROM e{i - 1} JOIN z{i} p ON p.c=a JOIN z{i} q ON q.c=b WHERE p.n+q.n <= {most}),
h{i} AS (SELECT c, a, b FROM (SELECT a AS c, * FROM f{i} UNION ALL SELECT b, * FROM f{i}) QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, mark, a, b) = 1),
g{i} AS MATERIALIZED (SELECT a AS t, b AS c FROM h{i} GROUP BY a, b HAVING count(*) = 2),
m{i} AS MATERIALIZED (SELECT parcel_id, coalesce(t, m.c) AS c FROM m{i - 1} m LEFT JOIN g{i} USING (c)),
e{i} AS MATERIALIZED (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM (SELECT coalesce(p.t, f.a) AS u, coalesce(q.t, f.b) AS v FROM f{i} f LEFT JOIN g{i} p ON p.c=f.a LEFT JOIN g{i} q ON q.c=f.b) WHERE u<>v)""")
    return ",".join(parts)


@query("p03_define_blocks", sql("parcels", "edges", _KIND, _CC.format(cond=_SWAP), _merges(), """
pc AS (SELECT comp.parcel_id, component, coalesce(m18.c, component) AS piece, area_m2 FROM comp JOIN k USING (parcel_id) LEFT JOIN m18 USING (parcel_id)),
b AS (SELECT component, piece, count(*) AS n_parcels, sum(area_m2) AS block_area FROM pc GROUP BY ALL HAVING count(*)>=3 AND sum(area_m2)>=2000),
i AS (SELECT *, row_number() OVER (ORDER BY component, piece) - 1 AS block FROM b)""", """
SELECT pc.parcel_id, pc.component, pc.piece, i.block, i.n_parcels FROM pc JOIN i USING (component, piece)"""))
def p03(spark, sf):
    b = P.define_blocks(B.parcels(spark, sf).withColumn("x", F.col("parcel_id")), B.edges(spark, sf), ["x", "slope"], 30, 3, 2000.0)
    return b.select("parcel_id", "component", "piece", "block", "n_parcels")


_NB = """
nb AS (SELECT bw.src AS parcel_id, count(*) AS c FROM bw JOIN k ON k.parcel_id=bw.dst WHERE kind='farmland' GROUP BY bw.src),
kn AS (SELECT k.*, coalesce(c,0) AS nbr FROM k LEFT JOIN nb USING (parcel_id))"""
def _pairs(n=4):
    """The rounds written out: best farmland and forest of each block, swap, count neighbours of the block anew."""
    parts = ["""
ib AS (SELECT bw.src, bw.dst, a.block_id FROM bw JOIN k a ON a.parcel_id=src JOIN k b ON b.parcel_id=dst AND b.block_id=a.block_id),
s0 AS (SELECT block_id, parcel_id, kind, slope, nbr FROM kn WHERE kind<>'barrier')"""]
    for i in range(1, n + 1):
        parts.append(f"""
f{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY slope - 0.5::DOUBLE*nbr DESC, parcel_id) AS r FROM s{i - 1} WHERE kind='farmland') WHERE r=1),
o{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY slope - 0.25::DOUBLE*nbr, parcel_id) AS r FROM s{i - 1} WHERE kind='forest') WHERE r=1),
p{i} AS (SELECT f.block_id, {i} AS k, f.parcel_id AS farm_parcel, f.slope AS farm_slope, o.parcel_id AS forest_parcel, o.slope AS forest_slope
 FROM f{i} f JOIN o{i} o USING (block_id) WHERE f.slope > o.slope),
m{i} AS (SELECT block_id, farm_parcel AS src, -1 AS d FROM p{i} UNION ALL SELECT block_id, forest_parcel, 1 FROM p{i}),
c{i} AS (SELECT dst AS parcel_id, sum(d) AS d FROM m{i} JOIN ib USING (block_id, src) GROUP BY dst),
s{i} AS (SELECT s.block_id, s.parcel_id, s.kind, s.slope, s.nbr + coalesce(c.d, 0) AS nbr FROM s{i - 1} s JOIN p{i} USING (block_id)
 LEFT JOIN c{i} c ON c.parcel_id=s.parcel_id WHERE s.parcel_id NOT IN (SELECT src FROM m{i}))""")
    parts.append("\nsw AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, n + 1)) + ")")
    return ",".join(parts)


_PAIRS = _pairs()


def swaps(spark, sf):
    return P.greedy_block_swaps(B.parcels(spark, sf), B.edges(spark, sf), 4, 0.5, 0.25)


@query("p04_block_swaps", sql("parcels", "edges", _KIND, _NB, _PAIRS, "SELECT block_id, k, farm_parcel, farm_slope, forest_parcel, forest_slope FROM sw"))
def p04(spark, sf):
    return swaps(spark, sf)


@query("p05_swappable_blocks", sql("parcels", "edges", _KIND, """
SELECT block_id, sum((kind='farmland')::INT)::BIGINT AS n_farmland, sum((kind='forest')::INT)::BIGINT AS n_forest,
 sum((kind='farmland')::INT)>0 AND sum((kind='forest')::INT)>0 AS swappable FROM k GROUP BY block_id"""))
def p05(spark, sf):
    return P.swappable_blocks(B.parcels(spark, sf))


@query("p06_change_layer", sql("parcels", "edges", _KIND, _NB, _PAIRS, """
SELECT farm_parcel AS parcel_id, 'farmland' AS kind, 'forest' AS final_kind, 1 AS change FROM sw UNION ALL SELECT forest_parcel, 'forest', 'farmland', 2 FROM sw"""))
def p06(spark, sf):
    p = B.parcels(spark, sf)
    layer = P.change_layer(p, P.apply_swaps(p, swaps(spark, sf)))
    return layer.select("parcel_id", "kind", "final_kind", "change")


@query("d33_parcel_metrics", sql("parcels", "edges", _KIND, _NB, """
SELECT township, sum((kind='farmland')::INT)::BIGINT AS n_farmland, sum((kind='forest')::INT)::BIGINT AS n_forest,
 round(sum(CASE WHEN kind='farmland' THEN slope*area_m2 ELSE 0 END)/greatest(sum(CASE WHEN kind='farmland' THEN area_m2 ELSE 0 END), 1e-8), 6) AS avg_farmland_slope,
 round((sum(CASE WHEN kind='farmland' THEN nbr ELSE 0 END)/greatest(sum((kind='farmland')::INT),1))::DOUBLE, 6) AS contiguity FROM kn GROUP BY township"""))
def d33(spark, sf):
    m = P.parcel_metrics(B.parcels(spark, sf), B.edges(spark, sf), ["township"])
    return r6(m, "avg_farmland_slope", "contiguity")


def block_swaps(spark, sf):
    return B.parcels(spark, sf).select("block_id", (F.col("block_id") % 5).alias("swaps")).distinct()


FEATURES = ("f00_farm_slope", "f01_forest_slope", "f02_slope_gap", "f03_best_gain", "f04_farm_std", "f05_top_farm",
            "f06_bottom_forest", "f07_farm_area", "f08_forest_area", "f09_potential", "f10_swaps", "f11_compactness",
            "f12_block_area", "f13_adjacent_invested", "f14_adjacent_farm", "f15_all_farm", "f16_invested")


@query("d34_block_features", sql("parcels", "edges", _KIND, """
q AS (SELECT *, parcel_id % 11 = 0 AS swapped FROM k),
a AS (SELECT block_id, count(*) AS n, sum(area_m2) AS ba, coalesce(sum(area_m2) FILTER (kind='farmland' AND NOT swapped),0) AS fa,
 coalesce(sum(slope*area_m2) FILTER (kind='farmland' AND NOT swapped),0) AS fw, coalesce(sum(slope*slope*area_m2) FILTER (kind='farmland' AND NOT swapped),0) AS fq,
 max(slope) FILTER (kind='farmland' AND NOT swapped) AS top, coalesce(sum(area_m2) FILTER (kind='forest' AND NOT swapped),0) AS oa,
 coalesce(sum(slope*area_m2) FILTER (kind='forest' AND NOT swapped),0) AS ow, min(slope) FILTER (kind='forest' AND NOT swapped) AS low,
 count(*) FILTER (kind='farmland' AND NOT swapped) AS nf, count(*) FILTER (kind='forest' AND NOT swapped) AS no,
 coalesce(sum(area_m2) FILTER (kind='farmland'),0) AS af, block_id % 5 AS swaps FROM q GROUP BY block_id),
g AS (SELECT min(slope) AS smin, max(slope)-min(slope) AS sr FROM q), t AS (SELECT max(ba) AS amax FROM a),
ad AS (SELECT DISTINCT x.block_id AS b, y.block_id AS o FROM bw JOIN q x ON x.parcel_id=bw.src JOIN q y ON y.parcel_id=bw.dst WHERE x.block_id<>y.block_id),
n AS (SELECT b AS block_id, count(*) AS na, sum((swaps>0)::INT) AS ni, sum(af) AS naf FROM ad JOIN a ON a.block_id=o GROUP BY b),
v AS (SELECT a.*, g.*, t.*, coalesce(na,0) AS na, coalesce(ni,0) AS ni, coalesce(naf,0) AS naf, CASE WHEN fa>0 THEN fw/fa ELSE 0 END AS avf, CASE WHEN oa>0 THEN ow/oa ELSE 0 END AS avo,
 CASE WHEN fa>0 THEN fq/fa ELSE 0 END AS fqq, CASE WHEN fa>0 THEN top ELSE 0 END AS hi, CASE WHEN oa>0 THEN low ELSE 0 END AS lo, 4*pi()*ba/((40+n)*(40+n)) AS cp
 FROM a LEFT JOIN n USING (block_id), g, t)""", """
SELECT block_id, n AS n_parcels, round((avf-smin)/sr, 6) AS f00_farm_slope, round((avo-smin)/sr, 6) AS f01_forest_slope, round((avf-avo)/sr, 6) AS f02_slope_gap,
 round(CASE WHEN fa>0 AND oa>0 THEN hi-lo ELSE 0 END/sr, 6) AS f03_best_gain, round(sqrt(greatest(fqq-avf*avf,0.0))/sr, 6) AS f04_farm_std, round((hi-smin)/sr, 6) AS f05_top_farm,
 round((lo-smin)/sr, 6) AS f06_bottom_forest, round(fa/amax, 6) AS f07_farm_area, round(oa/amax, 6) AS f08_forest_area, round((least(nf,no)/greatest(n,1))::DOUBLE, 6) AS f09_potential,
 round((swaps/4)::DOUBLE, 6) AS f10_swaps, round(cp, 6) AS f11_compactness, round(ba/amax, 6) AS f12_block_area, round(CASE WHEN na>0 THEN ni/na ELSE 0 END::DOUBLE, 6) AS f13_adjacent_invested,
 round(CASE WHEN na>0 THEN naf/(amax*na) ELSE 0 END, 6) AS f14_adjacent_farm, round(af/amax, 6) AS f15_all_farm, (swaps>0)::INT::DOUBLE AS f16_invested FROM v"""))
def d34(spark, sf):
    p = B.parcels(spark, sf).withColumn("swapped", F.col("parcel_id") % 11 == 0)
    per = p.groupBy("block_id").agg((F.count("*") + 40).cast("double").alias("perimeter"))
    return r6(P.block_features(p, B.edges(spark, sf), block_swaps(spark, sf), 4, per), *FEATURES)


_ROLL = """
bs AS (SELECT DISTINCT township, block_id, block_id % 5 AS swaps FROM k),
ro AS (SELECT township, sum(CASE WHEN kind='farmland' THEN slope*area_m2 ELSE 0 END)/greatest(sum(CASE WHEN kind='farmland' THEN area_m2 ELSE 0 END), 1e-8) AS sl,
 sum(CASE WHEN kind='farmland' THEN area_m2 ELSE 0 END)/10000.0 AS ha FROM k GROUP BY township),
bb AS (SELECT township, count(*) AS n_blocks, sum(swaps)::BIGINT AS swaps_used, sum((swaps>0)::INT)::BIGINT AS blocks_invested FROM bs GROUP BY township)"""


@query("d35_township_rollup", sql("parcels", "edges", _KIND, _ROLL, """
SELECT township, round(sl, 6) AS avg_farmland_slope, round(ha, 6) AS farmland_ha, n_blocks, swaps_used, blocks_invested FROM ro JOIN bb USING (township)"""))
def d35(spark, sf):
    return r6(P.township_rollup(B.parcels(spark, sf), block_swaps(spark, sf)), "avg_farmland_slope", "farmland_ha")


@query("d35_investment_spread", sql("parcels", "edges", _KIND, _ROLL, """
p AS (SELECT swaps_used/((SELECT sum(swaps_used) FROM bb) + 1e-8) AS p FROM bb)""", """
SELECT round(sum(CASE WHEN p>0 THEN -p*ln(p) ELSE 0 END)/(ln(count(*))+1e-8), 6) AS entropy, round(max(p), 6) AS max_share FROM p"""))
def d35b(spark, sf):
    return r6(P.investment_spread(P.township_rollup(B.parcels(spark, sf), block_swaps(spark, sf))), "entropy", "max_share")


@query("d36_township_profile", sql("parcels", "edges", _KIND, """
u AS (SELECT township AS unit, * FROM k UNION ALL SELECT 'ALL', * FROM k)""", """
SELECT unit, count(*) AS n_parcels, round(100.0::DOUBLE*sum((kind='farmland')::INT)/count(*), 6) AS farmland_pct, round(100.0::DOUBLE*sum((kind='forest')::INT)/count(*), 6) AS forest_pct,
 round(100.0::DOUBLE*sum((kind<>'barrier')::INT)/count(*), 6) AS swappable_pct, round(avg(slope) FILTER (kind='farmland'), 6) AS farmland_slope,
 round(avg(slope) FILTER (kind='forest'), 6) AS forest_slope, min(area_m2) AS min_area, max(area_m2) AS max_area, round(avg(area_m2), 6) AS mean_area,
 round(quantile_cont(area_m2, 0.5), 6) AS median_area FROM u GROUP BY unit"""))
def d36(spark, sf):
    return r6(P.township_profile(B.parcels(spark, sf)), "farmland_pct", "forest_pct", "swappable_pct",
              "farmland_slope", "forest_slope", "mean_area", "median_area")


@query("d37_plan_score", sql("vecs", """
n AS (SELECT a.*, coalesce(b.cls, a.cls) AS after_cls FROM vecs a LEFT JOIN vecs b ON a.area=b.area AND a.row=b.row AND a.col=b.col AND b.year=a.year+1),
p AS (SELECT a.year, a.area, avg(list_cosine_similarity(a.z, b.z)) AS coh FROM vecs a JOIN vecs b ON a.year=b.year AND a.area=b.area AND a.cls=3 AND b.cls=3
 AND ((b.row=a.row AND b.col=a.col+1) OR (b.row=a.row+1 AND b.col=a.col)) GROUP BY ALL),
d AS (SELECT year, area, (sum((after_cls=3)::INT)-sum((cls=3)::INT))::BIGINT AS cc, (sum((after_cls=2)::INT)-sum((cls=2)::INT))::BIGINT AS fc FROM n GROUP BY ALL)""", """
SELECT year, area, cc AS crop_change, fc AS forest_change, round(cc + 10.0::DOUBLE*coalesce(coh,0) - 0.5::DOUBLE*greatest(0,-fc), 6) AS score FROM d LEFT JOIN p USING (year, area)"""))
def d37(spark, sf):
    v = B.vecs(spark, sf)
    nxt = v.select("area", "row", "col", (F.col("year") - 1).alias("year"), F.col("cls").alias("_n"))
    c = v.join(nxt, ["area", "row", "col", "year"], "left").withColumn("after_cls", F.coalesce("_n", "cls"))
    coh = H.coherence(v, ["year", "area"], "cls", 3, "z")
    s = P.plan_score(c, ["year", "area"], "cls", "after_cls", coh, 3, 2, 1.0, 10.0, 0.5)
    return r6(s, "score").select("year", "area", "crop_change", "forest_change", "score")
