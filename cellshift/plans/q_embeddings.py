"""Embedding queries over the vector view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import allocation as A
from ..operators import embeddings as E
from ..operators import inference as I
from ..operators import learning as L
from ..operators.cells import consecutive_years
from . import bindings as B
from .registry import query, sql

AREA = ["area"]
UNIT = ["year", "area", "row", "col"]


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def pairs(spark, sf):
    return consecutive_years(B.vecs(spark, sf), AREA, ["z"])


def forecasts(spark, sf):
    """Stand-in forecast for each next year: the mean of the two known years."""
    mid = F.zip_with("z", "next_z", lambda a, b: (a.cast("double") + b.cast("double")) / 2.0)
    return pairs(spark, sf).select("area", F.col("next_year").alias("year"), "row", "col", mid.alias("f"))


_PAIR = """
yp AS (SELECT a.area, a.row, a.col, a.year, b.year AS next_year, a.z, b.z AS nz, [(x[1]+x[2])/2.0 for x in list_zip(a.z, b.z)] AS f
 FROM vecs a JOIN vecs b ON a.area=b.area AND a.row=b.row AND a.col=b.col AND b.year=a.year+1)"""
_COS = "list_cosine_similarity"


@query("v01_mean_cosine", sql("vecs", _PAIR, f"SELECT area, year, round(avg({_COS}(z, nz)), 6) AS mean_cosine, count(*) AS n FROM yp GROUP BY ALL"))
def v01(spark, sf):
    return r6(E.mean_cosine(pairs(spark, sf), ["area", "year"], "z", "next_z"), "mean_cosine")


@query("v02_unit_vectors", sql("vecs", """
SELECT year, area, row, col, round(z[1]/greatest(sqrt(list_inner_product(z, z)), 1e-6), 6) AS first, round(z[64]/greatest(sqrt(list_inner_product(z, z)), 1e-6), 6) AS last FROM vecs"""))
def v02(spark, sf):
    u = B.vecs(spark, sf).withColumn("u", V.unit("z"))
    return u.select(*UNIT, F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


_DIST = {
    "cosine": "1.0 - list_inner_product(z, nz)/((sqrt(list_inner_product(z,z))+1e-8)*(sqrt(list_inner_product(nz,nz))+1e-8))",
    "euclidean": "list_distance(z, nz)",
    "manhattan": "list_sum([abs(x[1]-x[2]) for x in list_zip(z, nz)])",
}


@query("v03_distance_profile", sql("vecs", _PAIR, "d AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, area, year, {e} AS d FROM yp" for m, e in _DIST.items()) + ")", """
SELECT metric, area, year, round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(stddev_pop(d), 6) AS std, round(quantile_cont(d, 0.95), 6) AS p95,
 round(quantile_cont(d, 0.5), 6) AS p50 FROM d GROUP BY ALL"""))
def v03(spark, sf):
    out = None
    for m in _DIST:
        d = E.distance_profile(pairs(spark, sf), ["area", "year"], "z", "next_z", m).withColumn("metric", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return r6(out, "mean", "max", "std", "p95", "p50")


@query("v04_hotspots", sql("vecs", _PAIR, f"d AS (SELECT area, year, {_DIST['euclidean']} AS d FROM yp)", """
t AS (SELECT area, year, quantile_cont(d, 0.9) AS t FROM d GROUP BY ALL)""", """
SELECT area, year, sum((d>=t)::INT)::BIGINT AS hotspot_count, round(100.0*sum((d>=t)::INT)/count(*), 2) AS hotspot_pct FROM d JOIN t USING (area, year) GROUP BY ALL"""))
def v04(spark, sf):
    return E.hotspots(pairs(spark, sf), ["area", "year"], "z", "next_z", "euclidean")


@query("v05_change_pressure", sql("vecs", _PAIR, "d AS (SELECT area, year, row, col, list_distance(z, nz) AS p FROM yp)", """
SELECT area, year, row, col, round(CASE WHEN max(p) OVER w > 0 THEN p/max(p) OVER w ELSE 0 END, 6) AS pressure FROM d WINDOW w AS (PARTITION BY area, year)"""))
def v05(spark, sf):
    c = A.change_pressure(pairs(spark, sf), ["area", "year"], "z", "next_z")
    return r6(c, "pressure").select("area", "year", "row", "col", "pressure")


_PROTO = """
u AS (SELECT area, cls, [x/greatest(sqrt(list_inner_product(z,z)),1e-6) for x in z] AS u FROM vecs),
pm AS (SELECT area, cls, i, avg(u[i]) AS m FROM u, (SELECT unnest(range(1,65)) AS i) GROUP BY ALL),
pk AS (SELECT area, cls, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 20),
pv AS (SELECT area, cls, list(m ORDER BY i) AS m FROM pm JOIN pk USING (area, cls) GROUP BY ALL),
proto AS (SELECT area, cls, [x/greatest(sqrt(list_inner_product(m,m)),1e-6) for x in m] AS prototype FROM pv)"""


def protos(spark, sf):
    return E.prototypes(B.vecs(spark, sf), AREA, "cls", "z", 20)


@query("v06_prototypes", sql("vecs", _PROTO, """
SELECT area, cls, n, i::INT AS dim, round(prototype[i+1], 6) AS value FROM proto JOIN pk USING (area, cls), (SELECT unnest(range(0,64)) AS i)"""))
def v06(spark, sf):
    return r6(protos(spark, sf).select("area", "cls", "n", F.posexplode("prototype").alias("dim", "value")), "value")


def with_probs(spark, sf):
    """Vectors with a deterministic ten-class probability array."""
    items = [F.struct(F.lit(c).alias("cls"), (((F.col("row") * 3 + F.col("col") * 7 + F.col("cls") + c * 5) % 13 + 1) / 100.0).alias("p"))
             for c in range(10)]
    return B.vecs(spark, sf).withColumn("probs", F.array(*items))


@query("v07_semantic_decode", sql("vecs", _PROTO, """
pp AS (SELECT year, area, row, col, z, c AS cls, ((row*3 + col*7 + cls + c*5) % 13 + 1)/100.0 AS p FROM vecs, (SELECT unnest(range(0,10)) AS c)),
s AS (SELECT pp.*, ln(greatest(p, 1e-8)) + 24.0*coalesce(list_inner_product([x/greatest(sqrt(list_inner_product(z,z)),1e-6) for x in z], prototype), 0.0) AS s
 FROM pp LEFT JOIN proto ON proto.area=pp.area AND proto.cls=pp.cls)""", """
SELECT year, area, row, col, first(cls ORDER BY s DESC, cls)::INT AS local_cls, first(cls ORDER BY p DESC, cls)::INT AS global_cls FROM s GROUP BY ALL"""))
def v07(spark, sf):
    d = E.semantic_decode(with_probs(spark, sf), AREA, "probs", "z", protos(spark, sf))
    return d.select(*UNIT, "local_cls", "global_cls")


@query("v08_encoder_persistence", sql("vecs", _PAIR, f"m AS (SELECT area, year, avg({_COS}(z, nz)) AS m FROM yp GROUP BY ALL)",
       "SELECT area, count(*) AS n, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0.0), 6) AS std FROM m GROUP BY area"))
def v08(spark, sf):
    p = E.encoder_persistence(B.vecs(spark, sf), AREA, "z")
    return r6(E.encoder_table(p, AREA), "mean", "std")


_ADV = f"""
d AS (SELECT area, year, {_COS}(z, nz) AS p, {_COS}(f, nz) AS m FROM yp)"""
_ADVSEL = """round(avg(p), 6) AS persistence, round(avg(m), 6) AS model, round(avg(m)-avg(p), 6) AS advantage, round(avg(p) FILTER (p<t), 6) AS changed_persistence,
 round(avg(m) FILTER (p<t), 6) AS changed_model, round(avg(m-p) FILTER (p<t), 6) AS changed_advantage"""
ADV = ("persistence", "model", "advantage", "changed_persistence", "changed_model", "changed_advantage")


def triples(spark, sf):
    f = forecasts(spark, sf).withColumnRenamed("year", "next_year")
    return pairs(spark, sf).join(f, ["area", "row", "col", "next_year"])


@query("v09_forecast_advantage", sql("vecs", _PAIR, _ADV, "t AS (SELECT area, year, quantile_cont(p, 0.1) AS t FROM d GROUP BY ALL)",
       f"SELECT area, year, {_ADVSEL} FROM d JOIN t USING (area, year) GROUP BY ALL"))
def v09(spark, sf):
    return r6(E.forecast_advantage(triples(spark, sf), ["area", "year"], "z", "next_z", "f"), *ADV)


@query("v10_multistep", sql("vecs", _PAIR, f"""
SELECT area, next_year - (SELECT min(year) FROM vecs) AS step, round(avg({_COS}(z, nz)), 6) AS persistence, round(avg({_COS}(f, nz)), 6) AS model,
 round(avg({_COS}(f, nz)) - avg({_COS}(z, nz)), 6) AS advantage FROM yp GROUP BY ALL"""))
def v10(spark, sf):
    m = E.multistep(B.vecs(spark, sf), forecasts(spark, sf), AREA, "z", "f")
    return r6(m, "persistence", "model", "advantage")


@query("v11_decay", sql("vecs", f"""
s AS (SELECT b.area, b.year - a.year AS step, {_COS}(a.z, b.z) AS s FROM vecs a JOIN vecs b ON a.area=b.area AND a.row=b.row AND a.col=b.col AND a.year=0 AND b.year>0)""", """
SELECT area, step, count(*) AS n, round(avg(s), 6) AS mean_cosine, round(avg((s<0.1)::INT), 6) AS changed_share, round(avg(s) FILTER (s<0.1), 6) AS changed_mean,
 round(avg(s) FILTER (s>=0.1), 6) AS stable_mean FROM s GROUP BY ALL"""))
def v11(spark, sf):
    return r6(E.decay(B.vecs(spark, sf), AREA, "z", 0.1), "mean_cosine", "changed_share", "changed_mean", "stable_mean")


@query("v12_region_partition")
def v12(spark, sf):
    cells, _ = L.region_partition(B.vecs(spark, sf), "z", 5)
    return cells.groupBy("region").agg(F.count("*").alias("n"))


def centres(spark, sf):
    """Mean vector per class as region centres, plus one region nothing is near to."""
    c = E.mean_vector(B.vecs(spark, sf), ["cls"], F.col("z")).select(F.col("cls").alias("region"), F.col("mean_vec").alias("centre"))
    return c


_CENT = """
cm AS (SELECT cls AS region, i, avg(z[i]) AS m FROM vecs, (SELECT unnest(range(1,65)) AS i) GROUP BY ALL),
ce AS (SELECT region, list(m ORDER BY i) AS centre FROM cm GROUP BY region),
si AS (SELECT year, area, row, col, vecs.cls, z, region, list_cosine_similarity(z, centre) AS s FROM vecs, ce),
asg AS (SELECT year, area, row, col, cls, z, region FROM (SELECT *, row_number() OVER (PARTITION BY year, area, row, col ORDER BY s DESC, region) AS r FROM si) WHERE r=1)"""


@query("v13_nearest_centre", sql("vecs", _CENT, "SELECT year, area, row, col, region FROM asg"))
def v13(spark, sf):
    return E.nearest_centre(B.vecs(spark, sf), centres(spark, sf), "z").select(*UNIT, "region")


@query("v13_region_stats", sql("vecs", _CENT, """
k AS (SELECT r.region, count(asg.region) AS n FROM (SELECT unnest(range(0,12)) AS region) r LEFT JOIN asg ON asg.region=r.region GROUP BY r.region)""", """
SELECT count(*) AS n_regions, sum(n)::BIGINT AS n_units, round(avg(n), 6) AS mean_units, round(stddev_pop(n), 6) AS std_units, min(n) AS min_units, max(n) AS max_units,
 sum((n=0)::INT)::BIGINT AS empty_regions FROM k"""))
def v13b(spark, sf):
    a = E.nearest_centre(B.vecs(spark, sf), centres(spark, sf), "z")
    regions = spark.range(12).selectExpr("cast(id as int) as region")
    return r6(E.region_stats(E.region_sizes(a, regions)), "mean_units", "std_units")


@query("v14_best_units", sql("vecs", "steps", _CENT, """
un AS (SELECT region, year*100 + area*50 + row*10 + col AS unit, z[1] AS gain, z[2] AS forest, round(sqrt(list_inner_product(z,z)), 4) AS norm FROM asg),
ac AS (SELECT episode, t, action % 12 AS region, (t % 4) AS scenario FROM steps)""", """
SELECT episode, t, ac.region::INT AS region, scenario, coalesce((SELECT first(unit ORDER BY CASE scenario WHEN 1 THEN forest WHEN 2 THEN gain ELSE norm END DESC, unit)
 FROM un WHERE un.region=ac.region), 0)::INT AS unit FROM ac"""))
def v14(spark, sf):
    a = E.nearest_centre(B.vecs(spark, sf), centres(spark, sf), "z")
    u = a.select("region", (F.col("year") * 100 + F.col("area") * 50 + F.col("row") * 10 + F.col("col")).alias("unit"),
                 F.col("z")[0].cast("double").alias("gain"), F.col("z")[1].cast("double").alias("forest"),
                 F.round(V.norm("z"), 4).alias("norm"))
    best = E.best_units(u, {1: "forest", 2: "gain"}, "norm")
    acts = B.steps(spark, sf).selectExpr("episode", "cast(t as bigint) as t", "cast(action % 12 as int) as region", "cast(t % 4 as bigint) as scenario")
    return E.translate_actions(acts, best, [1, 2]).select("episode", "t", "region", "scenario", "unit")


@query("v15_area_sample", sql("grid", """
SELECT area, row, col FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY md5('5|' || area || '|' || row || '|' || col), row, col) AS r FROM grid WHERE end_cls>0) WHERE r <= 800"""))
def v15(spark, sf):
    return E.area_sample(B.grid(spark, sf).filter("end_cls > 0"), AREA, 800, 5).select("area", "row", "col")


@query("v16_decoder_cv")
def v16(spark, sf):
    cv = L.decoder_cv(B.vecs(spark, sf), UNIT, "z", "cls")
    return cv.select("fold", "n_test", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query("v16_by_year")
def v16b(spark, sf):
    v = E.area_sample(B.vecs(spark, sf), ["year", "area"], 800, 5)
    cv = L.decoder_by_year(v, UNIT, "z", "cls")
    return cv.select("year", F.round("cv_accuracy", 4).alias("cv_accuracy"), F.round("cv_macro_f1", 4).alias("cv_macro_f1"))


@query("v17_decode")
def v17(spark, sf):
    model = L.fit_decoder(B.vecs(spark, sf), "z", "cls")
    return L.decode(model, B.vecs(spark, sf), "z").select(*UNIT, "cls", "decoded_cls")


@query("v18_stratified_split", sql("vecs", """
k AS (SELECT cls, count(*) AS n FROM vecs GROUP BY cls HAVING count(*) >= 2),
r AS (SELECT v.*, n, row_number() OVER (PARTITION BY v.cls ORDER BY md5('3|' || year || '|' || area || '|' || row || '|' || col), year, area, row, col) AS rk FROM vecs v JOIN k USING (cls))""",
 "SELECT year, area, row, col, cls, rk <= round_even(n*0.7::DOUBLE, 0) AS is_train FROM r"))
def v18(spark, sf):
    return E.stratified_split(B.vecs(spark, sf), "cls", UNIT, 0.7, 3).select(*UNIT, "cls", "is_train")


@query("v19_region_embedding", sql("vecs", _CENT, """
m AS (SELECT region, i, avg(z[i+1]) AS v FROM asg, (SELECT unnest(range(0,64)) AS i) GROUP BY ALL)""", """
SELECT q.region::INT AS region, q.i::INT AS dim, round(coalesce(v, 0.0), 6) AS value
FROM (SELECT region, i FROM (SELECT unnest(range(0,12)) AS region), (SELECT unnest(range(0,64)) AS i)) q LEFT JOIN m ON m.region=q.region AND m.i=q.i"""))
def v19(spark, sf):
    a = E.nearest_centre(B.vecs(spark, sf), centres(spark, sf), "z")
    regions = spark.range(12).selectExpr("cast(id as int) as region")
    e = E.region_embedding(a, regions, "z", 64)
    return r6(e.select("region", F.posexplode("mean_vec").alias("dim", "value")), "value")


@query("v20_last_pair_advantage", sql("vecs", _PAIR, _ADV, "dl AS (SELECT * FROM d WHERE year = (SELECT max(year) FROM yp))",
       "t AS (SELECT area, quantile_cont(p, 0.1) AS t FROM dl GROUP BY ALL)", f"SELECT area, {_ADVSEL} FROM dl JOIN t USING (area) GROUP BY area"))
def v20(spark, sf):
    a = E.last_pair_advantage(B.vecs(spark, sf), forecasts(spark, sf), AREA, "z", "f")
    return r6(a, *ADV)


@query("s11_propensity")
def s11p(spark, sf):
    o = B.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(o_custkey as double) as x1", "o_totalprice as x2",
        "cast(if((o_custkey + o_totalprice / 100) % 7 < 3, 1, 0) as int) as treated")
    p = L.cross_fitted_propensity(o, ["o_orderkey"], ["x1", "x2"], "treated")
    return I.average_effect(I.stratified_effect(p, "treated", "x2", "propensity"))
