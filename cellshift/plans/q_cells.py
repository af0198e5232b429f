"""Cell projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import vectors as V
from ..operators import cells as C
from ..operators import mapmetrics as M
from . import bindings as B
from .q_catalog import _BOXD, _SIZE, boxes
from .registry import query, sql

AREA = ["area"]


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_REGN = "CASE area_id % 6 WHEN 0 THEN 'bishan' WHEN 1 THEN 'Hetao' ELSE lower(area) END"


@query("b01_tier", sql("areas", f"""
SELECT area_id, CASE WHEN area_id % 6 IN (0,1) THEN 'tier2' WHEN contact_status='none' THEN 'tier1'
 WHEN contact_status='known_contact' THEN 'tier2' ELSE 'review_required' END AS tier FROM areas"""))
def b01(spark, sf):
    name = F.expr("case area_id % 6 when 0 then 'bishan' when 1 then 'Hetao' else lower(area) end")
    return B.areas(spark, sf).select("area_id", C.tier(name, F.col("contact_status")).alias("tier"))


@query("b02_stratum", sql("areas", """
SELECT area_id, CASE nation WHEN 'NATION_1' THEN 'Urban' WHEN 'NATION_2' THEN 'Forest' ELSE 'Unknown' END AS stratum FROM areas"""))
def b02(spark, sf):
    m = {"nation_1": "Urban", "nation_2": "Forest"}
    return B.areas(spark, sf).select("area_id", C.stratum(F.col("nation"), m).alias("stratum"))


@query("b03_qc_status", sql("triple", """
p AS (SELECT area, count(start_cls) AS ns, count(end_cls) AS ne, count(pred_cls) AS np,
 sum((start_cls<>end_cls)::INT) AS ch, count(DISTINCT pred_cls) AS k FROM triple GROUP BY area)""", """
SELECT area, r AS excluded_reason, CASE r WHEN '' THEN 'include' WHEN 'zero_reference_change' THEN 'negative_control' ELSE 'exclude' END AS qc_status
FROM (SELECT area, CASE WHEN ns=0 OR ne=0 THEN 'missing_label' WHEN ns<>ne THEN 'label_shape_mismatch'
 WHEN ns<>np THEN 'label_prediction_shape_mismatch' WHEN ch=0 THEN 'zero_reference_change' WHEN k=1 THEN 'class_collapse'
 WHEN area=3 THEN 'missing_embedding' ELSE '' END AS r FROM p)"""))
def b03(spark, sf):
    p = C.pair_profile(B.triple(spark, sf), AREA)
    return C.qc_status(p, F.col("area") != 3).select("area", "excluded_reason", "qc_status")


@query("b04_provenance_audit", sql("areas", """
reg AS (SELECT area, CASE WHEN area_id % 10 = 7 THEN 'tier1' ELSE tier END AS tier, contact_status AS s,
 CASE WHEN area_id % 12 = 0 THEN ' ' ELSE 'survey' END AS e FROM areas)""", """
SELECT tier, CASE WHEN tier='tier1' AND s<>'none' THEN 'invalid_tier1_contact' WHEN tier='tier1' AND trim(e)='' THEN 'invalid_tier1_missing_evidence'
 WHEN tier='review_required' THEN 'review_required' ELSE 'ok' END AS audit_status, count(*) AS n FROM reg GROUP BY ALL"""))
def b04(spark, sf):
    reg = B.areas(spark, sf).selectExpr(
        "if(area_id % 10 = 7, 'tier1', tier) as tier", "contact_status", "if(area_id % 12 = 0, ' ', 'survey') as ev")
    st = C.provenance_status(F.col("tier"), F.col("contact_status"), F.col("ev"))
    return reg.groupBy("tier", st.alias("audit_status")).agg(F.count("*").alias("n"))


@query("b05_valid_mask", sql("grid", """
SELECT area, sum((start_cls<>0 AND pred_cls<>0 AND end_cls<>0)::INT)::BIGINT AS n_valid3,
 sum((start_cls<>0 AND pred_cls<>0)::INT)::BIGINT AS n_valid2 FROM grid GROUP BY area"""))
def b05(spark, sf):
    g = B.grid(spark, sf)
    return g.groupBy("area").agg(
        K.n_if(K.valid_cell("start_cls", "pred_cls", "end_cls")).alias("n_valid3"),
        K.n_if(K.valid_cell("start_cls", "pred_cls")).alias("n_valid2"))


@query("b06_merge_classes", sql("grid", """
SELECT area, (CASE start_cls WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 7 ELSE 0 END)::INT AS merged, count(*) AS n FROM grid GROUP BY ALL"""))
def b06(spark, sf):
    m = C.merge_classes(F.col("start_cls"), {1: 1, 2: 2, 3: 2, 4: 7})
    return B.grid(spark, sf).groupBy("area", m.alias("merged")).agg(F.count("*").alias("n"))


@query("b07_encode_classes", sql("grid", """
d AS (SELECT cls, dense_rank() OVER (ORDER BY cls) AS code FROM (SELECT DISTINCT start_cls AS cls FROM grid WHERE start_cls<>2))""", """
SELECT area, row, col, code::INT AS code FROM grid LEFT JOIN d ON cls = end_cls"""))
def b07(spark, sf):
    g = B.grid(spark, sf)
    dim = C.class_dimension(g.filter("start_cls <> 2"), "start_cls")
    return C.encode_classes(g, dim, "end_cls").select("area", "row", "col", "code")


@query("b08_parcel_class", sql("parcels", """
SELECT parcel_id, CASE WHEN dlbm LIKE '011%' OR dlbm LIKE '012%' OR dlbm LIKE '013%' THEN 'farmland'
 WHEN dlbm LIKE '031%' OR dlbm LIKE '032%' OR dlbm LIKE '033%' THEN 'forest' WHEN substr(dlbm,1,2) IN ('10','11','20') THEN 'barrier'
 ELSE 'other' END AS kind, CASE substr(dlbm,1,3) WHEN '011' THEN 'Farmland' WHEN '031' THEN 'Forest' ELSE 'Other' END AS exact_kind FROM parcels"""))
def b08(spark, sf):
    exact = C.exact_code_class(F.substring("dlbm", 1, 3), {"Farmland": ["011"], "Forest": ["031"]}, "Other")
    return B.parcels(spark, sf).select(
        "parcel_id", C.parcel_class(F.col("dlbm")).alias("kind"), exact.alias("exact_kind"))


@query("b09_change_type", sql("parcels", """
k AS (SELECT parcel_id, CASE WHEN dlbm LIKE '01%' THEN 'farmland' WHEN dlbm LIKE '03%' THEN 'forest' ELSE 'barrier' END AS a,
 CASE WHEN slope > 25 THEN 'forest' ELSE 'farmland' END AS b FROM parcels)""", """
SELECT (CASE WHEN a='farmland' AND b='forest' THEN 1 WHEN a='forest' AND b='farmland' THEN 2 ELSE 0 END)::INT AS change_type, count(*) AS n FROM k GROUP BY ALL"""))
def b09(spark, sf):
    p = B.parcels(spark, sf)
    ct = C.change_type(C.parcel_class(F.col("dlbm")), F.when(F.col("slope") > 25, "forest").otherwise("farmland"))
    return p.groupBy(ct.alias("change_type")).agg(F.count("*").alias("n"))


@query("b10_change_error_map", sql("grid", """
SELECT area, row, col, CASE WHEN end_cls<>start_cls AND pred_cls<>start_cls THEN 'hit' WHEN end_cls<>start_cls THEN 'miss'
 WHEN pred_cls<>start_cls THEN 'false_alarm' ELSE 'correct_rejection' END AS code FROM grid"""))
def b10(spark, sf):
    c = K.change_code(F.col("start_cls"), F.col("end_cls"), F.col("pred_cls"))
    return B.grid(spark, sf).select("area", "row", "col", c.alias("code"))


@query("b11_transition_summary", sql("grid", """
c AS (SELECT area, end_cls AS cls, count(*) AS n FROM grid WHERE start_cls<>end_cls GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, cls) AS r FROM c)""", """
SELECT area, string_agg(cls || ':' || n, ';' ORDER BY n DESC, cls) AS summary FROM r WHERE r <= 4 GROUP BY area"""))
def b11(spark, sf):
    c = B.grid(spark, sf).filter("start_cls <> end_cls").groupBy("area", F.col("end_cls").alias("cls")).agg(
        F.count("*").alias("n"))
    return M.class_count_summary(c, AREA, 4, "summary")


@query("b12_bbox_grid_size", sql(_BOXD, f"""
SELECT record_index, width_px, height_px, CASE WHEN width_px*height_px < 10000 THEN 'small' WHEN width_px*height_px < 40000 THEN 'medium' ELSE 'large' END AS size_class,
 round(clon, 6) AS center_lon, round(clat, 6) AS center_lat
FROM (SELECT record_index, (xmin+xmax)/2.0 AS clon, (ymin+ymax)/2.0 AS clat, {_SIZE} FROM bx)"""))
def b12(spark, sf):
    w, h = C.bbox_grid_size(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 100)
    b = boxes(spark, sf).withColumns({"width_px": w, "height_px": h})
    return b.select(
        "record_index", "width_px", "height_px", C.size_class(w * h).alias("size_class"),
        F.round((F.col("xmin") + F.col("xmax")) / 2.0, 6).alias("center_lon"),
        F.round((F.col("ymin") + F.col("ymax")) / 2.0, 6).alias("center_lat"))


_PROVINCES = sorted(p for names in C.MACRO_REGIONS.values() for p in names) + ["Atlantis"]


@query("b12_macro_region", sql("areas", "p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PROVINCES) + f"]) AS province, unnest(range({len(_PROVINCES)})) AS i)",
       "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{r}')" for r, ps in C.MACRO_REGIONS.items() for p in ps) + ") x(province, region))", f"""
SELECT area, province, coalesce(region, '{C.NO_REGION}') AS region FROM areas JOIN p ON i = area_id % {len(_PROVINCES)} LEFT JOIN r USING (province)"""))
def b12b(spark, sf):
    a = B.areas(spark, sf).withColumn("province", F.get(F.array(*map(F.lit, _PROVINCES)), (F.col("area_id") % len(_PROVINCES)).cast("int")))
    return a.select("area", "province", C.macro_region(F.col("province")).alias("region"))


BBOX = (100.0, 30.0, 104.0, 40.0)
SUB = (101.03, 33.2, 102.57, 37.45)


@query("b13_sub_bbox", sql("grid", """
e AS (SELECT area, max(row)+1 AS h, max(col)+1 AS w FROM grid GROUP BY area)""", """
SELECT area, row, col FROM grid JOIN e USING (area)
WHERE row >= greatest(0, floor((40.0-37.45)::DOUBLE/(10.0::DOUBLE/h))) AND row < least(h, ceil((40.0-33.2)::DOUBLE/(10.0::DOUBLE/h)))
 AND col >= greatest(0, floor((101.03-100.0)::DOUBLE/(4.0::DOUBLE/w))) AND col < least(w, ceil((102.57-100.0)::DOUBLE/(4.0::DOUBLE/w)))"""))
def b13(spark, sf):
    from ..operators.neighbourhood import extents

    g = B.grid(spark, sf)
    g = C.join_small(g, extents(g, AREA), AREA)
    return g.filter(C.in_sub_bbox(BBOX, SUB, F.col("height"), F.col("width"))).select("area", "row", "col")


@query("b14_cell_rectangles", sql("grid", """
e AS (SELECT area, max(row)+1 AS h, max(col)+1 AS w FROM grid GROUP BY area)""", """
SELECT area, row, col, round(100.0::DOUBLE + col*(4.0::DOUBLE/w), 6) AS x0, round((40.0::DOUBLE - row*(10.0::DOUBLE/h)) - 10.0::DOUBLE/h, 6) AS y0,
 round((100.0::DOUBLE + col*(4.0::DOUBLE/w)) + 4.0::DOUBLE/w, 6) AS x1, round(40.0::DOUBLE - row*(10.0::DOUBLE/h), 6) AS y1 FROM grid JOIN e USING (area)"""))
def b14(spark, sf):
    from ..operators.neighbourhood import extents

    g = B.grid(spark, sf)
    g = C.join_small(g, extents(g, AREA), AREA)
    out = C.cell_rectangles(g, BBOX, F.col("height"), F.col("width"))
    return out.select("area", "row", "col", "x0", "y0", "x1", "y1")


@query("b14_class_features", sql("grid", """
t AS (SELECT area, end_cls, row//64 AS tile_row, col//64 AS tile_col, count(*) AS n_polygons FROM grid GROUP BY ALL),
c AS (SELECT area, end_cls, count(*) AS pixel_count, round(100.0::DOUBLE*count(*)/sum(count(*)) OVER (PARTITION BY area), 2) AS percentage FROM grid GROUP BY area, end_cls)""", """
SELECT area, end_cls, tile_row::BIGINT AS tile_row, tile_col::BIGINT AS tile_col, n_polygons, pixel_count, percentage FROM t JOIN c USING (area, end_cls)"""))
def b14b(spark, sf):
    from ..operators.neighbourhood import extents

    g = B.grid(spark, sf)
    g = C.join_small(g, extents(g, AREA), AREA)
    f = C.class_features(C.cell_rectangles(g, BBOX, F.col("height"), F.col("width")), AREA, "end_cls")
    polys = F.size(F.from_json("geometry", "type string, coordinates array<array<array<array<double>>>>")["coordinates"])
    return f.select("area", "end_cls", "tile_row", "tile_col", polys.cast("bigint").alias("n_polygons"),
                    "pixel_count", "percentage")


@query("b15_class_name_match", sql("grid", """
cl AS (SELECT * FROM (VALUES (1,'water'),(2,'trees'),(4,'grass'),(5,'shrub and scrub'),(7,'crops'),(8,'built')) x(cls, cls_name)),
q AS (SELECT DISTINCT CASE (start_cls*6+end_cls) % 7 WHEN 0 THEN 'water' WHEN 1 THEN 'shrub' WHEN 2 THEN 'built-up area' WHEN 3 THEN 'rocks'
 WHEN 4 THEN 'grass' WHEN 5 THEN 'crop' ELSE 's' END AS query FROM grid)""", """
SELECT query, (SELECT min(CASE WHEN cls_name=query THEN 0 ELSE 1000 END + cls) % 1000 FROM cl
 WHERE cls_name=query OR contains(cls_name, query) OR contains(query, cls_name))::INT AS cls FROM q"""))
def b15(spark, sf):
    q = B.grid(spark, sf).selectExpr(
        "case (start_cls*6+end_cls) % 7 when 0 then 'water' when 1 then 'shrub' when 2 then 'built-up area' when 3 then 'rocks'"
        " when 4 then 'grass' when 5 then 'crop' else 's' end as query")
    cl = spark.createDataFrame(
        [(1, "water"), (2, "trees"), (4, "grass"), (5, "shrub and scrub"), (7, "crops"), (8, "built")],
        "cls int, cls_name string")
    return C.match_class_names(q, cl)


@query("b16_one_hot_probability", sql("grid", """
SELECT area, row, col, p_cls::INT AS p_cls, (CASE WHEN p_cls=pred_cls THEN 0.95 ELSE 0.01 END)::DOUBLE AS p
FROM grid, (SELECT unnest([1,2,3,4,5]) AS p_cls)"""))
def b16(spark, sf):
    return C.one_hot_probability(B.grid(spark, sf), "pred_cls", (1, 2, 3, 4, 5)).select(
        "area", "row", "col", "p_cls", "p")


@query("b17_probability_lookup", sql("grid", """
SELECT area, row, col, (CASE pred_cls WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0 END)::DOUBLE AS p_pred,
 (CASE start_cls WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0 END)::DOUBLE AS p_start FROM grid"""))
def b17(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in {1: 0.5, 2: 0.3, 3: 0.2}.items() for x in kv])
    g = B.grid(spark, sf).withColumn("probs", m)
    return g.select("area", "row", "col", C.class_probability("probs", "pred_cls").alias("p_pred"),
                    C.class_probability("probs", "start_cls").alias("p_start"))


@query("b18_band_regroup", sql("""
b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount*5 AS a, l_tax*6 AS b, l_discount*7 AS c, l_quantity/60.0 AS d, (l_partkey%10)/12.0 AS e FROM lineitem),
p AS (SELECT *, [a, e, least(1.0, b + c), d] AS p FROM b)""", """
SELECT list_position(p, list_max(p))::INT AS label, count(*) AS n, sum(round(p[3]*10000)::INT)::BIGINT AS total FROM p GROUP BY label"""))
def b18(spark, sf):
    b = B.table(spark, sf, "lineitem").selectExpr(
        "l_discount*5 as a", "l_tax*6 as b", "l_discount*7 as c", "l_quantity/60.0D as d", "(l_partkey%10)/12.0D as e")
    p = b.select(C.grouped_bands([["a"], ["e"], ["b", "c"], ["d"]]).alias("p"))
    return p.select(C.argmax_label(F.col("p")).alias("label"), C.scaled_probability(F.col("p"))[2].alias("s")).groupBy(
        "label").agg(F.count("*").alias("n"), F.sum("s").alias("total"))


@query("b19_normalise_context", sql("grid", """
l AS (SELECT area, min(score) FILTER (start_cls<>0) AS lo, max(score) FILTER (start_cls<>0) AS hi FROM grid GROUP BY area)""", """
SELECT area, row, col, round((score-lo)/(hi-lo), 6) AS elevation_norm, round(least(1.0, greatest(0.0, (row%60)/45.0))::DOUBLE, 6) AS slope_norm
FROM grid JOIN l USING (area)"""))
def b19(spark, sf):
    g = B.grid(spark, sf).withColumn("slope", F.col("row") % 60)
    n = C.normalise_context(g, AREA, "score", "slope", F.col("start_cls") != 0)
    return r6(n, "elevation_norm", "slope_norm").select("area", "row", "col", "elevation_norm", "slope_norm")


@query("b20_finite_values", sql("metric_rows", """
t AS (SELECT method, CASE WHEN row_id%11=0 THEN 'nan' WHEN row_id%11=1 THEN 'inf' WHEN row_id%11=2 THEN 'n/a' WHEN row_id%11=3 THEN NULL
 ELSE value::VARCHAR END AS txt FROM metric_rows),
d AS (SELECT method, try_cast(txt AS DOUBLE) AS v FROM t)""", """
SELECT method, count(*) AS n_rows, sum((v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))::INT)::BIGINT AS n_finite,
 round(avg(v) FILTER (v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)), 6) AS mean_finite FROM d GROUP BY method"""))
def b20(spark, sf):
    t = B.metric_rows(spark, sf).selectExpr(
        "method", "case row_id % 11 when 0 then 'nan' when 1 then 'inf' when 2 then 'n/a' when 3 then null"
        " else cast(value as string) end as txt")
    v = K.finite(F.col("txt"))
    return t.groupBy("method").agg(
        F.count("*").alias("n_rows"), F.count(v).alias("n_finite"), F.round(F.avg(v), 6).alias("mean_finite"))


@query("b23_exclude_terms", sql("areas", """
SELECT nation, count(*) AS n FROM areas WHERE NOT (contains(lower(nation), 'on_1') OR contains(lower(nation), '_2')) GROUP BY nation"""))
def b23(spark, sf):
    a = B.areas(spark, sf)
    return a.filter(~C.exclude_terms(F.col("nation"), ["on_1", "_2"])).groupBy("nation").agg(F.count("*").alias("n"))


@query("b23_whitelist", sql("areas", """
SELECT area, CASE WHEN tier <> 'tier1' THEN 'not_in_whitelist' END AS reason FROM areas"""))
def b23b(spark, sf):
    a = B.areas(spark, sf)
    return C.whitelist_split(a.select("area"), a.filter("tier = 'tier1'"))


@query("b24_context_mode", sql("grid", "SELECT area, round(avg(score), 4) AS elevation FROM grid GROUP BY area"))
def b24(spark, sf):
    g = B.grid(spark, sf).withColumn("elevation", F.col("score")).withColumn("slope", F.col("row"))
    keep = C.context_columns("no_slope", ["elevation", "slope"])
    return g.groupBy("area").agg(*[F.round(F.avg(c), 4).alias(c) for c in keep])


@query("b25_reflectance", sql("""
SELECT l_linenumber, round(avg(least(1.0, greatest(0.0, (l_extendedprice - 9000)/10000.0))), 6) AS mean_reflectance FROM lineitem GROUP BY l_linenumber"""))
def b25(spark, sf):
    r = C.reflectance(F.col("l_extendedprice") - 9000)
    return B.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg(r), 6).alias("mean_reflectance"))


@query("b26_display_rectangles", sql("grid", """
t AS (SELECT area, max(row) AS top FROM grid GROUP BY area)""", """
SELECT area, row, col, round(-82.45::DOUBLE + col*0.0225::DOUBLE, 6) AS min_lng, round(37.0::DOUBLE + (top-row)*0.018::DOUBLE, 6) AS min_lat,
 CASE WHEN pred_cls=1 THEN 'selected' ELSE 'not_selected' END AS selected_label FROM grid JOIN t USING (area)"""))
def b26(spark, sf):
    d = C.display_rectangles(B.grid(spark, sf), AREA, (-82.45, 37.0), (0.0225, 0.018), F.col("pred_cls") == 1)
    return r6(d, "min_lng", "min_lat").select("area", "row", "col", "min_lng", "min_lat", "selected_label")


# ---- joins -----------------------------------------------------------------

def _sides(spark, sf):
    t = B.triple(spark, sf)
    pos = ["area", "row", "col"]
    return [t.filter(f"{c} is not null").select(*pos, F.col(c).alias("cls"))
            for c in ("start_cls", "end_cls", "pred_cls")]


@query("c01_co_register_cells", sql("triple", """
SELECT area, row, col, start_cls, end_cls, pred_cls FROM triple WHERE area NOT IN (5, 6)"""))
def c01(spark, sf):
    return C.co_register(C.align(*_sides(spark, sf), AREA), AREA)[0]


@query("c01_co_register_skips", sql("triple", """
SELECT area, 'shape_mismatch' AS reason, 'start_cls=' || count(start_cls) || ' end_cls=' || count(end_cls) || ' pred_cls=' || count(pred_cls) AS message
FROM triple WHERE area IN (5, 6) GROUP BY area"""))
def c01b(spark, sf):
    return C.co_register(C.align(*_sides(spark, sf), AREA), AREA)[1]


@query("c02_consecutive_years", sql("vecs", """
SELECT a.area, a.row, a.col, a.year, b.year AS next_year, a.cls, b.cls AS next_cls FROM vecs a JOIN vecs b
ON a.area=b.area AND a.row=b.row AND a.col=b.col AND b.year=a.year+1"""))
def c02(spark, sf):
    return C.consecutive_years(B.vecs(spark, sf), AREA, ["cls"])


@query("c03_common_extent", sql("grid", """
b AS (SELECT (area+7)%8 AS area, row, col - 3 AS col, end_cls FROM grid WHERE col >= 3),
e AS (SELECT area, least((SELECT max(row) FROM grid g WHERE g.area=b.area), max(row)) AS h, least((SELECT max(col) FROM grid g WHERE g.area=b.area), max(col)) AS w FROM b GROUP BY area)""", """
SELECT a.area, count(*) AS n_common, sum((a.start_cls=b.end_cls)::INT)::BIGINT AS n_equal FROM grid a JOIN b USING (area, row, col) JOIN e USING (area)
WHERE a.row <= h AND a.col <= w GROUP BY a.area"""))
def c03(spark, sf):
    g = B.grid(spark, sf)
    other = g.filter("col >= 3").select(((F.col("area") + 7) % 8).cast("int").alias("area"), "row", (F.col("col") - 3).alias("col"),
                                        F.col("end_cls").alias("o"))
    a, b = C.common_extent(g, other, ["area"])
    j = a.join(b, ["area", "row", "col"])
    return j.groupBy("area").agg(F.count("*").alias("n_common"), K.n_if(F.col("start_cls") == F.col("o")).alias("n_equal"))


_SHAPE = "CASE WHEN area IN (1, 4) THEN 'small' ELSE 'large' END"


@query("c04_leave_one_area_out", sql("grid", f"""
k AS (SELECT {_SHAPE} AS shape, area, start_cls AS from_cls, end_cls AS to_cls, count(*) AS n FROM grid GROUP BY ALL),
a AS (SELECT DISTINCT shape, area FROM k)""", """
SELECT a.shape, a.area, k.from_cls, k.to_cls, sum(k.n)::BIGINT AS n FROM a JOIN k ON k.shape=a.shape AND k.area<>a.area GROUP BY ALL"""))
def c04(spark, sf):
    g = B.grid(spark, sf).withColumn("shape", F.expr("if(area in (1, 4), 'small', 'large')"))
    k = g.groupBy("shape", "area", F.col("start_cls").alias("from_cls"), F.col("end_cls").alias("to_cls")).agg(
        F.count("*").alias("n"))
    return C.leave_one_area_out(k, ["shape"], "area", ["from_cls", "to_cls"])


@query("c05_leave_one_pair_out", sql("vecs", """
p AS (SELECT a.area || '_' || a.year AS pair, a.cls AS from_cls, b.cls AS to_cls, count(*) AS n FROM vecs a JOIN vecs b
 ON a.area=b.area AND a.row=b.row AND a.col=b.col AND b.year=a.year+1 GROUP BY ALL),
a AS (SELECT DISTINCT pair FROM p)""", """
SELECT a.pair, p.from_cls, p.to_cls, sum(p.n)::BIGINT AS n FROM a JOIN p ON p.pair<>a.pair GROUP BY ALL"""))
def c05(spark, sf):
    y = C.consecutive_years(B.vecs(spark, sf), AREA, ["cls"])
    k = y.groupBy(F.concat_ws("_", "area", "year").alias("pair"), F.col("cls").alias("from_cls"),
                  F.col("next_cls").alias("to_cls")).agg(F.count("*").alias("n"))
    return C.leave_one_area_out(k, [], "pair", ["from_cls", "to_cls"])


@query("c06_pair_methods", sql("metric_rows", """
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, area ORDER BY row_id DESC) AS r FROM metric_rows) WHERE r=1)""", """
SELECT a.area, a.value AS challenger_value, b.value AS baseline_value FROM l a JOIN l b ON a.area=b.area AND a.method='click' AND b.method='error'"""))
def c06(spark, sf):
    return C.pair_methods(B.metric_rows(spark, sf), AREA, "click", "error", ["value"], recency="row_id")


_SEEDED = """
sv AS (SELECT method, seed, area, avg(value) AS value FROM metric_rows GROUP BY ALL)"""


@query("c07_seeded_pairing", sql("metric_rows", _SEEDED, """
SELECT a.seed, a.area, round(a.value, 6) AS challenger_value, round(b.value, 6) AS baseline_value FROM sv a JOIN sv b
ON a.area=b.area AND a.seed=b.seed AND a.method='click' AND b.method='error'"""))
def c07(spark, sf):
    sv = B.metric_rows(spark, sf).groupBy("method", "seed", "area").agg(F.avg("value").alias("value"))
    return r6(C.pair_methods(sv, ["seed", "area"], "click", "error", ["value"]), "challenger_value", "baseline_value")


@query("c08_replicate_over_seeds", sql("metric_rows", _SEEDED, """
ch AS (SELECT area, avg(value) AS value FROM metric_rows WHERE method='click' AND seed=0 GROUP BY area)""", """
SELECT seed, area, 'click' AS method, round(ch.value, 6) AS value FROM (SELECT DISTINCT seed, area FROM sv WHERE method='error') JOIN ch USING (area)
UNION ALL SELECT seed, area, method, round(value, 6) FROM sv WHERE method='error'"""))
def c08(spark, sf):
    m = B.metric_rows(spark, sf)
    ch = m.filter("method = 'click' and seed = 0").groupBy("area", "method").agg(F.avg("value").alias("value"))
    base = m.filter("method = 'error'").groupBy("seed", "area", "method").agg(F.avg("value").alias("value"))
    return r6(C.replicate_over_seeds(ch, base, ["value"]), "value")


@query("c08_missing_areas", sql("metric_rows", """
SELECT DISTINCT area FROM metric_rows WHERE method='error' EXCEPT SELECT area FROM metric_rows WHERE method='click' AND seed=0"""))
def c08b(spark, sf):
    m = B.metric_rows(spark, sf)
    return C.missing_areas(m.filter("method = 'error'"), m.filter("method = 'click' and seed = 0"))


@query("c09_versus_reference", sql("metric_rows", """
w AS (SELECT method, area, avg(value) AS mean_value, max(value) AS max_value FROM metric_rows GROUP BY ALL),
l AS (SELECT method, area, 'mean_value' AS metric, mean_value AS v FROM w UNION ALL SELECT method, area, 'max_value', max_value FROM w)""", """
SELECT a.area, a.method, a.metric, round(a.v, 6) AS value, round(b.v, 6) AS ref_value,
 round(CASE WHEN a.metric='max_value' THEN -1.0 ELSE 1.0 END::DOUBLE * (a.v-b.v), 6) AS advantage,
 (CASE WHEN a.metric='max_value' THEN -1.0 ELSE 1.0 END::DOUBLE * (a.v-b.v)) > 0 AS wins
FROM l a JOIN l b ON a.area=b.area AND a.metric=b.metric AND b.method='error' AND a.method<>'error'"""))
def c09(spark, sf):
    w = B.metric_rows(spark, sf).groupBy("method", "area").agg(
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    v = C.versus_reference(w, AREA, "error", ["mean_value", "max_value"], lower=["max_value"])
    return r6(v, "value", "ref_value", "advantage")


@query("c10_common_areas", sql("metric_rows", """
r AS (SELECT DISTINCT method || seed AS candidate, area FROM metric_rows),
k AS (SELECT count(DISTINCT candidate) AS n FROM r)""", """
SELECT area, count(DISTINCT candidate) AS n_candidates, count(DISTINCT candidate) = any_value(k.n) AS is_common FROM r, k GROUP BY area"""))
def c10(spark, sf):
    r = B.metric_rows(spark, sf).select(F.concat("method", F.col("seed").cast("string")).alias("candidate"), "area").distinct()
    return C.common_areas(r)


@query("c11_advantage_vs_delta", sql("metric_rows", """
a AS (SELECT area, avg(value) AS adv FROM metric_rows WHERE method='click' GROUP BY area),
d AS (SELECT area, avg(value) AS delta FROM metric_rows WHERE method='view' GROUP BY area)""",
 "SELECT area, round(adv, 6) AS advantage, round(delta, 6) AS delta FROM a JOIN d USING (area)"))
def c11(spark, sf):
    m = B.metric_rows(spark, sf)
    a = m.filter("method = 'click'").select("area", F.col("value").alias("advantage"))
    d = m.filter("method = 'view'").select("area", F.col("value").alias("delta"))
    return r6(C.advantage_with_delta(a, d), "advantage", "delta")


@query("c12_neighbour_pairs", sql("vecs", """
SELECT a.year, a.area, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.z, b.z)), 6) AS mean_cosine FROM vecs a JOIN vecs b
ON a.year=b.year AND a.area=b.area AND abs(a.row-b.row) + abs(a.col-b.col) = 1 GROUP BY ALL"""))
def c12(spark, sf):
    j = C.neighbour_pairs(B.vecs(spark, sf), ["year", "area"], ["z"])
    return j.groupBy("year", "area").agg(F.count("*").alias("n_pairs"), F.round(F.avg(V.cosine("z", "near_z")), 6).alias("mean_cosine"))


@query("c13_block_adjacency", sql("parcels", "edges", """
SELECT DISTINCT least(a.block_id, b.block_id) AS b1, greatest(a.block_id, b.block_id) AS b2 FROM edges
JOIN parcels a ON a.parcel_id=src JOIN parcels b ON b.parcel_id=dst WHERE a.block_id<>b.block_id"""))
def c13(spark, sf):
    from ..operators.parcels import block_adjacency

    return block_adjacency(B.edges(spark, sf), B.parcels(spark, sf))


@query("c14_prefix_join", sql("""
c AS (SELECT '5002271' || lpad((p_partkey % 23)::VARCHAR, 2, '0') || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS code FROM part)""", """
SELECT substr(code,1,9) AS town_code, count(*) AS n FROM c WHERE substr(code,8,2)::INT < 15 GROUP BY ALL"""))
def c14(spark, sf):
    codes = B.table(spark, sf, "part").selectExpr(
        "concat('5002271', lpad(cast(p_partkey % 23 as string), 2, '0'), lpad(cast(p_partkey % 1000 as string), 3, '0')) as code")
    towns = spark.range(15).selectExpr("concat('5002271', lpad(cast(id as string), 2, '0')) as town_code")
    return C.by_code_prefix(codes, "code", towns, "town_code", (9,)).groupBy("town_code").agg(F.count("*").alias("n"))


@query("c15_manifest_match", sql("labels_t", "areas", """
m AS (SELECT 'area_' || area_id AS a, area_id, stratum FROM areas)""", """
SELECT l.area, l.year AS start_year, l.year + 1 AS end_year, coalesce(l.year = 2020 + area_id % 3, false) AS matched,
 CASE WHEN l.year = 2020 + area_id % 3 THEN stratum END AS stratum FROM labels_t l LEFT JOIN m ON m.a = l.area"""))
def c15(spark, sf):
    from ..sources.catalog import parse_labels

    reg = parse_labels(B.files(spark, sf)).select("area", F.col("year").alias("start_year")).distinct().withColumn(
        "end_year", F.col("start_year") + 1)
    m = B.areas(spark, sf).selectExpr(
        "concat('AREA_', area_id) as area", "array(cast(2020 + area_id % 3 as int), cast(2021 + area_id % 3 as int)) as years", "stratum")
    return C.manifest_match(reg, m, ["stratum"])


@query("c16_step_deltas", sql("vecs", "steps", """
s AS (SELECT episode, t, action // 50 AS area, episode % 4 AS year, action % 50 AS cell, reward FROM steps)""", """
SELECT episode, t, cell::INT AS cell, reward, round(list_distance(a.z, b.z), 6) AS delta_norm
FROM s JOIN vecs a ON a.area=s.area AND a.year=s.year AND a.row*10+a.col=cell JOIN vecs b ON b.area=a.area AND b.year=a.year+1 AND b.row=a.row AND b.col=a.col"""))
def c16(spark, sf):
    s = B.steps(spark, sf).selectExpr(
        "episode", "t", "cast(action div 50 as int) as area", "cast(episode % 4 as int) as year", "action % 50 as cell", "reward")
    units = B.vecs(spark, sf).withColumn("cell", F.col("row") * 10 + F.col("col"))
    return C.step_deltas(s, units, ["area"], "cell").select(
        "episode", F.col("t").cast("bigint").alias("t"), "cell", "reward", F.round("delta_norm", 6).alias("delta_norm"))


@query("c17_configuration_pairing", sql("metric_rows", """
k AS (SELECT method AS mode, area, avg(value) AS m, stddev_samp(value) AS s FROM metric_rows GROUP BY ALL)""", """
SELECT o.mode, o.area, round(f.m - o.m, 6) AS delta, round(f.s, 6) AS full_sd FROM k f JOIN k o ON f.area=o.area AND f.mode='click' AND o.mode<>'click'"""))
def c17(spark, sf):
    k = B.metric_rows(spark, sf).groupBy(F.col("method").alias("mode"), "area").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return r6(C.configuration_deltas(k, "mode", "click", ["area"], "m", "s"), "delta", "full_sd")


@query("c18_comparison_protocol", sql("labels_t", """
y AS (SELECT area, list_sort(list(year)) AS y FROM labels_t GROUP BY area HAVING count(*) >= 3)""", """
SELECT area, 'calibration' AS role, y[1] AS start_year, y[2] AS end_year FROM y UNION ALL SELECT area, 'validation', y[2], y[3] FROM y"""))
def c18(spark, sf):
    from ..sources.catalog import parse_labels

    return C.comparison_protocol(parse_labels(B.files(spark, sf)).select("area", "year"), AREA)


@query("c19_shape_status", sql("triple", """
e AS (SELECT area, max(row) FILTER (start_cls IS NOT NULL)+1 AS ah, max(col) FILTER (start_cls IS NOT NULL)+1 AS aw,
 max(row) FILTER (pred_cls IS NOT NULL)+1 AS bh, max(col) FILTER (pred_cls IS NOT NULL)+1 AS bw FROM triple GROUP BY area)""", """
SELECT area, CASE WHEN ah=bh AND aw=bw THEN 'ok' ELSE 'shape_mismatch:' || ah || 'x' || aw || '_vs_' || bh || 'x' || bw END AS status FROM e"""))
def c19(spark, sf):
    s, _, p = _sides(spark, sf)
    return C.shape_status(s, p, AREA)
