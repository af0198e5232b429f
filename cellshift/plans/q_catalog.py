"""Catalog, manifest and registry queries over paths and registry rows from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog as C
from . import bindings as B
from .registry import query, sql


@query("a01_parse_label_name", sql("labels_t", "SELECT area, year FROM labels_t"))
def a01(spark, sf):
    return C.parse_labels(B.files(spark, sf)).select("area", "year").distinct()


@query("a02_parse_prediction_name", sql("preds_t", "SELECT area, start_year, end_year FROM preds_t"))
def a02(spark, sf):
    return C.parse_predictions(B.files(spark, sf)).select("area", "start_year", "end_year").distinct()


@query("a03_first_existing", sql("labels_t", "files", """
p AS (SELECT DISTINCT path FROM files),
t AS (SELECT area, year, unnest(['cache_b/' || area || '_emb_' || year || '.npy', 'cache_a/' || area || '_emb_' || year || '.npy',
 'cache_a/' || area || '_context.npy']) AS path, unnest([0,1,2]) AS prio FROM labels_t)""", """
SELECT area, year, (SELECT arg_min(t.path, prio) FROM t JOIN p USING (path) WHERE t.area=l.area AND t.year=l.year) AS found_path
FROM labels_t l"""))
def a03(spark, sf):
    files = B.files(spark, sf)
    wanted = C.parse_labels(files).select("area", "year").distinct()
    alias = C.area_aliases(F.col("area"))
    tries = F.flatten(F.transform(alias, lambda a: F.array(
        F.concat(F.lit("cache_b/"), a, F.lit("_emb_"), F.col("year").cast("string"), F.lit(".npy")),
        F.concat(F.lit("cache_a/"), a, F.lit("_emb_"), F.col("year").cast("string"), F.lit(".npy")),
        F.concat(F.lit("cache_a/"), a, F.lit("_context.npy")))))
    return C.first_existing(wanted, ["area", "year"], tries, files)


@query("a04_area_sources", sql("embs_t", """
g AS (SELECT root, area, count(DISTINCT year) AS n, min(year) AS f, max(year) AS l FROM embs_t
 WHERE root IN ('cache_b','cache_a') GROUP BY ALL)""", """
SELECT area, root, n AS n_years, f AS first_year, l AS last_year FROM (
 SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, root = 'cache_a') AS r FROM g WHERE n >= 3 AND l - f + 1 = n) WHERE r=1"""))
def a04(spark, sf):
    return C.area_sources(C.parse_embeddings(B.files(spark, sf)), ["cache_b", "cache_a"], 3)


@query("a05_grid_to_cells", sql("grid", "SELECT area, 0 AS row, col, start_cls AS cls, row AS band FROM grid"))
def a05(spark, sf):
    g = B.grid(spark, sf).groupBy("area", F.col("row").alias("band")).agg(
        F.array(F.transform(F.array_sort(F.collect_list(F.struct("col", "start_cls"))), lambda x: x["start_cls"])).alias("grid"))
    return C.grid_to_cells(g, ["area", "band"]).select("area", "row", "col", "cls", "band")


@query("a05_round_trip", sql("grid", "SELECT area, row, col, start_cls AS cls FROM grid WHERE (row + col) % 7 <> 3"))
def a05c(spark, sf):
    holed = B.grid(spark, sf).filter("(row + col) % 7 <> 3")
    return C.grid_rows_to_cells(C.cells_to_grid_rows(holed, ["area"], "start_cls"), ["area"])


@query("a05_cells_to_grid_rows", sql("grid", """
SELECT area, row, string_agg(start_cls, ',' ORDER BY col) AS line FROM grid GROUP BY ALL"""))
def a05b(spark, sf):
    rows = C.cells_to_grid_rows(B.grid(spark, sf), ["area"], "start_cls")
    return rows.select("area", "row", F.array_join("values", ",").alias("line"))


def registry_rows(spark, sf):
    return B.areas(spark, sf).selectExpr(
        "area", "stratum", "if(area_id % 10 = 7, 'tier1', tier) as tier",
        "if(contact_status = 'unclear', 'uncertain', contact_status) as development_contact_status",
        "if(area_id % 12 = 0, ' ', 'survey') as contact_evidence")


_REG = """
reg AS (SELECT area, stratum, CASE WHEN area_id % 10 = 7 THEN 'tier1' ELSE tier END AS tier,
 CASE WHEN contact_status='unclear' THEN 'uncertain' ELSE contact_status END AS status,
 CASE WHEN area_id % 12 = 0 THEN ' ' ELSE 'survey' END AS evidence FROM areas)"""


@query("a06_registry_violations", sql("areas", _REG, """
SELECT area, CASE WHEN tier='tier1' AND status<>'none' THEN 'tier1_requires_none' ELSE 'tier1_requires_evidence' END AS reason
FROM reg WHERE tier='tier1' AND (status<>'none' OR trim(evidence)='')"""))
def a06(spark, sf):
    return C.registry_violations(registry_rows(spark, sf)).select("area", "reason")


def registry_document(spark, sf):
    """A registry as JSON lines, every field present."""
    from ..session import shared_path

    path = shared_path(spark, "registry")
    rows = B.areas(spark, sf).selectExpr(
        "area", "2020 as start_year", "2021 as end_year", "'tier2' as tier", "stratum", "array(1.0D, 2.0D, 3.0D, 4.0D) as bbox",
        "'survey' as data_source", "if(contact_status = 'unclear', 'uncertain', contact_status) as development_contact_status",
        "'seen' as contact_evidence", "'test' as expected_role", "concat(area, '_a') as label_start_path",
        "concat(area, '_b') as label_end_path", "concat(area, '_p') as prediction_path", "'ok' as qc_status")
    C.write_lines(rows, path)
    return path


@query("a06_read_registry", sql("areas", """
SELECT area, 'tier2' AS tier, CASE WHEN contact_status='unclear' THEN 'uncertain' ELSE contact_status END AS status, area || '_p' AS prediction_path FROM areas"""))
def a06b(spark, sf):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(c, StringType()) for c in (
        "area", "tier", "development_contact_status", "contact_evidence", "prediction_path")])
    r = C.read_registry(spark, registry_document(spark, sf), schema, lines=True)
    return r.select("area", "tier", F.col("development_contact_status").alias("status"), "prediction_path")


@query("a06_missing_fields", sql("areas", "SELECT count(*) AS n, 'missing_field:notes' AS reason FROM areas"))
def a06c(spark, sf):
    lacks = C.missing_fields(spark, registry_document(spark, sf), "rows", (*C.REGISTRY_FIELDS, "notes", "zone"), lines=True)
    return lacks.groupBy("reason").agg(F.count("*").alias("n")).select("n", "reason")


def holdouts(spark, sf):
    """Raw manifest rows: mixed-case names, repeated years, some faulty."""
    return B.areas(spark, sf).selectExpr(
        "concat('Area_', area_id % 90) as area",
        "if(area_id % 17 = 0, array(1.0D, 2.0D), array(100.0D, 30.0D, 101.0D, 31.0D)) as bbox", "stratum",
        "array(cast(2021 + area_id % 2 as int), 2020, cast(2021 + area_id % 2 as int)) as years",
        "if(contact_status = 'unclear', 'odd', contact_status) as development_contact_status",
        "if(area_id % 19 = 0, '', 'survey') as contact_evidence", "contact_status", "nation", "area_id")


@query("a07_read_holdouts", sql("areas", """
SELECT 'area_' || area_id AS area, stratum, array_to_string(list_sort(list_distinct([2020, 2021 + area_id % 2])), ',') AS years FROM areas"""))
def a07(spark, sf):
    """A manifest of all areas under names of their own, none faulty; a07_holdout_violations has the faulty ones."""
    from ..session import shared_path

    path = shared_path(spark, "holdouts")
    C.write_lines(holdouts(spark, sf).selectExpr(
        "concat('Area_', area_id) as area", "array(100.0D, 30.0D, 101.0D, 31.0D) as bbox", "stratum", "years", "'s' as data_source",
        "'r' as selection_reason", "'none' as development_contact_status", "'survey' as contact_evidence", "'e' as expected_role",
        "'n' as notes"), path)
    h = C.read_holdouts(spark, path, lines=True)
    return h.select("area", "stratum", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("a07_holdout_violations", sql("areas", """
h AS (SELECT 'area_' || (area_id % 90) AS area, CASE WHEN area_id % 17 = 0 THEN 'bbox_needs_four_numbers'
 WHEN contact_status='unclear' THEN 'invalid_contact_status' WHEN area_id % 19 = 0 THEN 'missing_evidence' END AS reason FROM areas)""", """
SELECT * FROM h WHERE reason IS NOT NULL UNION ALL SELECT area, 'duplicate_area' FROM h GROUP BY area HAVING count(*) > 1"""))
def a07b(spark, sf):
    return C.holdout_violations(C.normalise_holdouts(holdouts(spark, sf)))


@query("a08_combine_manifests", sql("areas", """
SELECT area, (area_id % 3)::INT AS manifest FROM areas"""))
def a08(spark, sf):
    a = B.areas(spark, sf)
    parts = [a.filter(F.col("area_id") % 3 == i).select("area") for i in range(3)]
    return C.combine_manifests(parts)


@query("a08_combined_duplicates", sql("areas", """
SELECT stratum AS area, count(*) AS n FROM areas GROUP BY stratum HAVING count(*) > 1"""))
def a08b(spark, sf):
    a = B.areas(spark, sf).select(F.col("stratum").alias("area"))
    return C.duplicate_areas(C.combine_manifests([a], check=False))


@query("a09_manifest_select", sql("areas", """
SELECT area_id, area FROM areas WHERE stratum IN ('ASIA','EUROPE') ORDER BY area_id LIMIT 7"""))
def a09(spark, sf):
    m = B.areas(spark, sf).select("area_id", "area", "stratum")
    return C.manifest_select(m, "area_id", "stratum", ["ASIA", "EUROPE"], 7).select("area_id", "area")


def pairs(spark, sf):
    lab = C.parse_labels(B.files(spark, sf)).select("area", F.col("year").alias("start_year")).distinct()
    return lab.withColumn("end_year", F.col("start_year") + 1)


@query("a10_attach_predictions", sql("labels_t", "preds_t", """
SELECT l.area, l.year AS start_year, l.year+1 AS end_year, path FROM labels_t l
LEFT JOIN preds_t p ON p.area=l.area AND p.start_year=l.year AND p.end_year=l.year+1"""))
def a10(spark, sf):
    preds = C.parse_predictions(B.files(spark, sf)).distinct()
    return C.attach_predictions(pairs(spark, sf), ["area", "start_year", "end_year"], preds)


@query("a10_attachment_summary", sql("labels_t", "preds_t", """
SELECT count(*) AS n_rows, count(path) AS n_matched, sum((path IS NULL)::INT)::BIGINT AS n_missing FROM labels_t l
LEFT JOIN preds_t p ON p.area=l.area AND p.start_year=l.year AND p.end_year=l.year+1"""))
def a10b(spark, sf):
    return C.attachment_summary(a10(spark, sf))


@query("a11_prediction_violations", sql("grid", """
p AS (SELECT area, row, CASE WHEN col=39 THEN col+1 ELSE col END AS col,
 CASE WHEN row%9=0 THEN NULL WHEN row%9=1 THEN pred_cls+0.5 WHEN row%9=2 THEN pred_cls+4 ELSE pred_cls END::DOUBLE AS v, true AS here FROM grid),
j AS (SELECT coalesce(p.area,g.area) AS area, v, here, g.row IS NOT NULL AS ref FROM p FULL JOIN grid g ON p.area=g.area AND p.row=g.row AND p.col=g.col)""", """
SELECT area, sum(coalesce(here AND v IS NULL,false)::INT)::BIGINT AS n_not_finite,
 sum(coalesce(here AND v<>floor(v),false)::INT)::BIGINT AS n_not_integer,
 sum(coalesce(here AND v=floor(v) AND v>5,false)::INT)::BIGINT AS n_unknown_class,
 sum(coalesce(here AND NOT ref,false)::INT)::BIGINT AS n_off_grid, sum((here IS NULL AND ref)::INT)::BIGINT AS n_uncovered
FROM j GROUP BY area"""))
def a11(spark, sf):
    g = B.grid(spark, sf)
    p = g.selectExpr("area", "row", "if(col = 39, col + 1, col) as col",
                     "cast(case when row % 9 = 0 then null when row % 9 = 1 then pred_cls + 0.5D"
                     " when row % 9 = 2 then pred_cls + 4 else pred_cls end as double) as v")
    return C.prediction_violations(p, g, ["area"], "v", (0, 1, 2, 3, 4, 5))


@query("a12_filter_to_holdouts", sql("preds_t", "areas", """
SELECT area, start_year, end_year FROM preds_t WHERE lower(area) IN (SELECT 'area_' || (area_id % 90) FROM areas WHERE stratum='ASIA')"""))
def a12(spark, sf):
    preds = C.parse_predictions(B.files(spark, sf)).select("area", "start_year", "end_year").distinct()
    return C.filter_to_holdouts(preds, holdouts(spark, sf).filter("stratum = 'ASIA'"))


@query("a13_areas_with_status", sql("areas", "SELECT area, stratum FROM areas WHERE contact_status IN ('none','unclear')"))
def a13(spark, sf):
    return C.areas_with_status(B.areas(spark, sf), ("none", "unclear")).select("area", "stratum")


@query("a14_admin_filter", sql("areas", "SELECT area, nation FROM areas WHERE stratum='ASIA' AND tier='tier1'"))
def a14(spark, sf):
    return C.admin_filter(B.areas(spark, sf), "stratum=ASIA; tier=tier1").select("area", "nation")


@query("a15_csv_fields", sql("areas", """
SELECT area, '{"tier":"' || tier || '","stratum":"' || stratum || '"}' AS tags FROM areas"""))
def a15(spark, sf):
    from ..session import shared_path

    path = shared_path(spark, "report")
    C.write_table(B.areas(spark, sf).select("area", F.struct("tier", "stratum").alias("tags")), path, "csv")
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("a15_json_document", sql("areas", "SELECT area, tier FROM areas"))
def a15b(spark, sf):
    from ..session import shared_path

    path = shared_path(spark, "document")
    C.write_document(B.areas(spark, sf).select("area", "tier"), path)
    return spark.read.schema("rows array<struct<area:string,tier:string>>").option("multiLine", True).json(path).select(F.inline("rows"))


@query("a15_json_lines", sql("areas", "SELECT area, tier, stratum FROM areas"))
def a15c(spark, sf):
    from ..session import shared_path

    path = shared_path(spark, "lines")
    C.write_lines(B.areas(spark, sf).select("area", "tier", "stratum"), path)
    return spark.read.schema("area string, tier string, stratum string").json(path)


@query("a16_load_steps", sql("steps", """
SELECT policy, count(*) AS n, round(sum(reward), 4) AS total FROM steps WHERE policy LIKE 'c%' OR policy LIKE 'pur%' GROUP BY policy"""))
def a16(spark, sf):
    s = C.load_steps(B.steps(spark, sf), ["c", "pur"])
    return s.groupBy("policy").agg(F.count("*").alias("n"), F.round(F.sum("reward"), 4).alias("total"))


KINDS = ("start_embedding", "end_embedding", "context", "start_label", "end_label")


@query("a17_complete_cases", sql("files", """
f AS (SELECT DISTINCT path, regexp_extract(path, '(area_\\d+)_', 1) AS area FROM files),
p AS (SELECT area, bool_or(path LIKE '%\\_emb\\_2020.npy' ESCAPE '\\') AS se, bool_or(path LIKE '%\\_emb\\_2021.npy' ESCAPE '\\') AS ee,
 bool_or(path LIKE '%\\_context.npy' ESCAPE '\\') AS c, bool_or(path LIKE '%\\_lulc\\_2020.npy' ESCAPE '\\') AS sl,
 bool_or(path LIKE '%\\_lulc\\_2021.npy' ESCAPE '\\') AS el FROM f WHERE area<>'' GROUP BY area)""", """
SELECT area, CASE WHEN se AND ee AND c AND sl AND el THEN NULL ELSE 'missing:' || concat_ws(',',
 CASE WHEN NOT se THEN 'start_embedding' END, CASE WHEN NOT ee THEN 'end_embedding' END, CASE WHEN NOT c THEN 'context' END,
 CASE WHEN NOT sl THEN 'start_label' END, CASE WHEN NOT el THEN 'end_label' END) END AS reason FROM p"""))
def a17(spark, sf):
    f = B.files(spark, sf).withColumn("area", F.regexp_extract("path", r"(area_\d+)_", 1)).filter("area <> ''")
    p = F.col("path")
    tests = (p.endswith("_emb_2020.npy"), p.endswith("_emb_2021.npy"), p.endswith("_context.npy"),
             p.endswith("_lulc_2020.npy"), p.endswith("_lulc_2021.npy"))
    flags = C.presence(f, "area", dict(zip(KINDS, tests)))
    return C.complete_cases(flags, KINDS).select("area", "reason")


@query("a18_evidence_status", sql("areas", "files", """
st AS (SELECT 'stage_' || (area_id % 20) AS stage, area_id % 20 < 12 AS summary,
 'labels/area_' || (area_id % 60) || '_lulc_2019.npy' AS path FROM areas),
p AS (SELECT DISTINCT path, true AS e FROM files)""", """
SELECT stage, CASE WHEN NOT bool_and(e IS NOT NULL) THEN 'missing' WHEN bool_and(summary) THEN 'complete' ELSE 'diagnostic' END AS status,
 sum((e IS NOT NULL)::INT)::BIGINT AS n_present, count(*) AS n_paths FROM st LEFT JOIN p USING (path) GROUP BY stage"""))
def a18(spark, sf):
    st = B.areas(spark, sf).selectExpr(
        "concat('stage_', area_id % 20) as stage", "area_id % 20 < 12 as summary",
        "concat('labels/area_', area_id % 60, '_lulc_2019.npy') as path")
    return C.evidence_status(st, B.files(spark, sf))


_BOX = """
bx AS (SELECT c_custkey AS record_index, 73.0 + (c_custkey % 60) AS xmin, 18.0 + (c_custkey % 35) AS ymin,
 73.0 + (c_custkey % 60) + 0.05 + (c_custkey % 9) * 0.05 AS xmax, 18.0 + (c_custkey % 35) + 0.04 + (c_custkey % 7) * 0.05 AS ymax,
 n_name AS province, c_mktsegment AS town FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
_SIZE = """greatest(1, ceil(abs(xmax-xmin)*greatest(1.0, 111320.0*cos(radians((ymin+ymax)/2.0)))/100.0))::BIGINT AS width_px,
 greatest(1, ceil(abs(ymax-ymin)*111320.0/100.0))::BIGINT AS height_px"""
_BOXD = _BOX.replace("73.0", "73.0::DOUBLE").replace("18.0", "18.0::DOUBLE").replace("0.05", "0.05::DOUBLE").replace("0.04", "0.04::DOUBLE")


def boxes(spark, sf):
    return B.table(spark, sf, "customer").selectExpr(
        "c_custkey as record_index", "73.0D + (c_custkey % 60) as xmin", "18.0D + (c_custkey % 35) as ymin",
        "73.0D + (c_custkey % 60) + 0.05D + (c_custkey % 9) * 0.05D as xmax",
        "18.0D + (c_custkey % 35) + 0.04D + (c_custkey % 7) * 0.05D as ymax")


def attributes(spark, sf):
    c, n = B.table(spark, sf, "customer"), B.table(spark, sf, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey as record_index", "n_name as province", "c_mktsegment as town")


@query("a19_candidate_units", sql(_BOXD, f"""
SELECT record_index, province, 'units_record_' || lpad(record_index::VARCHAR, 6, '0') AS area_id, {_SIZE}
FROM bx WHERE province = 'NATION_3' ORDER BY record_index LIMIT 25"""))
def a19(spark, sf):
    u = C.candidate_units(attributes(spark, sf), boxes(spark, sf), "units", 100, "NATION_3", 25)
    return u.select("record_index", "province", "area_id", "width_px", "height_px")


def candidate_rows(spark, sf):
    return B.metric_rows(spark, sf).selectExpr(
        "method as candidate", "cast(area as string) as area", "seed as parameter_index", "value")


@query("a20_candidate_violations", sql("metric_rows", """
r AS (SELECT method AS candidate, area::VARCHAR AS area, seed FROM metric_rows)""", """
SELECT candidate, '' AS area, 'several_parameter_indices' AS reason FROM r GROUP BY candidate HAVING count(DISTINCT seed) > 1
UNION ALL SELECT candidate, area, 'blank_area' FROM r WHERE trim(coalesce(area, '')) = ''
UNION ALL SELECT candidate, area, 'duplicate_area' FROM r GROUP BY candidate, area HAVING count(*) > 1"""))
def a20(spark, sf):
    return C.candidate_violations(candidate_rows(spark, sf))


@query("a20_candidate_metrics", sql("metric_rows", """
SELECT method AS candidate, area::VARCHAR AS area, 3 AS parameter_index, round(avg(value), 6) AS value FROM metric_rows WHERE seed=3 GROUP BY ALL"""))
def a20b(spark, sf):
    rows = candidate_rows(spark, sf).groupBy("candidate", "area", "parameter_index").agg(
        F.round(F.avg("value"), 6).alias("value"))
    return C.candidate_metrics(rows, 3)


@query("a21_calibration_cases", sql("files", "labels_t", """
f AS (SELECT DISTINCT path FROM files WHERE path LIKE 'predictions/%'),
p AS (SELECT path, regexp_matches(path, '[^/]+_lulc_pred_\\d{4}_\\d{4}\\.npy$') AS ok,
 regexp_extract(path, '([^/]+)_lulc_pred_(\\d{4})_(\\d{4})\\.npy$', 1) AS area,
 try_cast(regexp_extract(path, '([^/]+)_lulc_pred_(\\d{4})_(\\d{4})\\.npy$', 2) AS INT) AS sy,
 try_cast(regexp_extract(path, '([^/]+)_lulc_pred_(\\d{4})_(\\d{4})\\.npy$', 3) AS INT) AS ey FROM f)""", """
SELECT p.path, p.area, sy AS start_year, ey AS end_year, CASE WHEN NOT ok THEN 'filename_not_supported'
 WHEN s.year IS NULL OR e.year IS NULL THEN 'missing_start_or_end_label'
 WHEN ((length(p.area)*100 + sy) % 4 = 0) <> ((length(p.area)*100 + ey) % 4 = 0) THEN 'shape_mismatch' END AS reason
FROM p LEFT JOIN labels_t s ON s.area=p.area AND s.year=sy LEFT JOIN labels_t e ON e.area=p.area AND e.year=ey"""))
def a21(spark, sf):
    files = B.files(spark, sf).filter("path like 'predictions/%'").distinct()
    lab = C.parse_labels(B.files(spark, sf))
    # shapes: years divisible by four have another grid size
    shapes = lab.select("area", "year").distinct().withColumn(
        "shape", F.when((F.length("area") * 100 + F.col("year")) % 4 == 0, "10x10").otherwise("12x12"))
    return C.calibration_cases(files, lab, shapes)
