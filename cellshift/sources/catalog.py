"""File catalogs, manifests, registries and sinks as DataFrames.

A catalog is a DataFrame with a ``path`` column; names carry area and years.
Nothing is listed or looped over on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: file name patterns and accepted contact states
LABEL_NAME = r"^(.+)_lulc_(\d{4})\.npy$"
PREDICTION_NAME = r"^(.+)_lulc_pred_(\d{4})_(\d{4})\.npy$"
EMBEDDING_NAME = r"^(.+)_emb_(\d{4})\.npy$"
CONTEXT_NAME = r"^(.+)_context\.npy$"
CONTACT_STATES = ("none", "known_contact", "uncertain")
AREA_ALIASES = {"banzhucun": "village"}

HOLDOUT_SCHEMA = T.StructType(
    [
        T.StructField("area", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("stratum", T.StringType()),
        T.StructField("years", T.ArrayType(T.IntegerType())),
        T.StructField("data_source", T.StringType()),
        T.StructField("selection_reason", T.StringType()),
        T.StructField("development_contact_status", T.StringType()),
        T.StructField("contact_evidence", T.StringType()),
        T.StructField("expected_role", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)


class CatalogError(ValueError):
    """Raised when a manifest, registry or table breaks its contract."""


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing; only file metadata is read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length")
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def root_name(path: Column) -> Column:
    """Everything before the file name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parse_labels(files: DataFrame) -> DataFrame:
    n = file_name(F.col("path"))
    return files.filter(n.rlike(LABEL_NAME)).select(
        "path", F.regexp_extract(n, LABEL_NAME, 1).alias("area"),
        F.regexp_extract(n, LABEL_NAME, 2).cast("int").alias("year"),
    )


def parse_predictions(files: DataFrame) -> DataFrame:
    n = file_name(F.col("path"))
    return files.filter(n.rlike(PREDICTION_NAME)).select(
        "path", F.regexp_extract(n, PREDICTION_NAME, 1).alias("area"),
        F.regexp_extract(n, PREDICTION_NAME, 2).cast("int").alias("start_year"),
        F.regexp_extract(n, PREDICTION_NAME, 3).cast("int").alias("end_year"),
    )


def parse_embeddings(files: DataFrame) -> DataFrame:
    n = file_name(F.col("path"))
    return files.filter(n.rlike(EMBEDDING_NAME)).select(
        "path", root_name(F.col("path")).alias("root"),
        F.regexp_extract(n, EMBEDDING_NAME, 1).alias("area"),
        F.regexp_extract(n, EMBEDDING_NAME, 2).cast("int").alias("year"),
    )


def area_aliases(area: Column, aliases: Mapping[str, str] = AREA_ALIASES) -> Column:
    """The area name followed by its alias, if it has one."""
    extra = F.lit(None).cast("string")
    for k, v in aliases.items():
        extra = F.when(area == k, F.lit(v)).otherwise(extra)
    return F.filter(F.array(area, extra), lambda x: x.isNotNull())


def first_existing(
    wanted: DataFrame, keys: Sequence[str], candidates: Column, files: DataFrame
) -> DataFrame:
    """First path of the ordered ``candidates`` array that exists; NULL if none does."""
    tries = wanted.select(*keys, F.posexplode(candidates).alias("_prio", "path"))
    hit = tries.join(files.select("path").distinct(), "path").groupBy(*keys).agg(
        F.min_by("path", "_prio").alias("found_path")
    )
    return wanted.select(*keys).distinct().join(hit, list(keys), "left")


def area_sources(
    embeddings: DataFrame, roots: Sequence[str], min_years: int = 2
) -> DataFrame:
    """Per area the root with the longest gap-free year series (first root wins ties)."""
    order = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root"))
    per = embeddings.filter(F.col("root").isin(list(roots))).groupBy("root", "area").agg(
        F.count_distinct("year").alias("n_years"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    ok = (F.col("n_years") >= min_years) & (
        F.col("last_year") - F.col("first_year") + 1 == F.col("n_years")
    )
    best = F.min(F.struct((-F.col("n_years")).alias("m"), order.alias("p"), "root", "first_year", "last_year"))
    return per.filter(ok).groupBy("area").agg(best.alias("_b")).select(
        "area", F.col("_b.root").alias("root"), (-F.col("_b.m")).alias("n_years"),
        F.col("_b.first_year").alias("first_year"), F.col("_b.last_year").alias("last_year"),
    )


def grid_to_cells(grids: DataFrame, keys: Sequence[str], grid: str = "grid") -> DataFrame:
    """ARRAY<ARRAY<INT>> per key -> one row per cell."""
    rows = grids.select(*keys, F.posexplode(grid).alias("row", "_vals"))
    return rows.select(*keys, "row", F.posexplode("_vals").alias("col", "cls"))


def cells_to_grid_rows(cells: DataFrame, keys: Sequence[str], cls: str = "cls") -> DataFrame:
    """One row per raster row: value i is the class of column i, NULL where the cell is missing.

    A raster row is the largest unit kept in one value; whole rasters are not
    assembled. A row ends at its last cell.
    """
    at = F.map_from_entries(F.collect_list(F.struct("col", F.col(cls).alias("v"))))
    rows = cells.groupBy(*keys, "row").agg(at.alias("_at"), F.max("col").alias("_last"))
    return rows.select(*keys, "row", F.transform(
        F.sequence(F.lit(0), F.col("_last").cast("int")), lambda c: F.try_element_at("_at", c.cast(cells.schema["col"].dataType))
    ).alias("values"))


def grid_rows_to_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of rows from ``cells_to_grid_rows``; holes give no cell."""
    return rows.select(*keys, "row", F.posexplode("values").alias("col", "cls")).filter("cls is not null")


def fail_if_any(violations: DataFrame, what: str, limit: int = 5) -> None:
    """Raise with the first few violating rows."""
    rows = violations.limit(limit).collect()
    if rows:
        raise CatalogError(f"{what}: {[r.asDict() for r in rows]}")


# fixed values: the fields that a registry row and a holdout area must have
REGISTRY_FIELDS = (
    "area", "start_year", "end_year", "tier", "stratum", "bbox", "data_source", "development_contact_status",
    "contact_evidence", "expected_role", "label_start_path", "label_end_path", "prediction_path", "qc_status",
)
HOLDOUT_FIELDS = (
    "area", "bbox", "stratum", "years", "data_source", "selection_reason", "development_contact_status",
    "contact_evidence", "expected_role", "notes",
)


DOCUMENT_BYTES = 64 << 20  # one JSON document is one value in one task; larger tables are JSON lines


def _document_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def _check_document(size: int, path: str) -> None:
    if size > DOCUMENT_BYTES:
        raise CatalogError(f"{path}: a document of {size} bytes, over {DOCUMENT_BYTES}; use JSON lines (write_lines, lines=True)")


def _json_rows(spark: SparkSession, path: str, array: str, schema: str | T.DataType, lines: bool) -> DataFrame:
    """(row_index, r): the rows of a JSON file as ``schema``, from lines in any number of tasks or from one document's array.

    Indexes of lines are ascending over the files, with gaps.
    """
    kind = schema if isinstance(schema, str) else schema.simpleString()
    if lines:
        text = spark.read.text(path).filter(F.trim("value") != "")
        return text.select(F.monotonically_increasing_id().alias("row_index"), F.from_json("value", kind).alias("r"))
    _check_document(_document_bytes(spark, path), path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"struct<`{array}`:array<{kind}>>")[array]).alias("row_index", "r"))


def missing_fields(spark: SparkSession, path: str, array: str, required: Sequence[str], lines: bool = False) -> DataFrame:
    """(row_index, reason): rows of the document's array, or lines, that lack a required field, with the first one by name."""
    lacks = F.filter(
        F.array(*[F.lit(f) for f in sorted(required)]), lambda f: ~F.coalesce(F.map_contains_key("r", f), F.lit(False)))
    rows = _json_rows(spark, path, array, "map<string,string>", lines)
    return rows.select("row_index", F.get(lacks, 0).alias("_f")).filter(
        "_f is not null").select("row_index", F.concat(F.lit("missing_field:"), "_f").alias("reason"))


def write_document(rows: DataFrame, path: str, array: str = "rows") -> None:
    """One JSON document {"<array>": [...]} of a table of at most DOCUMENT_BYTES, rows in the order of their JSON text."""
    text = rows.select(F.to_json(F.struct("*")).alias("j"))
    _check_document(text.agg(F.sum(F.octet_length("j") + 1)).first()[0] or 0, path)
    one = F.concat_ws(",", F.array_sort(F.collect_list("j")))
    text.agg(F.concat(F.lit('{"' + array + '":['), one, F.lit("]}")).alias("value")).coalesce(1).write.text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """A table of any size as JSON lines: one object a row, as many files as tasks, NULL fields written."""
    rows.write.option("ignoreNullFields", "false").json(path)


def registry_violations(registry: DataFrame) -> DataFrame:
    """Rows breaking the registry contract, with the first reason that applies."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    tier1 = text("tier") == "tier1"
    status = text("development_contact_status")
    reason = (
        F.when(~status.isin(*CONTACT_STATES), "invalid_contact_status")
        .when(tier1 & (status != "none"), "tier1_requires_none")
        .when(tier1 & (text("contact_evidence") == ""), "tier1_requires_evidence")
    )
    return registry.withColumn("reason", reason).filter("reason is not null")


def read_registry(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Registry rows from a JSON document {"rows": [...]} or from JSON lines; contract breaches raise."""
    fail_if_any(missing_fields(spark, path, "rows", REGISTRY_FIELDS, lines), "registry rows")
    rows = _json_rows(spark, path, "rows", schema, lines).select("row_index", "r.*")
    rows = rows.withColumns({
        c: F.trim(F.col(c)) for c in ("tier", "development_contact_status", "contact_evidence")
    })
    fail_if_any(registry_violations(rows), "registry rows")
    return rows


def normalise_holdouts(raw: DataFrame) -> DataFrame:
    """Lower-cased area, sorted distinct years."""
    return raw.withColumns(
        {"area": F.lower(F.trim("area")), "years": F.array_sort(F.array_distinct("years"))}
    )


def holdout_violations(h: DataFrame) -> DataFrame:
    """Typed checks of each area, plus duplicates."""
    n_null = F.size(F.filter("bbox", lambda v: v.isNull()))
    reason = (
        F.when(F.col("area").isNull() | (F.col("area") == ""), "missing_area")
        .when(F.col("bbox").isNull() | (F.size("bbox") != 4) | (n_null > 0), "bbox_needs_four_numbers")
        .when(F.col("years").isNull() | (F.size("years") == 0), "years_empty")
        .when(~F.col("development_contact_status").isin(*CONTACT_STATES), "invalid_contact_status")
        .when(F.trim(F.coalesce("contact_evidence", F.lit(""))) == "", "missing_evidence")
    )
    bad = h.select("area", reason.alias("reason")).filter("reason is not null")
    dup = h.groupBy("area").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bad.unionByName(dup.select("area", F.lit("duplicate_area").alias("reason")))


def read_holdouts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Holdout areas from a JSON document {"areas": [...]} or from JSON lines; contract breaches raise."""
    fail_if_any(missing_fields(spark, path, "areas", HOLDOUT_FIELDS, lines), "holdout areas")
    h = normalise_holdouts(_json_rows(spark, path, "areas", HOLDOUT_SCHEMA, lines).select("r.*"))
    fail_if_any(holdout_violations(h), "holdout areas")
    return h


def combine_manifests(parts: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """Concatenate manifests; an area in two of them is an error, not a duplicate to drop."""
    out = parts[0].withColumn("manifest", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("manifest", F.lit(i)))
    if check:
        fail_if_any(duplicate_areas(out), "duplicate combined areas")
    return out


def duplicate_areas(manifest: DataFrame, keys: Sequence[str] = ("area",)) -> DataFrame:
    return manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def manifest_select(
    manifest: DataFrame, position: str, key: str, ids: Sequence | None = None, limit: int | None = None
) -> DataFrame:
    """Rows by id in manifest order, then at most ``limit`` of them."""
    out = manifest if ids is None else manifest.filter(F.col(key).isin(list(ids)))
    return out if limit is None else out.orderBy(position).limit(limit)


def attach_predictions(
    registry: DataFrame, keys: Sequence[str], predictions: DataFrame, strict: bool = False
) -> DataFrame:
    """Left-join prediction paths; strict mode fails on any missing one."""
    out = registry.join(predictions, list(keys), "left")
    if strict:
        fail_if_any(out.filter("path is null").select(*keys), "missing predictions")
    return out


def attachment_summary(attached: DataFrame) -> DataFrame:
    """n_rows, n_matched, n_missing; the missing rows stay a DataFrame (``path is null``)."""
    return attached.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("path").alias("n_matched"),
        F.sum(F.col("path").isNull().cast("bigint")).alias("n_missing"),
    )


def prediction_violations(
    pred: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, allowed: Sequence[int]
) -> DataFrame:
    """Per key: non-finite, non-integer, off-grid and unknown-class cells of a prediction."""
    v, here = F.col(value), F.coalesce(F.col("_p"), F.lit(False))
    k = [*keys, "row", "col"]
    ref = reference.select(*k).withColumn("_ref", F.lit(True))
    j = pred.select(*k, value).withColumn("_p", F.lit(True)).join(ref, k, "full_outer")
    bad_num = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    whole = v == F.floor(v)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return j.groupBy(*keys).agg(
        count(here & bad_num).alias("n_not_finite"),
        count(here & ~bad_num & ~whole).alias("n_not_integer"),
        count(here & ~bad_num & whole & ~v.isin([float(c) for c in allowed])).alias("n_unknown_class"),
        count(here & F.col("_ref").isNull()).alias("n_off_grid"),
        count(~here & F.col("_ref")).alias("n_uncovered"),
    )


def filter_to_holdouts(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Case-insensitive semi join on the area."""
    names = manifest.select(F.lower("area").alias("_a")).distinct()
    return predictions.join(names, F.lower(predictions["area"]) == F.col("_a"), "left_semi")


def areas_with_status(manifest: DataFrame, statuses: Sequence[str] = ("none",)) -> DataFrame:
    return manifest.filter(F.col("contact_status").isin(list(statuses)))


def parse_admin_filter(text: str) -> dict[str, str]:
    """"key=value;key=value" -> dict."""
    out = {}
    for part in text.split(";"):
        if part.strip():
            k, sep, v = part.partition("=")
            if not sep:
                raise CatalogError(f"filter item needs '=': {part}")
            out[k.strip()] = v.strip()
    return out


def admin_filter(rows: DataFrame, text: str) -> DataFrame:
    cond = F.lit(True)
    for k, v in parse_admin_filter(text).items():
        cond = cond & (F.col(k).cast("string") == v)
    return rows.filter(cond)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", fields: Sequence[str] | None = None) -> None:
    """Write chosen columns; CSV gets nested columns as JSON text."""
    out = df.select(*fields) if fields else df
    if fmt == "csv":
        nested = [
            f.name for f in out.schema.fields
            if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        ]
        out = out.withColumns({c: F.to_json(c) for c in nested}) if nested else out
        out.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").format(fmt).save(path)


def load_steps(steps: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Trajectory steps whose policy starts with one of the prefixes."""
    if not prefixes:
        return steps
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("policy").startswith(p)
    return steps.filter(cond)


def presence(files: DataFrame, key: str, kinds: Mapping[str, Column]) -> DataFrame:
    """Per key a boolean column per kind: does any file satisfy its predicate?"""
    return files.groupBy(key).agg(*[F.max(c).alias(k) for k, c in kinds.items()])


def complete_cases(flags: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add ``reason`` = 'missing:a,b' for incomplete rows, NULL for complete ones."""
    miss = F.filter(
        F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in required]),
        lambda x: x.isNotNull(),
    )
    return flags.withColumn(
        "reason", F.when(F.size(miss) > 0, F.concat(F.lit("missing:"), F.array_join(miss, ",")))
    )


def evidence_status(stages: DataFrame, files: DataFrame) -> DataFrame:
    """Per stage (stage, summary, path): complete / diagnostic / missing."""
    known = files.select("path").distinct().withColumn("_e", F.lit(True))
    j = stages.join(known, "path", "left")
    all_there = F.bool_and(F.col("_e").isNotNull())
    return j.groupBy("stage").agg(
        F.when(~all_there, "missing").when(F.bool_and("summary"), "complete").otherwise("diagnostic")
        .alias("status"),
        F.sum(F.col("_e").isNotNull().cast("bigint")).alias("n_present"),
        F.count(F.lit(1)).alias("n_paths"),
    )


def candidate_units(
    attributes: DataFrame, boxes: DataFrame, stem: str, scale_m: int,
    province: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Attributes joined to boxes by record index, with grid size and unit id."""
    from ..operators.cells import bbox_grid_size

    j = attributes.join(boxes, "record_index")
    if province is not None:
        j = j.filter(F.col("province") == province)
    if limit is not None:
        j = j.orderBy("record_index").limit(limit)
    w, h = bbox_grid_size(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), scale_m)
    return j.withColumns({
        "area_id": F.format_string(stem + "_record_%06d", F.col("record_index")),
        "width_px": w, "height_px": h,
    })


def candidate_metrics(rows: DataFrame, parameter_index: int | None = None) -> DataFrame:
    """Case metrics of candidates at one parameter index per candidate.

    Several indices, blank areas and duplicate areas are errors.
    """
    if parameter_index is not None:
        rows = rows.filter(F.col("parameter_index") == parameter_index)
    fail_if_any(candidate_violations(rows), "candidate metrics")
    return rows


def candidate_violations(rows: DataFrame) -> DataFrame:
    many = rows.groupBy("candidate").agg(F.count_distinct("parameter_index").alias("n")).filter("n > 1")
    blank = rows.filter(F.trim(F.coalesce("area", F.lit(""))) == "")
    dup = rows.groupBy("candidate", "area").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        many.select("candidate", F.lit("").alias("area"), F.lit("several_parameter_indices").alias("reason"))
        .unionByName(blank.select("candidate", "area", F.lit("blank_area").alias("reason")))
        .unionByName(dup.select("candidate", "area", F.lit("duplicate_area").alias("reason")))
    )


def calibration_cases(
    files: DataFrame, labels: DataFrame, shapes: DataFrame
) -> DataFrame:
    """Prediction files with a skip reason: bad name, missing label, shape mismatch.

    ``files`` are the prediction paths, ``labels`` (area, year), ``shapes``
    (area, year-or-pair key ``kind``, height, width).
    """
    n = file_name(F.col("path"))
    p = files.select(
        "path", n.rlike(PREDICTION_NAME).alias("_ok"),
        F.regexp_extract(n, PREDICTION_NAME, 1).alias("area"),
        F.regexp_extract(n, PREDICTION_NAME, 2).try_cast("int").alias("start_year"),
        F.regexp_extract(n, PREDICTION_NAME, 3).try_cast("int").alias("end_year"),
    )
    lab = labels.select("area", "year").distinct()
    s = lab.select("area", F.col("year").alias("start_year"), F.lit(True).alias("_s"))
    e = lab.select("area", F.col("year").alias("end_year"), F.lit(True).alias("_e"))
    ss = shapes.select("area", F.col("year").alias("start_year"), F.col("shape").alias("start_shape"))
    es = shapes.select("area", F.col("year").alias("end_year"), F.col("shape").alias("end_shape"))
    j = (
        p.join(s, ["area", "start_year"], "left").join(e, ["area", "end_year"], "left")
        .join(ss, ["area", "start_year"], "left").join(es, ["area", "end_year"], "left")
    )
    reason = (
        F.when(~F.col("_ok"), "filename_not_supported")
        .when(F.col("_s").isNull() | F.col("_e").isNull(), "missing_start_or_end_label")
        .when(F.col("start_shape") != F.col("end_shape"), "shape_mismatch")
    )
    return j.select("path", "area", "start_year", "end_year", reason.alias("reason"))
