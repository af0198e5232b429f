"""Cell-level projections, filters and joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from ..functions.columns import clamp, lookup
from .ranking import attach_row, attach_table, join_small

# fixed values: areas used in development, land codes, metres per degree
KNOWN_AREAS = (
    "yangtze_delta", "jing_jin_ji", "pearl_river", "chengdu_plain", "northeast_plain",
    "north_china_plain", "jianghan_plain", "hetao", "yunnan_eco", "daxinganling", "qinghai_edge",
    "wuyi_mountain", "guanzhong", "minnan_coast", "poyang_lake", "banzhucun", "bishan", "heping",
)
FARMLAND_PREFIXES = ("011", "012", "013")
FOREST_PREFIXES = ("031", "032", "033")
BARRIER_PREFIXES = ("10", "11", "20")
METRES_PER_DEGREE = 111_320.0


def tier(area: Column, status: Column, known: Sequence[str] = KNOWN_AREAS) -> Column:
    return (
        F.when(F.lower(area).isin(list(known)), "tier2")
        .when(status == "none", "tier1")
        .when(status == "known_contact", "tier2")
        .otherwise("review_required")
    )


def stratum(area: Column, strata: Mapping[str, str]) -> Column:
    return lookup(strata, F.lower(area), "Unknown")


def pair_profile(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extents and counts of a start/end/predicted triple with nullable classes."""
    def side(c: str) -> list[Column]:
        has = F.col(c).isNotNull()
        return [
            F.count(c).alias(f"n_{c}"),
            (F.max(F.when(has, F.col("row"))) + 1).alias(f"h_{c}"),
            (F.max(F.when(has, F.col("col"))) + 1).alias(f"w_{c}"),
        ]

    changed = (F.col("start_cls") != F.col("end_cls")).cast("bigint")
    return aligned.groupBy(*keys).agg(
        *side("start_cls"), *side("end_cls"), *side("pred_cls"),
        F.coalesce(F.sum(changed), F.lit(0)).alias("true_change_pixels"),
        (F.min("pred_cls") == F.max("pred_cls")).alias("one_pred_class"),
    )


def qc_status(profile: DataFrame, has_embedding: Column) -> DataFrame:
    """Exclusion reason of a pair; the first one that applies, in fixed order."""
    def differ(a: str, b: str) -> Column:
        return (F.col(f"h_{a}") != F.col(f"h_{b}")) | (F.col(f"w_{a}") != F.col(f"w_{b}")) | (
            F.col(f"n_{a}") != F.col(f"n_{b}")
        )

    zero = F.col("true_change_pixels") == 0
    reason = (
        F.when((F.col("n_start_cls") == 0) | (F.col("n_end_cls") == 0), "missing_label")
        .when(differ("start_cls", "end_cls"), "label_shape_mismatch")
        .when((F.col("n_pred_cls") == 0) | differ("start_cls", "pred_cls"), "label_prediction_shape_mismatch")
        .when(zero, "zero_reference_change")
        .when(F.col("one_pred_class"), "class_collapse")
        .when(~has_embedding, "missing_embedding")
        .otherwise("")
    )
    status = (
        F.when(F.col("excluded_reason") == "", "include")
        .when(F.col("excluded_reason") == "zero_reference_change", "negative_control")
        .otherwise("exclude")
    )
    return profile.withColumn("excluded_reason", reason).withColumn("qc_status", status)


def provenance_status(tier_: Column, status: Column, evidence: Column) -> Column:
    return (
        F.when((tier_ == "tier1") & (status != "none"), "invalid_tier1_contact")
        .when((tier_ == "tier1") & (F.trim(F.coalesce(evidence, F.lit(""))) == ""), "invalid_tier1_missing_evidence")
        .when(tier_ == "review_required", "review_required")
        .otherwise("ok")
    )


def merge_classes(cls: Column, mapping: Mapping[int, int]) -> Column:
    return lookup(mapping, cls, 0).cast("int")


def class_dimension(cells: DataFrame, cls: str) -> DataFrame:
    """Dense codes 1..C of the classes that occur, in class order."""
    d = cells.select(F.col(cls).alias("cls")).distinct().withColumn("_k", F.lit(1))
    return d.withColumn("code", F.dense_rank().over(W.partitionBy("_k").orderBy("cls"))).drop("_k")


def encode_classes(cells: DataFrame, dim: DataFrame, cls: str, out: str = "code") -> DataFrame:
    return join_small(cells, dim.select(F.col("cls").alias(cls), F.col("code").alias(out)), [cls])


def parcel_class(code: Column) -> Column:
    def starts(prefixes: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | code.startswith(p)
        return out

    return (
        F.when(starts(FARMLAND_PREFIXES), "farmland").when(starts(FOREST_PREFIXES), "forest")
        .when(starts(BARRIER_PREFIXES), "barrier").otherwise("other")
    )


def exact_code_class(code: Column, sets: Mapping[str, Sequence[str]], default: str) -> Column:
    out = F.lit(default)
    for name, codes in reversed(list(sets.items())):
        out = F.when(code.isin(list(codes)), name).otherwise(out)
    return out


def change_type(initial: Column, final: Column) -> Column:
    """1 farmland to forest, 2 forest to farmland, 0 otherwise."""
    return (
        F.when((initial == "farmland") & (final == "forest"), 1)
        .when((initial == "forest") & (final == "farmland"), 2)
        .otherwise(0)
    )


def bbox_grid_size(xmin: Column, ymin: Column, xmax: Column, ymax: Column, scale_m: int):
    """(width, height) in pixels of a lon/lat box at a metre scale."""
    lat = F.lit(METRES_PER_DEGREE)
    lon = F.greatest(F.lit(1.0), lat * F.cos(F.radians((ymin + ymax) / 2.0)))
    scale = F.lit(float(max(1, int(scale_m))))
    width = F.ceil(F.abs(xmax - xmin) * lon / scale)
    height = F.ceil(F.abs(ymax - ymin) * lat / scale)
    return F.greatest(F.lit(1), width).cast("bigint"), F.greatest(F.lit(1), height).cast("bigint")


# fixed values: macro-regions and their provinces
MACRO_REGIONS = {
    "华北": ("北京市", "天津市", "河北省", "山西省", "内蒙古自治区"),
    "东北": ("辽宁省", "吉林省", "黑龙江省"),
    "华东": ("上海市", "江苏省", "浙江省", "安徽省", "福建省", "江西省", "山东省", "台湾省"),
    "华中": ("河南省", "湖北省", "湖南省"),
    "华南": ("广东省", "广西壮族自治区", "海南省", "香港特别行政区", "澳门特别行政区"),
    "西南": ("重庆市", "四川省", "贵州省", "云南省", "西藏自治区"),
    "西北": ("陕西省", "甘肃省", "青海省", "宁夏回族自治区", "新疆维吾尔自治区"),
}
NO_REGION = "未分区"


def macro_region(province: Column) -> Column:
    return lookup({p: r for r, names in MACRO_REGIONS.items() for p in names}, province, NO_REGION)


def size_class(n_pixels: Column) -> Column:
    return F.when(n_pixels < 10_000, "small").when(n_pixels < 40_000, "medium").otherwise("large")


def in_sub_bbox(bbox: Sequence[float], sub: Sequence[float], height: Column, width: Column) -> Column:
    """Row/col window of a sub-box: floor on the low side, ceil on the high side, clipped."""
    minx, miny, maxx, maxy = map(float, bbox)
    dx = F.lit(maxx - minx) / width
    dy = F.lit(maxy - miny) / height
    c0 = F.greatest(F.lit(0), F.floor(F.lit(sub[0] - minx) / dx))
    c1 = F.least(width, F.ceil(F.lit(sub[2] - minx) / dx))
    r0 = F.greatest(F.lit(0), F.floor(F.lit(maxy - sub[3]) / dy))
    r1 = F.least(height, F.ceil(F.lit(maxy - sub[1]) / dy))
    return (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)


def cell_rectangles(cells: DataFrame, bbox: Sequence[float], height: Column, width: Column) -> DataFrame:
    """Corner coordinates of each cell, rounded to 6 decimals."""
    minx, miny, maxx, maxy = map(float, bbox)
    dx, dy = F.lit(maxx - minx) / width, F.lit(maxy - miny) / height
    x0 = F.lit(minx) + F.col("col") * dx
    y1 = F.lit(maxy) - F.col("row") * dy
    return cells.withColumns({
        "x0": F.round(x0, 6), "y0": F.round(y1 - dy, 6), "x1": F.round(x0 + dx, 6), "y1": F.round(y1, 6),
    })


def class_features(
    rects: DataFrame, keys: Sequence[str], cls: str, tile: int = 64
) -> DataFrame:
    """MultiPolygon JSON per class and tile, with the class count and percent of the area.

    A class of a huge area is split by tiles, so no value outgrows tile x tile cells.
    """
    ring = F.array(
        F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"),
        F.array("x0", "y0"),
    )
    counts = rects.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("pixel_count"))
    total = F.sum("pixel_count").over(W.partitionBy(*keys))
    counts = counts.withColumn("percentage", F.round(F.lit(100.0) * F.col("pixel_count") / total, 2))
    tiles = rects.groupBy(
        *keys, cls, F.floor(F.col("row") / tile).alias("tile_row"),
        F.floor(F.col("col") / tile).alias("tile_col"),
    ).agg(F.array_sort(F.collect_list(F.struct("row", "col", F.array(ring).alias("poly")))).alias("_p"))
    coords = F.transform("_p", lambda p: p["poly"])
    geom = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return tiles.withColumn("geometry", geom).drop("_p").join(counts, [*keys, cls])


NAME_GRAM = 4  # characters of the pieces by which names look for names that contain them


def _grams(name: Column, longest_only: bool) -> Column:
    """Distinct pieces of a name: of NAME_GRAM characters (or the whole of a shorter name), or of all lengths up to that."""
    n = F.length(name)

    def of(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(name, i, size))

    if longest_only:
        return F.array_distinct(of(F.least(n, F.lit(NAME_GRAM))))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(NAME_GRAM))), of)))


def contained_names(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Distinct (part, whole) of ``inner.part`` and ``outer.whole``, non-empty, where the part lies inside the whole.

    An inverted index of the wholes' pieces: each part probes with the one of its pieces that the fewest wholes have, and
    what it finds is verified. A part with a piece that no whole has is done.
    """
    parts = inner.select("part").filter("length(part) > 0").distinct()
    index = outer.select("whole").filter("length(whole) > 0").distinct().select("whole", F.explode(_grams(F.col("whole"), False)).alias("gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    probes = parts.select("part", F.explode(_grams(F.col("part"), True)).alias("gram")).join(held, "gram", "left").groupBy("part").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0")
    return probes.select("part", F.col("g.gram").alias("gram")).join(index, "gram").filter(F.contains("whole", "part")).select("part", "whole").distinct()


def match_class_names(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Class id by name: exact match first, then containment either way, lowest id first; an empty name lies in every name."""
    names = queries.select("query").distinct()
    known = classes.filter("cls_name is not null").select("cls", "cls_name")
    asked, told = names.select(F.col("query").alias("part")), known.select(F.col("cls_name").alias("whole"))
    pairs = contained_names(asked, told).select(F.col("part").alias("query"), F.col("whole").alias("cls_name")).unionByName(
        contained_names(told.withColumnRenamed("whole", "part"), asked.withColumnRenamed("part", "whole")).select(
            F.col("whole").alias("query"), F.col("part").alias("cls_name")))
    prio = F.min(F.struct(F.when(F.col("query") == F.col("cls_name"), 0).otherwise(1).alias("p"), F.col("cls").alias("c"))).alias("_m")
    best = pairs.distinct().join(known, "cls_name").groupBy("query").agg(prio)
    some = known.agg(  # names of no characters: the least class of all for an empty query, the least empty class for any
        F.min(F.struct(F.when(F.col("cls_name") == "", 0).otherwise(1).alias("p"), F.col("cls").alias("c"))).alias("_all"),
        F.min(F.when(F.col("cls_name") == "", F.struct(F.lit(1).alias("p"), F.col("cls").alias("c")))).alias("_blank"))
    out = attach_row(names.join(best, "query", "left"), some)
    found = F.when(F.col("query") == "", F.col("_all")).when(F.col("query").isNotNull(), F.least("_m", "_blank"))
    return out.select("query", found["c"].alias("cls"))


def one_hot_probability(
    cells: DataFrame, cls: str, classes: Sequence[int], confidence: float = 0.95, floor: float = 0.01
) -> DataFrame:
    """Long (cell, class, p): the own class gets the confidence, others the floor."""
    if len(classes) == 1:
        confidence = 1.0
    arr = F.array(*[
        F.struct(F.lit(int(c)).alias("p_cls"),
                 F.when(F.col(cls) == c, F.lit(confidence)).otherwise(F.lit(floor)).alias("p"))
        for c in classes
    ])
    return cells.select("*", F.inline(arr))


def class_probability(probs: str, cls: str) -> Column:
    """Probability of a class from a MAP column; 0 when absent."""
    return F.coalesce(F.try_element_at(F.col(probs), F.col(cls)), F.lit(0.0))


def grouped_bands(groups: Sequence[Sequence[str]]) -> Column:
    """Sum bands per group, clamped to 1."""
    sums = []
    for g in groups:
        total = F.col(g[0])
        for b in g[1:]:
            total = total + F.col(b)
        sums.append(F.least(F.lit(1.0), total) if len(g) > 1 else total)
    return F.array(*sums)


def argmax_label(p: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(p, F.array_max(p)).cast("int")


def scaled_probability(p: Column, scale: int = 10_000) -> Column:
    return F.transform(p, lambda x: F.round(x * scale).cast("int"))


def normalise_context(
    cells: DataFrame, keys: Sequence[str], elevation: str, slope: str, valid: Column
) -> DataFrame:
    """Elevation min-max scaled per area over valid cells (constant -> 0), slope/45 clipped."""
    e = F.col(elevation)
    lim = cells.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(valid, e)), F.min(e)).alias("_lo"),
        F.coalesce(F.max(F.when(valid, e)), F.max(e)).alias("_hi"),
    )
    j = join_small(cells, lim, keys, how="inner")
    span = F.col("_hi") - F.col("_lo")
    return j.withColumns({
        "elevation_norm": F.when(span > 0, (e - F.col("_lo")) / span).otherwise(0.0),
        "slope_norm": clamp(F.col(slope) / 45.0, 0.0, 1.0),
    }).drop("_lo", "_hi")


def reflectance(x: Column) -> Column:
    return clamp(x / 10_000.0, 0.0, 1.0)


def context_columns(mode: str, bands: Sequence[str]) -> list[str]:
    """Which context bands a mode uses: full, first only, or none."""
    if mode == "full":
        return list(bands)
    if mode == "no_slope":
        return list(bands[:1])
    if mode == "no_context":
        return []
    raise ValueError(f"unknown context mode: {mode}")


def exclude_terms(area: Column, terms: Sequence[str]) -> Column:
    """True when the lower-cased area contains any of the terms."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(area), F.lit(t.lower()))
    return out


def whitelist_split(cases: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Add ``reason`` (NULL = selected) against an optional area whitelist."""
    if allowed is None:
        return cases.withColumn("reason", F.lit(None).cast("string"))
    a = allowed.select("area").distinct().withColumn("_in", F.lit(True))
    j = cases.join(a, "area", "left")
    return j.withColumn("reason", F.when(F.col("_in").isNull(), "not_in_whitelist")).drop("_in")


def display_rectangles(
    cells: DataFrame, keys: Sequence[str], origin: tuple[float, float], cell: tuple[float, float],
    selected: Column,
) -> DataFrame:
    """Lon/lat rectangle with the row axis flipped, plus selection label."""
    top = cells.groupBy(*keys).agg(F.max("row").alias("_top"))
    j = join_small(cells, top, keys, how="inner")
    x0 = F.lit(origin[0]) + F.col("col") * F.lit(cell[0])
    y0 = F.lit(origin[1]) + (F.col("_top") - F.col("row")) * F.lit(cell[1])
    return j.withColumns({
        "min_lng": x0, "max_lng": x0 + F.lit(cell[0]), "min_lat": y0, "max_lat": y0 + F.lit(cell[1]),
        "selected_label": F.when(selected, "selected").otherwise("not_selected"),
    }).drop("_top")


# ---- joins -----------------------------------------------------------------

def align(start: DataFrame, end: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer alignment of three class tables (keys, row, col, cls)."""
    k = [*keys, "row", "col"]
    named = [d.select(*k, F.col("cls").alias(n)) for d, n in
             ((start, "start_cls"), (end, "end_cls"), (pred, "pred_cls"))]
    return named[0].join(named[1], k, "full_outer").join(named[2], k, "full_outer")


def co_register(aligned: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of keys whose three grids agree everywhere, and skip rows for the others."""
    cols = ("start_cls", "end_cls", "pred_cls")
    stats = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), *[F.count(c).alias(f"n_{c}") for c in cols]
    )
    bad = F.lit(False)
    for c in cols:
        bad = bad | (F.col(f"n_{c}") != F.col("n_all"))
    skip = stats.filter(bad).select(
        *keys, F.lit("shape_mismatch").alias("reason"),
        F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(f"n_{c}").cast("string")) for c in cols]).alias("message"),
    )
    good = join_small(aligned, stats.filter(~bad).select(*keys), keys, how="left_semi")
    return good, skip


def consecutive_years(
    cells: DataFrame, keys: Sequence[str], cols: Sequence[str], gap_free: bool = True
) -> DataFrame:
    """Pair each cell with the same cell in the area's next year.

    The next year is found on the small (area, year) table, then cells are
    equi-joined on the exact year.
    """
    pos = [*keys, "row", "col"]
    years = cells.select(*keys, "year").distinct()
    years = years.withColumn("next_year", F.lead("year").over(W.partitionBy(*keys).orderBy("year")))
    years = years.filter("next_year is not null")
    if gap_free:
        years = years.filter("next_year - year = 1")
    a = join_small(cells.select(*pos, "year", *cols), years, [*keys, "year"], how="inner")
    b = cells.select(*pos, F.col("year").alias("next_year"), *[F.col(c).alias(f"next_{c}") for c in cols])
    return a.join(b, [*pos, "next_year"])


def leave_one_area_out(counts: DataFrame, group: Sequence[str], area: str, on: Sequence[str]) -> DataFrame:
    """Per area: counts of all the other areas of its shape group (total minus own).

    ``counts`` is (group, area, on, n).  The pixel pairs of other areas are never
    expanded per target.
    """
    total = counts.groupBy(*group, *on).agg(F.sum("n").alias("_t"))
    scope = counts.select(*group, area).distinct()
    j = scope.join(total, list(group)) if group else attach_table(scope, total)
    j = j.join(counts, [*group, area, *on], "left")
    return j.select(
        *group, area, *on, (F.col("_t") - F.coalesce("n", F.lit(0))).cast("bigint").alias("n")
    ).filter("n > 0")


def pair_methods(
    metrics: DataFrame, keys: Sequence[str], challenger: str, baseline: str, cols: Sequence[str],
    recency: str | None = None,
) -> DataFrame:
    """Challenger and baseline values side by side; unmatched keys are dropped.

    With ``recency`` the row with the highest value of that column wins per key.
    """
    def value(method: str, c: str) -> Column:
        mine = F.col("method") == method
        if recency:
            return F.max_by(F.col(c), F.when(mine, F.col(recency)))
        return F.max(F.when(mine, F.col(c)))

    sides = (("challenger", challenger), ("baseline", baseline))
    wide = metrics.filter(F.col("method").isin(challenger, baseline)).groupBy(*keys).agg(
        *[value(m, c).alias(f"{p}_{c}") for p, m in sides for c in cols],
        F.max((F.col("method") == challenger).cast("int")).alias("_a"),
        F.max((F.col("method") == baseline).cast("int")).alias("_b"),
    )
    return wide.filter("_a = 1 and _b = 1").drop("_a", "_b")


def replicate_over_seeds(challenger: DataFrame, baseline: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Repeat deterministic challenger rows for every (seed, area) of the baseline."""
    seeds = baseline.select("seed", "area").distinct()
    return seeds.join(challenger.select("area", "method", *cols), "area").unionByName(
        baseline.select("seed", "area", "method", *cols)
    )


def missing_areas(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    return baseline.select("area").distinct().join(challenger.select("area"), "area", "left_anti")


def versus_reference(
    metrics: DataFrame, keys: Sequence[str], reference: str, cols: Sequence[str], lower: Sequence[str] = ()
) -> DataFrame:
    """Every method against one reference per key and metric, as advantage and win flag."""
    arr = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    long = metrics.select(*keys, "method", F.inline(arr))
    ref = long.filter(F.col("method") == reference).select(*keys, "metric", F.col("value").alias("ref_value"))
    j = long.filter(F.col("method") != reference).join(ref, [*keys, "metric"])
    sign = F.when(F.col("metric").isin(list(lower)), -1.0).otherwise(1.0)
    adv = sign * (F.col("value") - F.col("ref_value"))
    return j.withColumn("advantage", adv).withColumn("wins", F.col("advantage") > 0)


def common_areas(rows: DataFrame) -> DataFrame:
    """Areas every candidate covers, from (candidate, area) rows."""
    n = rows.agg(F.count_distinct("candidate").alias("_n"))
    per = rows.groupBy("area").agg(F.count_distinct("candidate").alias("n_candidates"))
    j = attach_row(per, n)
    return j.withColumn("is_common", F.col("n_candidates") == F.col("_n")).drop("_n")


def advantage_with_delta(advantage: DataFrame, delta: DataFrame) -> DataFrame:
    """(area, advantage, delta): mean advantage and mean accuracy delta of the areas that have both."""
    return advantage.groupBy("area").agg(F.avg("advantage").alias("advantage")).join(
        delta.groupBy("area").agg(F.avg("delta").alias("delta")), "area")


def common_extent(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both cell tables cropped to the smaller height and the smaller width of each key; keys of one side drop."""
    def ext(d: DataFrame, p: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.max("row").alias(f"{p}h"), F.max("col").alias(f"{p}w"))

    least = ext(a, "_a").join(ext(b, "_b"), list(keys)).select(
        *keys, F.least("_ah", "_bh").alias("_h"), F.least("_aw", "_bw").alias("_w"))
    return tuple(
        d.join(least, list(keys)).filter((F.col("row") <= F.col("_h")) & (F.col("col") <= F.col("_w"))).select(*d.columns)
        for d in (a, b))


def neighbour_pairs(cells: DataFrame, keys: Sequence[str], cols: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Each cell with each of its 4 (or 8) neighbours: (keys, row, col, cols, near_cols)."""
    steps = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (diagonal or not (y and x))]
    offs = F.array(*[F.struct(F.lit(y).alias("_dy"), F.lit(x).alias("_dx")) for y, x in steps])
    near = cells.select(*keys, "row", "col", *[F.col(c).alias(f"near_{c}") for c in cols], F.inline(offs)).select(
        *keys, (F.col("row") + F.col("_dy")).alias("row"), (F.col("col") + F.col("_dx")).alias("col"), *[f"near_{c}" for c in cols])
    return cells.select(*keys, "row", "col", *cols).join(near, [*keys, "row", "col"])


def by_code_prefix(rows: DataFrame, code: str, units: DataFrame, prefix: str, lengths: Sequence[int]) -> DataFrame:
    """Rows with the unit whose code is the longest prefix of theirs; one equi-join on the prefixes of ``lengths``."""
    known = units.select(F.col(prefix)).distinct()
    if len(lengths) == 1:
        return rows.withColumn(prefix, F.substring(code, 1, lengths[0])).join(known, prefix)
    tries = F.array_distinct(F.array(*[F.substring(code, 1, n) for n in lengths]))
    hit = rows.select(code).distinct().select(code, F.explode(tries).alias(prefix)).join(known, prefix).groupBy(code).agg(
        F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(hit, code)


def step_deltas(steps: DataFrame, units: DataFrame, keys: Sequence[str], unit: str, vec: str = "z") -> DataFrame:
    """Steps with ``delta_norm``, how far the vector of the chosen unit moves to its next year."""
    y = consecutive_years(units, keys, [vec]).withColumn("delta_norm", V.norm(V.subtract(f"next_{vec}", vec)))
    y = y.join(units.select(*keys, "year", "row", "col", unit), [*keys, "year", "row", "col"]) if unit not in y.columns else y
    return steps.join(y.select(*keys, "year", unit, "delta_norm"), [*keys, "year", unit])


def configuration_deltas(
    rows: DataFrame, mode: str, full: str, keys: Sequence[str], value: str, sd: str | None = None
) -> DataFrame:
    """Other configurations against ``full`` over the keys both have: (mode, keys, delta = full - other, full_sd)."""
    f = rows.filter(F.col(mode) == full).select(*keys, F.col(value).alias("_f"), *([F.col(sd).alias("full_sd")] if sd else []))
    j = rows.filter(F.col(mode) != full).join(f, list(keys))
    return j.select(mode, *keys, (F.col("_f") - F.col(value)).alias("delta"), *(["full_sd"] if sd else []))


def shape_status(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """'ok' or 'shape_mismatch:HxW_vs_HxW' per key."""
    def ext(d: DataFrame, p: str) -> DataFrame:
        return d.groupBy(*keys).agg(
            (F.max("row") + 1).alias(f"{p}h"), (F.max("col") + 1).alias(f"{p}w")
        )

    j = ext(a, "a").join(ext(b, "b"), list(keys))
    same = (F.col("ah") == F.col("bh")) & (F.col("aw") == F.col("bw"))
    text = F.format_string("shape_mismatch:%dx%d_vs_%dx%d", "ah", "aw", "bh", "bw")
    return j.select(*keys, F.when(same, F.lit("ok")).otherwise(text).alias("status"))


def manifest_match(registry: DataFrame, manifest: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left join on area; a registry year outside the manifest years voids the match."""
    m = manifest.select(F.lower("area").alias("_a"), "years", *cols)
    j = registry.join(m, F.lower(registry["area"]) == F.col("_a"), "left")
    ok = F.expr("array_contains(years, start_year) and array_contains(years, end_year)")
    return j.select(
        *registry.columns, F.coalesce(ok, F.lit(False)).alias("matched"),
        *[F.when(ok, F.col(c)).alias(c) for c in cols],
    )


def comparison_protocol(years: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First three years per key: (y0, y1) calibrates, (y1, y2) validates; too few is a status."""
    ys = years.groupBy(*keys).agg(F.array_sort(F.collect_set("year")).alias("_y"))
    rows = F.array(
        F.struct(F.lit("calibration").alias("role"), F.try_element_at("_y", F.lit(1)).alias("start_year"),
                 F.try_element_at("_y", F.lit(2)).alias("end_year")),
        F.struct(F.lit("validation").alias("role"), F.try_element_at("_y", F.lit(2)).alias("start_year"),
                 F.try_element_at("_y", F.lit(3)).alias("end_year")),
    )
    return ys.filter(F.size("_y") >= 3).select(*keys, F.inline(rows))
