"""Operators on per-cell embedding vectors (ARRAY columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from ..functions.columns import half_even, n_if, stable_hash
from .cells import consecutive_years
from .ranking import attach_row, group_agg, group_rank, group_stats, join_small

POS = ("row", "col")


def mean_cosine(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean cosine per key; zero-norm pairs are skipped, 0 when none is left."""
    return pairs.select(*keys, V.batch_cosine(a, b).alias("_s")).groupBy(*keys).agg(
        F.coalesce(F.avg("_s"), F.lit(0.0)).alias("mean_cosine"), F.count(F.lit(1)).alias("n")
    )


def mean_vector(cells: DataFrame, keys: Sequence[str], vec: Column, out: str = "mean_vec") -> DataFrame:
    """Element-wise mean per key, aggregated map-side as one vector buffer."""
    v = cells.select(*keys, array_to_vector(vec).alias("_v"))
    m = v.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return m.select(*keys, "n", vector_to_array("_m").alias(out))


def distance_profile(pairs: DataFrame, keys: Sequence[str], a: str, b: str, metric: str) -> DataFrame:
    """Mean, max, p95, p50 and population deviation of the cell distances."""
    d = pairs.select(*keys, V.batch_distance(a, b, metric).alias("_d"))
    aggs = [F.avg("_d").alias("mean"), F.max("_d").alias("max"), F.stddev_pop("_d").alias("std")]
    return group_agg(d, keys, aggs, "_d", {"p95": 0.95, "p50": 0.5})


def hotspots(pairs: DataFrame, keys: Sequence[str], a: str, b: str, metric: str, q: float = 0.9) -> DataFrame:
    """Cells at or above the q-quantile distance: count and percent."""
    d = pairs.select(*keys, V.batch_distance(a, b, metric).alias("_d"))
    st = group_stats(d, keys)
    cut = group_agg(d, keys, [], "_d", {"_t": q}, stats=st)
    j = join_small(d, cut, keys, st.groups, "inner")
    hot = n_if(F.col("_d") >= F.col("_t"))
    return j.groupBy(*keys).agg(
        hot.alias("hotspot_count"), F.round(F.lit(100.0) * hot / F.count(F.lit(1)), 2).alias("hotspot_pct")
    )


def prototypes(cells: DataFrame, keys: Sequence[str], cls: str, vec: str, min_cells: int = 20) -> DataFrame:
    """Normalised mean of unit vectors per class with at least ``min_cells`` cells."""
    m = mean_vector(cells, [*keys, cls], V.unit(vec), "_m").filter(F.col("n") >= min_cells)
    return m.select(*keys, F.col(cls).alias("cls"), "n", V.unit("_m").alias("prototype"))


def semantic_decode(
    cells: DataFrame, keys: Sequence[str], probs: str, vec: str, protos: DataFrame, strength: float = 24.0
) -> DataFrame:
    """argmax of ln(max(p, 1e-8)) + strength * cosine to the class prototype.

    ``probs`` is ARRAY<STRUCT<cls, p>> in class order; a class without prototype
    keeps ln p, and the first class wins ties.
    """
    packed = protos.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("cls", "prototype"))).alias("_proto")
    )
    c = join_small(cells, packed, keys)

    def scored(u: Column) -> Column:
        def score(x: Column) -> Column:
            p = F.ln(F.greatest(x["p"].cast("double"), F.lit(1e-8)))
            proto = F.try_element_at(F.col("_proto"), x["cls"])
            sim = F.coalesce(V.dot(u, proto), F.lit(0.0))
            return F.struct((p + F.lit(strength) * sim).alias("s"), (-x["cls"]).alias("c"))

        return F.array_max(F.transform(probs, score))

    best = V.let(V.unit(vec), scored)
    top = F.array_max(F.transform(probs, lambda x: F.struct(x["p"].alias("s"), (-x["cls"]).alias("c"))))
    return c.withColumns({"local_cls": -best["c"], "global_cls": -top["c"]}).drop("_proto")


def encoder_persistence(cells: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Mean cosine of consecutive years per area and start year."""
    return mean_cosine(consecutive_years(cells, keys, [vec]), [*keys, "year"], vec, f"next_{vec}")


def encoder_table(per_area: DataFrame, by: Sequence[str]) -> DataFrame:
    return per_area.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean_cosine").alias("mean"),
        F.coalesce(F.stddev_samp("mean_cosine"), F.lit(0.0)).alias("std"),
    )


def forecast_advantage(
    triples: DataFrame, keys: Sequence[str], start: str, end: str, forecast: str, q: float = 0.1
) -> DataFrame:
    """Persistence, model and advantage, overall and on the cells changing most.

    Changing cells lie below the q-quantile of persistence of their key.
    """
    d = triples.select(*keys, V.batch_cosine(start, end).alias("_p"), V.batch_cosine(forecast, end).alias("_m"))
    d = d.filter(F.col("_p").isNotNull())
    st = group_stats(d, keys)
    cut = group_agg(d, keys, [], "_p", {"_t": q}, stats=st)
    j = join_small(d, cut, keys, st.groups, "inner")
    low = F.col("_p") < F.col("_t")
    return j.groupBy(*keys).agg(
        F.avg("_p").alias("persistence"), F.avg("_m").alias("model"),
        (F.avg("_m") - F.avg("_p")).alias("advantage"),
        F.avg(F.when(low, F.col("_p"))).alias("changed_persistence"),
        F.avg(F.when(low, F.col("_m"))).alias("changed_model"),
        F.avg(F.when(low, F.col("_m") - F.col("_p"))).alias("changed_advantage"),
    )


def multistep(cells: DataFrame, forecasts: DataFrame, keys: Sequence[str], vec: str, fvec: str) -> DataFrame:
    """Per area and step: cosine to the previous year, to the forecast, and their difference.

    ``forecasts`` is (keys, year, row, col, fvec); step counts from the first year.
    """
    first = cells.groupBy(*keys).agg(F.min("year").alias("_y0"))
    y = consecutive_years(cells, keys, [vec])
    f = forecasts.withColumnRenamed("year", "next_year")
    j = y.join(f, [*keys, *POS, "next_year"])
    j = join_small(j, first, keys, how="inner").withColumn("step", F.col("next_year") - F.col("_y0"))
    nv = f"next_{vec}"
    j = j.select(*keys, "step", V.batch_cosine(vec, nv).alias("_p"), V.batch_cosine(fvec, nv).alias("_m"))
    return j.groupBy(*keys, "step").agg(
        F.avg("_p").alias("persistence"), F.avg("_m").alias("model"),
        (F.avg("_m") - F.avg("_p")).alias("advantage"),
    )


def decay(cells: DataFrame, keys: Sequence[str], vec: str, threshold: float = 0.95) -> DataFrame:
    """Cosine to the first year per step, with the share of changed cells and both means."""
    first = cells.groupBy(*keys).agg(F.min("year").alias("_y0"))
    c = join_small(cells, first, keys, how="inner")
    base = c.filter("year = _y0").select(*keys, *POS, F.col(vec).alias("_base"))
    j = c.filter("year > _y0").join(base, [*keys, *POS])
    j = j.select(*keys, (F.col("year") - F.col("_y0")).alias("step"), V.batch_cosine("_base", vec).alias("_s"))
    ch = F.col("_s") < threshold
    return j.groupBy(*keys, "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_cosine"),
        (n_if(ch) / F.count(F.lit(1))).alias("changed_share"),
        F.avg(F.when(ch, F.col("_s"))).alias("changed_mean"),
        F.avg(F.when(~ch, F.col("_s"))).alias("stable_mean"),
    )


def nearest_centre(units: DataFrame, centres: DataFrame, vec: str, block: int = 10_000) -> DataFrame:
    """Closest centre by cosine (lowest id wins ties).

    Centres (region, centre) are sent as array rows of at most ``block``; each block's best is compared with the last.
    """
    blocks = max(1, -(-centres.count() // block))
    unit = centres.withColumn("centre", V.unit("centre", 1e-12))
    j = units.withColumn("_best", F.lit(None).cast("struct<s:double,r:bigint>"))
    for i in range(blocks):
        part = unit if blocks == 1 else unit.filter(F.pmod(F.xxhash64("region"), F.lit(blocks)) == i)
        j = attach_row(j, part.agg(F.collect_list(F.struct("region", "centre")).alias("_c")))

        def closest(u: Column) -> Column:
            return F.array_max(F.transform("_c", lambda x: F.struct(
                V.dot(u, x["centre"]).alias("s"), (-x["region"]).cast("bigint").alias("r"))))

        j = j.withColumn("_best", F.greatest("_best", V.let(V.unit(vec, 1e-12), closest))).drop("_c")
    return j.withColumn("region", (-F.col("_best.r")).cast(centres.schema["region"].dataType)).drop("_best")


def region_sizes(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Units per region, empty regions included."""
    k = assigned.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    return centres.select("region").join(k, "region", "left").select(
        "region", F.coalesce("_n", F.lit(0)).alias("n_units")
    )


def region_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum("n_units").alias("n_units"),
        F.avg("n_units").alias("mean_units"), F.stddev_pop("n_units").alias("std_units"),
        F.min("n_units").alias("min_units"), F.max("n_units").alias("max_units"),
        n_if(F.col("n_units") == 0).alias("empty_regions"),
    )


def best_units(units: DataFrame, scores: dict[int, str], default: str) -> DataFrame:
    """Best unit per (region, scenario): scenario score column, else the default one."""
    arr = F.array(*[F.struct(F.lit(k).alias("scenario"), F.col(c).alias("score")) for k, c in {**scores, -1: default}.items()])
    long = units.select("region", "unit", F.inline(arr))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("unit").alias("u")))
    return long.groupBy("region", "scenario").agg(best.alias("_b")).select(
        "region", "scenario", F.col("_b.u").alias("unit")
    )


def translate_actions(actions: DataFrame, best: DataFrame, scenarios: Sequence[int]) -> DataFrame:
    """(region, scenario) actions -> unit; unknown scenarios use the default, empty regions unit 0."""
    sc = F.when(F.col("scenario").isin(list(scenarios)), F.col("scenario")).otherwise(-1)
    a = actions.withColumn("_s", sc)
    b = best.select("region", F.col("scenario").alias("_s"), F.col("unit").alias("_u"))
    return join_small(a, b, ["region", "_s"]).withColumn("unit", F.coalesce("_u", F.lit(0))).drop("_s", "_u")


def area_sample(cells: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most n hash-chosen cells per key."""
    order = [stable_hash(seed, *keys, *POS), *POS]
    return group_rank(cells, keys, order, "_rk").filter(F.col("_rk") <= n).drop("_rk")


def stratified_split(cells: DataFrame, cls: str, unit: Sequence[str], share: float, seed: int) -> DataFrame:
    """Drop classes with fewer than two rows; mark the training share of each class."""
    st = group_stats(cells, [cls])
    big = st.sizes.filter("n >= 2").select(cls, half_even(F.col("n") * F.lit(share)).alias("_k"))
    kept = join_small(cells, big, [cls], st.groups, "inner")
    ranked = group_rank(kept, [cls], [stable_hash(seed, *unit), *unit], "_rk", st)
    return ranked.withColumn("is_train", F.col("_rk") <= F.col("_k")).drop("_rk", "_k")


def region_embedding(cells: DataFrame, regions: DataFrame, vec: str, dim: int) -> DataFrame:
    """Mean vector per region; a zero vector for regions without cells."""
    m = mean_vector(cells, ["region"], F.col(vec), "_m")
    return regions.select("region").join(m, "region", "left").select(
        "region", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("_m", F.array_repeat(F.lit(0.0), dim)).alias("mean_vec"),
    )


def last_pair_advantage(
    cells: DataFrame, forecasts: DataFrame, keys: Sequence[str], vec: str, fvec: str
) -> DataFrame:
    """``forecast_advantage`` of the last consecutive year pair of each area only."""
    y = cells.select(*keys, "year").distinct()
    y = y.withColumn("_n", F.lead("year").over(W.partitionBy(*keys).orderBy("year"))).filter("_n - year = 1")
    last = y.groupBy(*keys).agg(F.max("year").alias("year"))
    pairs = consecutive_years(cells, keys, [vec])
    pairs = join_small(pairs, last, [*keys, "year"], how="left_semi")
    j = pairs.join(forecasts.withColumnRenamed("year", "next_year"), [*keys, *POS, "next_year"])
    return forecast_advantage(j, keys, vec, f"next_{vec}", fvec)


