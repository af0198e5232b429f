"""Views over the test tables, shaped like the package's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import steady_mean

WIDTH = 40
AREAS = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with start, end and predicted class and a score (class 0 = nodata)."""
    return table(spark, sf, "orders").selectExpr(
        f"cast(o_orderkey % {AREAS} as int) as area",
        f"cast((o_orderkey div {AREAS}) div {WIDTH} as int) as row",
        f"cast((o_orderkey div {AREAS}) % {WIDTH} as int) as col",
        "cast(o_custkey % 6 as int) as start_cls",
        "cast(if(o_orderstatus = 'F', o_custkey % 6, (o_custkey div 6) % 6) as int) as end_cls",
        f"cast(if(o_orderpriority < '3', o_custkey % 6, (o_custkey + o_orderkey div {AREAS}) % 6)"
        " as int) as pred_cls",
        "o_totalprice as score",
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free bag of pixels (no grid position)."""
    return table(spark, sf, "lineitem").selectExpr(
        "cast(l_suppkey % 16 as int) as area",
        "cast(ascii(l_returnflag) % 5 as int) as start_cls",
        "cast(cast(l_quantity as int) % 5 as int) as end_cls",
        "cast((cast(l_quantity as int) + l_linenumber) % 5 as int) as pred_cls",
        "l_extendedprice as score",
    )


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding cells: every 100 vectors are one year of two 5 x 10 areas."""
    return table(spark, sf, "embeddings").selectExpr(
        "cast(vec_id div 100 as int) as year",
        "cast((vec_id % 100) div 50 as int) as area",
        "cast((vec_id % 50) div 10 as int) as row",
        "cast(vec_id % 10 as int) as col",
        "cast(label as int) as cls",
        "embedding as z",
    )


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Method x seed x area metric values."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("method"),
        (F.col("user_id") % 5).cast("int").alias("seed"),
        F.get_json_object("props", "$.k").cast("int").alias("area"),
        F.col("event_id").alias("row_id"),
        F.col("user_id"),
        F.col("value"),
    )


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Area registry: stratum from the region, tier and contact status by key."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(
            "s_suppkey as area_id",
            "s_name as area",
            "n_name as nation",
            "r_name as stratum",
            "s_acctbal as value",
            "case s_suppkey % 4 when 0 then 'none' when 1 then 'known_contact'"
            " when 2 then 'unclear' else 'none' end as contact_status",
            "case when s_suppkey % 4 in (0, 3) then 'tier1' when s_suppkey % 4 = 1 then 'tier2'"
            " else 'review_required' end as tier",
        )
    )


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels: code from the part type, slope from size, area from price."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey as parcel_id",
        "case length(p_type) % 5 when 0 then '0111' when 1 then '0311' when 2 then '1003'"
        " when 3 then '0131' else '0321' end as dlbm",
        "p_brand as township",
        "cast(p_size as double) as slope",
        "p_retailprice as area_m2",
        "p_partkey div 20 as block_id",
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent parcel pairs (k, k+1) and (k, k+37) inside one district, src < dst."""
    p = table(spark, sf, "part").selectExpr(
        "p_partkey as k", "cast(substr(p_brand, 7) as int) % 5 as district"
    )
    src = p.select("district", F.col("k").alias("src"), F.explode(F.array(F.lit(1), F.lit(37))).alias("d"))
    src = src.select("district", "src", (F.col("src") + F.col("d")).alias("dst"))
    dst = p.select(F.col("k").alias("dst"), "district")
    return src.join(dst, ["dst", "district"]).select("src", "dst")


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered steps per user: policy, action, value."""
    return table(spark, sf, "events").selectExpr(
        "user_id as episode",
        "row_number() over (partition by user_id order by ts, event_id) as t",
        "event_type as policy",
        "value as reward",
        "cast(get_json_object(props, '$.k') as int) as action",
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """File catalog: labels, predictions, embeddings in two roots, contexts and others."""
    keys = "o_orderkey as k", "o_custkey % 60 as a", "2017 + o_orderkey % 8 as y"
    return table(spark, sf, "orders").selectExpr(*keys).selectExpr(
        """case k % 5
        when 0 then if((a + y) % 11 <> 0, concat('labels/area_', a, '_lulc_', y, '.npy'),
                       concat('labels/area_', a, '_lulc_x.npy'))
        when 1 then if(a % 7 <> 0, concat('predictions/area_', a, '_lulc_pred_', y, '_', y + 1, '.npy'),
                       concat('predictions/area_', a, '_forecast.npy'))
        when 2 then if((a * y) % 13 <> 0,
                       concat(if((k div 40) % 2 = 0, 'cache_a', 'cache_b'), '/area_', a, '_emb_', y, '.npy'),
                       concat('misc/area_', a, '.bin'))
        when 3 then if(a % 3 <> 0, concat('cache_a/area_', a, '_context.npy'), concat('misc/area_', a, '.ctx'))
        else concat('notes/', a, '.txt') end as path"""
    )


def triple(spark: SparkSession, sf: str) -> DataFrame:
    """Start, end and predicted grids with gaps: two areas lack cells on one side."""
    return grid(spark, sf).selectExpr(
        "area", "row", "col", "start_cls", "if(area = 5, null, end_cls) as end_cls",
        "case when area = 6 and row >= 3 then null when area = 7 then 3 else pred_cls end as pred_cls",
    )


METRICS = ("change_f1", "fom", "transition_accuracy", "allocation_disagreement")
LOWER = ("allocation_disagreement",)


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Four metrics per method, seed and area; the last one is better when lower."""
    v = F.col("value")
    return metric_rows(spark, sf).groupBy("method", "seed", "area").agg(
        (F.avg(v) / 500.0).alias("change_f1"), (F.max(v) / 500.0).alias("fom"),
        ((F.count(v) % 8) / 8.0).alias("transition_accuracy"),
        (F.min(v) / 500.0).alias("allocation_disagreement"),
    )


def advantages(spark: SparkSession, sf: str) -> DataFrame:
    """Advantage per area of 'click' over 'error', with tier and stratum."""
    from ..operators.summaries import seeded_deltas

    d = seeded_deltas(seeded(spark, sf), ["seed", "area"], "click", "error", METRICS, LOWER)
    avg = lambda m: steady_mean(F.when(F.col("metric") == m, F.col("delta")))
    return d.groupBy("area").agg(avg("change_f1").alias("primary_adv"), avg("fom").alias("spatial_adv")).selectExpr(
        "area", "if(area % 3 = 1, 'tier2', 'tier1') as tier", "concat('stratum_', area % 5) as stratum",
        "primary_adv", "spatial_adv",
    )
