"""Parcel, block and township operators on key and edge tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import n_if, ratio
from ..session import cut_lineage, discard, written
from . import components
from .cells import change_type, parcel_class
from .ranking import attach_row, group_agg, group_rank, group_stats, join_small

FARM, FOREST = "farmland", "forest"


def classified(parcels: DataFrame, code: str = "dlbm") -> DataFrame:
    return parcels.withColumn("kind", parcel_class(F.col(code)))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable over the edges; nodes without an edge are their own."""
    labels = components.connected_components(edges)
    return nodes.select("node").distinct().join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are in ``nodes``."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(
        n.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )


def swappable_components(parcels: DataFrame, edges: DataFrame, kinds: Sequence[str] = (FARM, FOREST)) -> DataFrame:
    nodes = classified(parcels).filter(F.col("kind").isin(list(kinds))).select(F.col("parcel_id").alias("node"))
    return connected_components(nodes, edges_within(edges, nodes)).withColumnRenamed("node", "parcel_id")


def farmland_patches(parcels: DataFrame, edges: DataFrame, min_area: float) -> DataFrame:
    """Contiguous farmland patches of at least ``min_area``: parcels and area."""
    comp = swappable_components(parcels, edges, (FARM,))
    p = parcels.join(comp, "parcel_id").groupBy("component").agg(
        F.count(F.lit(1)).alias("n_parcels"), F.sum("area_m2").alias("area_m2")
    )
    return p.filter(F.col("area_m2") >= min_area)


def bounded_clusters(nodes: DataFrame, edges: DataFrame, at: Sequence[str], most: int) -> DataFrame:
    """(node, cluster): connected clusters of at most ``most`` nodes, by merging neighbours; a cluster is its least node.

    Rounds of reciprocal nearest neighbours: of the adjacent clusters that fit together, each looks for the one of least
    merging cost (the growth of the squared distances to the centroid over the ``at`` columns); two that choose each other
    merge. Equal costs go by a hash of the two, so a chain of equal costs takes a logarithmic number of rounds. Two
    clusters that don't fit together never will, so their edges are dropped for good; the rest contract.
    """
    sums = [F.sum(x).alias(x) for x in at]
    size = written(nodes.select(F.col("node").alias("c"), F.lit(1).cast("bigint").alias("n"), *[F.col(x).cast("double").alias(x) for x in at]), "clusters")
    member = size.select(F.col("c").alias("node"), F.col("c").alias("cluster"))
    left = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    done: list[DataFrame] = []
    while True:
        one, two = (size.select(F.col("c").alias(k), F.col("n").alias(f"n_{k}"), *[F.col(x).alias(f"{x}_{k}") for x in at]) for k in ("a", "b"))
        fits = left.join(one, "a").join(two, "b").filter(F.col("n_a") + F.col("n_b") <= most)
        apart = sum((F.pow(F.col(f"{x}_a") / F.col("n_a") - F.col(f"{x}_b") / F.col("n_b"), 2.0) for x in at), F.lit(0.0))
        cost = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) * apart
        mark = F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")))
        costed = written(fits.select("a", "b", F.struct(cost.alias("cost"), mark.alias("mark"), "a", "b").alias("e")), "links")
        best = costed.select(F.explode(F.array("a", "b")).alias("c"), "e").groupBy("c").agg(F.min("e").alias("e"))
        merged = written(best.groupBy("e").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select(F.col("e.a").alias("to"), F.col("e.b").alias("c")), "merged")
        discard(*done)
        if merged.isEmpty():
            return member
        sizes = written(size.join(merged, "c", "left").select(F.coalesce("to", "c").alias("c"), "n", *at).groupBy("c").agg(
            F.sum("n").alias("n"), *sums), "clusters")
        members = written(member.join(merged.withColumnRenamed("c", "cluster"), "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")), "members")
        left = costed.select("a", "b")
        for k in ("a", "b"):
            left = left.join(merged.withColumnRenamed("c", k), k, "left").select(*(F.coalesce("to", k).alias(k) if c == k else F.col(c) for c in ("a", "b")))
        left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        discard(size, *([member] if done else []))
        size, member, done = sizes, members, [costed, merged]


def define_blocks(
    parcels: DataFrame, edges: DataFrame, at: Sequence[str], max_parcels: int = 30, min_parcels: int = 3,
    min_area: float = 5_000.0,
) -> DataFrame:
    """Blocks of swappable parcels: components, large ones cut into connected clusters, small ones dropped.

    A component of more than ``max_parcels`` falls into ``bounded_clusters`` over the coordinates ``at``; ``piece`` is the
    least parcel of the cluster. Every block is connected and has at most ``max_parcels`` parcels.
    """
    comp = cut_lineage(swappable_components(parcels, edges))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(comp.join(sizes.filter(F.col("_n") > max_parcels), "component", "left_semi"))
    nodes = parcels.join(large.select("parcel_id"), "parcel_id", "left_semi").select(F.col("parcel_id").alias("node"), *at)
    cut = bounded_clusters(nodes, edges_within(edges, nodes), at, max_parcels)
    placed = comp.join(cut.select(F.col("node").alias("parcel_id"), "cluster"), "parcel_id", "left").select(
        "parcel_id", "component", F.coalesce("cluster", "component").alias("piece"))
    r = parcels.join(placed, "parcel_id")
    b = r.groupBy("component", "piece").agg(
        F.count(F.lit(1)).alias("n_parcels"), F.sum("area_m2").alias("block_area")
    ).filter((F.col("n_parcels") >= min_parcels) & (F.col("block_area") >= min_area))
    b = group_rank(b.withColumn("_k", F.lit(1)), ["_k"], ["component", "piece"], "_id").withColumn(
        "block", (F.col("_id") - 1)
    ).drop("_k", "_id")
    return r.join(b, ["component", "piece"])


def farmland_neighbours(parcels: DataFrame, edges: DataFrame) -> DataFrame:
    """Parcels with the number of adjacent farmland parcels."""
    p = classified(parcels)
    farm = p.filter(F.col("kind") == FARM).select(F.col("parcel_id").alias("dst"))
    k = both_ways(edges).distinct().join(farm, "dst").groupBy(F.col("src").alias("parcel_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return p.join(k, "parcel_id", "left").withColumn("farm_neighbours", F.coalesce("_n", F.lit(0))).drop("_n")


def parcel_metrics(parcels: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area-weighted farmland slope, contiguity (mean farmland neighbours) and counts."""
    p = farmland_neighbours(parcels, edges)
    f = F.col("kind") == FARM
    w = F.sum(F.when(f, F.col("slope") * F.col("area_m2")).otherwise(0.0))
    a = F.sum(F.when(f, F.col("area_m2")).otherwise(0.0))
    return p.groupBy(*keys).agg(
        n_if(f).alias("n_farmland"), n_if(F.col("kind") == FOREST).alias("n_forest"),
        (w / F.greatest(a, F.lit(1e-8))).alias("avg_farmland_slope"),
        (n_if(f, F.col("farm_neighbours")) / F.greatest(n_if(f), F.lit(1))).alias("contiguity"),
    )


def block_adjacency(edges: DataFrame, parcels: DataFrame) -> DataFrame:
    """Distinct adjacent block pairs (b1 < b2) lifted from parcel adjacency."""
    m = parcels.select("parcel_id", "block_id").filter("block_id is not null")
    a = m.select(F.col("parcel_id").alias("src"), F.col("block_id").alias("_a"))
    b = m.select(F.col("parcel_id").alias("dst"), F.col("block_id").alias("_b"))
    j = edges.join(a, "src").join(b, "dst").filter("_a <> _b")
    return j.select(F.least("_a", "_b").alias("b1"), F.greatest("_a", "_b").alias("b2")).distinct()


def compactness(area: Column, perimeter: Column) -> Column:
    """Isoperimetric quotient; 0 without a perimeter."""
    return F.when(perimeter > 0, F.lit(4.0 * math.pi) * area / (perimeter * perimeter)).otherwise(0.0)


def block_features(
    parcels: DataFrame, edges: DataFrame, swaps: DataFrame, swaps_per_step: int, perimeters: DataFrame | None = None
) -> DataFrame:
    """Seventeen features per block, slopes scaled by the global range and areas by the largest block.

    ``swaps`` is (block_id, swaps); swapped parcels carry ``swapped`` = true.
    """
    p = classified(parcels)
    free = ~F.col("swapped")
    farm, forest = (F.col("kind") == FARM) & free, (F.col("kind") == FOREST) & free
    s, a = F.col("slope"), F.col("area_m2")
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    agg = p.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_parcels"), F.sum(a).alias("block_area"),
        total(farm, a).alias("farm_area"), total(farm, s * a).alias("_fw"), total(farm, s * s * a).alias("_fq"),
        F.max(F.when(farm, s)).alias("_top"), total(forest, a).alias("forest_area"),
        total(forest, s * a).alias("_ow"), F.min(F.when(forest, s)).alias("_low"),
        n_if(farm).alias("n_farm"), n_if(forest).alias("n_forest"),
        total(F.col("kind") == FARM, a).alias("all_farm_area"),
    )
    rng = p.agg(F.min(s).alias("smin"), (F.max(s) - F.min(s)).alias("srange"))
    top = agg.agg(F.max("block_area").alias("amax"))
    b = agg.join(swaps, "block_id", "left").withColumn("swaps", F.coalesce("swaps", F.lit(0)))
    b = attach_row(attach_row(b, rng), top)
    if perimeters is not None:
        b = b.join(perimeters, "block_id", "left").withColumn(
            "compactness", compactness(F.col("block_area"), F.coalesce("perimeter", F.lit(0.0)))
        )
    else:
        b = b.withColumn("compactness", F.lit(0.0))
    adj = both_ways(block_adjacency(edges, parcels).select(F.col("b1").alias("src"), F.col("b2").alias("dst")))
    other = b.select(F.col("block_id").alias("dst"), (F.col("swaps") > 0).alias("_inv"), F.col("all_farm_area").alias("_af"))
    nb = adj.join(other, "dst").groupBy(F.col("src").alias("block_id")).agg(
        F.count(F.lit(1)).alias("n_adj"), n_if(F.col("_inv")).alias("_ni"), F.sum("_af").alias("_na")
    )
    b = b.join(nb, "block_id", "left").fillna({"n_adj": 0, "_ni": 0, "_na": 0.0})
    avg_farm = ratio(F.col("_fw"), F.col("farm_area"))
    avg_for = ratio(F.col("_ow"), F.col("forest_area"))
    var = ratio(F.col("_fq"), F.col("farm_area")) - avg_farm * avg_farm
    has_farm, has_for = F.col("farm_area") > 0, F.col("forest_area") > 0
    hi = F.when(has_farm, F.col("_top")).otherwise(0.0)
    lo = F.when(has_for, F.col("_low")).otherwise(0.0)
    gain = F.when(has_farm & has_for, hi - lo).otherwise(0.0)
    sc = lambda x: (x - F.col("smin")) / F.col("srange")
    by = lambda x: x / F.col("amax")
    return b.select(
        "block_id", "n_parcels",
        sc(avg_farm).alias("f00_farm_slope"), sc(avg_for).alias("f01_forest_slope"),
        ((avg_farm - avg_for) / F.col("srange")).alias("f02_slope_gap"), (gain / F.col("srange")).alias("f03_best_gain"),
        (F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("srange")).alias("f04_farm_std"),
        sc(hi).alias("f05_top_farm"), sc(lo).alias("f06_bottom_forest"),
        by(F.col("farm_area")).alias("f07_farm_area"), by(F.col("forest_area")).alias("f08_forest_area"),
        (F.least("n_farm", "n_forest") / F.greatest("n_parcels", F.lit(1))).alias("f09_potential"),
        (F.col("swaps") / F.lit(max(swaps_per_step, 1))).alias("f10_swaps"), F.col("compactness").alias("f11_compactness"),
        by(F.col("block_area")).alias("f12_block_area"),
        ratio(F.col("_ni"), F.col("n_adj")).alias("f13_adjacent_invested"),
        F.when(F.col("n_adj") > 0, F.col("_na") / (F.col("amax") * F.col("n_adj"))).otherwise(0.0).alias("f14_adjacent_farm"),
        by(F.col("all_farm_area")).alias("f15_all_farm"), (F.col("swaps") > 0).cast("double").alias("f16_invested"),
    )


def township_rollup(parcels: DataFrame, swaps: DataFrame) -> DataFrame:
    """Blocks, swaps, invested blocks, weighted farmland slope and farmland area per township."""
    p = classified(parcels)
    f = F.col("kind") == FARM
    w = F.sum(F.when(f, F.col("slope") * F.col("area_m2")).otherwise(0.0))
    a = F.sum(F.when(f, F.col("area_m2")).otherwise(0.0))
    base = p.groupBy("township").agg(
        (w / F.greatest(a, F.lit(1e-8))).alias("avg_farmland_slope"), (a / 10_000.0).alias("farmland_ha")
    )
    blocks = p.select("township", "block_id").distinct().join(swaps, "block_id", "left").groupBy("township").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("swaps"), F.lit(0)).alias("swaps_used"),
        n_if(F.col("swaps") > 0).alias("blocks_invested"),
    )
    return base.join(blocks, "township")


def investment_spread(rollup: DataFrame) -> DataFrame:
    """Entropy of swaps over townships against its maximum, and the largest share."""
    r = attach_row(rollup, rollup.agg(F.sum("swaps_used").alias("_t"), F.count(F.lit(1)).alias("_n")))
    p = F.col("swaps_used") / (F.col("_t") + F.lit(1e-8))
    h = F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    return r.groupBy("_n").agg(F.sum(h).alias("_h"), F.max(p).alias("max_share")).select(
        (F.col("_h") / (F.ln(F.col("_n")) + F.lit(1e-8))).alias("entropy"), "max_share"
    )


def township_profile(parcels: DataFrame) -> DataFrame:
    """Shares, slopes and area statistics per township plus a total row ('ALL')."""
    p = classified(parcels)
    p = p.select("*", F.explode(F.array(F.col("township"), F.lit("ALL"))).alias("unit"))
    farm, forest = F.col("kind") == FARM, F.col("kind") == FOREST
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n_parcels"), (F.lit(100.0) * n_if(farm) / n).alias("farmland_pct"),
        (F.lit(100.0) * n_if(forest) / n).alias("forest_pct"),
        (F.lit(100.0) * n_if(farm | forest) / n).alias("swappable_pct"),
        F.avg(F.when(farm, F.col("slope"))).alias("farmland_slope"),
        F.avg(F.when(forest, F.col("slope"))).alias("forest_slope"),
        F.min("area_m2").alias("min_area"), F.max("area_m2").alias("max_area"), F.avg("area_m2").alias("mean_area"),
    ]
    return group_agg(p, ["unit"], aggs, "area_m2", {"median_area": 0.5})


def plan_score(
    cells: DataFrame, keys: Sequence[str], before: str, after: str, coherence: DataFrame, crop: int, tree: int,
    w_crop: float = 1.0, w_coherence: float = 1.0, w_forest: float = 1.0,
) -> DataFrame:
    """w1 * crop gain + w2 * coherence - w3 * forest loss over before/after maps."""
    d = cells.groupBy(*keys).agg(
        (n_if(F.col(after) == crop) - n_if(F.col(before) == crop)).alias("crop_change"),
        (n_if(F.col(after) == tree) - n_if(F.col(before) == tree)).alias("forest_change"),
    ).join(coherence, list(keys))
    score = (
        F.lit(w_crop) * F.col("crop_change") + F.lit(w_coherence) * F.col("coherence")
        - F.lit(w_forest) * F.greatest(F.lit(0), -F.col("forest_change"))
    )
    return d.withColumn("score", score)


def greedy_block_swaps(
    parcels: DataFrame, edges: DataFrame, max_swaps: int, farm_weight: float = 0.0, forest_weight: float = 0.0
) -> DataFrame:
    """Per block swap the steepest farmland with the flattest forest, up to ``max_swaps`` times while slope improves.

    After each swap the farmland-neighbour counts of the block's parcels are those of the new map, so later choices see
    earlier ones; a parcel is swapped once. Blocks do not see each other's swaps of the same step. One round per swap:
    the best parcel of each side is an aggregate per block, whatever its size.
    """
    p = farmland_neighbours(parcels, edges).filter(F.col("kind").isin(FARM, FOREST))
    left = cut_lineage(p.select("block_id", "parcel_id", "kind", "slope", F.col("farm_neighbours").cast("long").alias("nb")))
    home = parcels.select("parcel_id", "block_id")
    inner = cut_lineage(
        both_ways(edges).distinct().join(home.toDF("src", "block_id"), "src").join(home.toDF("dst", "_b"), "dst")
        .filter("block_id = _b").select("block_id", "src", "dst"))
    done = None
    for k in range(1, max_swaps + 1):
        farm = F.when(F.col("kind") == FARM, F.struct(
            (F.col("slope") - F.lit(farm_weight) * F.col("nb")).alias("o"), (-F.col("parcel_id")).alias("i"), F.col("slope").alias("s")))
        forest = F.when(F.col("kind") == FOREST, F.struct(
            (F.col("slope") - F.lit(forest_weight) * F.col("nb")).alias("o"), F.col("parcel_id").alias("i"), F.col("slope").alias("s")))
        best = left.groupBy("block_id").agg(F.max(farm).alias("_f"), F.min(forest).alias("_o"))
        pairs = cut_lineage(best.filter(F.col("_f.s") > F.col("_o.s")).select(
            "block_id", F.lit(k).alias("k"), (-F.col("_f.i")).alias("farm_parcel"), F.col("_f.s").alias("farm_slope"),
            F.col("_o.i").alias("forest_parcel"), F.col("_o.s").alias("forest_slope")))
        done = pairs if done is None else done.unionByName(pairs)
        if k == max_swaps or pairs.isEmpty():
            break
        moved = pairs.select("block_id", F.inline(F.array(
            F.struct(F.col("farm_parcel").alias("src"), F.lit(-1).alias("_d")), F.struct(F.col("forest_parcel").alias("src"), F.lit(1).alias("_d")))))
        change = moved.join(inner, ["block_id", "src"]).groupBy(F.col("dst").alias("parcel_id")).agg(F.sum("_d").alias("_d"))
        # a block without a pair is at its end
        left = cut_lineage(
            left.join(pairs.select("block_id"), "block_id", "left_semi")
            .join(moved.select(F.col("src").alias("parcel_id")), "parcel_id", "left_anti")
            .join(change, "parcel_id", "left")
            .select("block_id", "parcel_id", "kind", "slope", (F.col("nb") + F.coalesce("_d", F.lit(0))).alias("nb")))
    return done


def swappable_blocks(parcels: DataFrame) -> DataFrame:
    """Blocks with both farmland and forest."""
    p = classified(parcels)
    return p.groupBy("block_id").agg(
        n_if(F.col("kind") == FARM).alias("n_farmland"), n_if(F.col("kind") == FOREST).alias("n_forest")
    ).withColumn("swappable", (F.col("n_farmland") > 0) & (F.col("n_forest") > 0))


def change_layer(parcels: DataFrame, final: DataFrame) -> DataFrame:
    """Parcels whose kind changed, with the change code; ``final`` is (parcel_id, final_kind)."""
    j = classified(parcels).join(final, "parcel_id")
    j = j.withColumn("change", change_type(F.col("kind"), F.col("final_kind")))
    return j.filter(F.col("change") > 0)


def apply_swaps(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(parcel_id, final_kind) after exchanging the kinds of the swapped pairs."""
    f = pairs.select(F.col("farm_parcel").alias("parcel_id"), F.lit(FOREST).alias("_k"))
    o = pairs.select(F.col("forest_parcel").alias("parcel_id"), F.lit(FARM).alias("_k"))
    return classified(parcels).join(f.unionByName(o), "parcel_id", "left").select(
        "parcel_id", F.coalesce("_k", "kind").alias("final_kind")
    )
