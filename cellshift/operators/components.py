"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(pairs: DataFrame, keep: Column) -> DataFrame:
    """Link every neighbour ``v`` of ``u`` that ``keep`` selects to the least node around ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node id reachable. Nodes without an edge are not returned.

    Each round links all larger neighbours of a node to the least one it knows, then all smaller ones; the forest
    flattens to stars in a number of rounds that grows with the logarithm of the longest path, so there is no limit
    on rounds. NULL ends and loops are ignored, repeated edges count once, an empty table gives an empty result.
    """
    e = cut_lineage(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("p")).select(
            F.col("p.a").alias("u"), F.col("p.b").alias("v")).where("u <> v").distinct()
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
