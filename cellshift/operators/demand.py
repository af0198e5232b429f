"""Class demand: sources, rounding, blending, change budgets and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import half_even, n_if, ratio


class DemandError(ValueError):
    """A demand table or its constraints cannot be satisfied."""


def class_counts(cont: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys, cls, n) of one map, from the contingency table."""
    return cont.groupBy(*keys, F.col(col).alias("cls")).agg(F.sum("n").alias("n"))


def largest_remainder(expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole counts adding up to ``total`` from (keys, cls, expected, total).

    Floors first; a missing count goes to the largest remainders (ties: lowest
    class), a surplus comes off the smallest (ties: highest class).
    """
    w = W.partitionBy(*keys)
    base = F.floor("expected").cast("bigint")
    e = expected.withColumns({"_b": base, "_r": F.col("expected") - base})
    e = e.withColumn("_d", F.col("total") - F.sum("_b").over(w))
    up = F.row_number().over(w.orderBy(F.desc("_r"), "cls"))
    down = F.row_number().over(w.orderBy("_r", F.desc("cls")))
    e = e.withColumns({"_u": up, "_v": down})
    n = (
        F.when((F.col("_d") > 0) & (F.col("_u") <= F.col("_d")), F.col("_b") + 1)
        .when((F.col("_d") < 0) & (F.col("_v") <= -F.col("_d")) & (F.col("_b") > 0), F.col("_b") - 1)
        .otherwise(F.col("_b"))
    )
    return e.select(*keys, "cls", n.cast("bigint").alias("n"))


def _totals(cont: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cont.groupBy(*keys).agg(F.sum("n").alias("total"))


def _class_frame(cont: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Every (key, class) combination with the key's total."""
    return _totals(cont, keys).select(
        *keys, "total", F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("cls")
    )


def prior_demand(
    cont: DataFrame, keys: Sequence[str], prior: DataFrame, classes: Sequence[int]
) -> DataFrame:
    """Start counts pushed through the prior; a class without prior row stays."""
    if not classes:
        raise DemandError("classes must not be empty")
    known = [int(c) for c in classes]
    starts = class_counts(cont, keys, "start_cls").filter(F.col("cls").isin(known))
    pk = [k for k in keys if k in prior.columns]
    p = prior.filter(F.col("from_cls").isin(known) & F.col("to_cls").isin(known))
    row = p.groupBy(*pk, "from_cls").agg(F.sum("prior").alias("_rs")).filter("_rs > 0")
    p = p.join(row, [*pk, "from_cls"])
    j = starts.withColumnRenamed("cls", "from_cls").join(p, [*pk, "from_cls"], "left")
    flow = j.select(
        *keys, F.coalesce("to_cls", "from_cls").alias("cls"),
        F.coalesce(F.col("n") * (F.col("prior") / F.col("_rs")), F.col("n").cast("double")).alias("_e"),
    ).groupBy(*keys, "cls").agg(F.sum("_e").alias("expected"))
    frame = _class_frame(cont, keys, known).join(flow, [*keys, "cls"], "left")
    return largest_remainder(frame.withColumn("expected", F.coalesce("expected", F.lit(0.0))), keys)


def blend_demand(
    primary: DataFrame, secondary: DataFrame, cont: DataFrame, keys: Sequence[str],
    classes: Sequence[int], weight: float,
) -> DataFrame:
    """(1 - weight) * primary + weight * secondary, rounded to the total."""
    if not 0.0 <= weight <= 1.0:
        raise DemandError(f"weight must be in [0, 1]: {weight}")
    on = [*keys, "cls"]
    f = _class_frame(cont, keys, classes)
    j = f.join(primary.withColumnRenamed("n", "_p"), on, "left").join(
        secondary.withColumnRenamed("n", "_s"), on, "left"
    )
    e = F.lit(1.0 - weight) * F.coalesce("_p", F.lit(0)) + F.lit(weight) * F.coalesce("_s", F.lit(0))
    return largest_remainder(j.withColumn("expected", e), keys)


def should_blend(
    prior: DataFrame, predicted: DataFrame, cont: DataFrame, keys: Sequence[str], classes: Sequence[int],
    l1_threshold: float, change_high: float,
) -> DataFrame:
    """Per key: is the prior far from the prediction while predicted change is moderate?"""
    on = [*keys, "cls"]
    f = _class_frame(cont, keys, classes)
    j = f.join(prior.withColumnRenamed("n", "_p"), on, "left").join(
        predicted.withColumnRenamed("n", "_s"), on, "left"
    )
    l1 = j.groupBy(*keys, "total").agg(
        F.sum(F.abs(F.coalesce("_p", F.lit(0)) - F.coalesce("_s", F.lit(0)))).alias("_l1")
    )
    ch = cont.groupBy(*keys).agg(n_if(F.col("pred_cls") != F.col("start_cls"), F.col("n")).alias("_ch"))
    out = l1.join(ch, list(keys))
    a, b = ratio(F.col("_l1"), F.col("total")), ratio(F.col("_ch"), F.col("total"))
    return out.select(
        *keys, a.alias("l1_fraction"), b.alias("change_fraction"),
        ((a >= l1_threshold) & (b <= change_high)).alias("blend"),
    )


def derive_demand(
    cont: DataFrame, keys: Sequence[str], source: str, classes: Sequence[int] = (),
    prior: DataFrame | None = None, weight: float = 0.0, l1_threshold: float = 0.0, change_high: float = 1.0,
) -> DataFrame:
    """Demand (keys, cls, n) from a named source."""
    direct = {"observed_end": "end_cls", "prediction": "pred_cls", "start_persistence": "start_cls"}
    if source in direct:
        return class_counts(cont, keys, direct[source])
    if source not in ("transition_prior", "transition_prior_blend", "transition_prior_adaptive_blend"):
        raise DemandError(f"unsupported demand source: {source}")
    if prior is None or not classes:
        raise DemandError(f"{source} needs classes and a prior")
    p = prior_demand(cont, keys, prior, classes)
    if source == "transition_prior":
        return p
    pred = class_counts(cont, keys, "pred_cls")
    mixed = blend_demand(p, pred, cont, keys, classes, weight)
    if source == "transition_prior_blend":
        return mixed
    flag = should_blend(p, pred, cont, keys, classes, l1_threshold, change_high)
    j = p.join(mixed.withColumnRenamed("n", "_m"), [*keys, "cls"]).join(flag, list(keys))
    return j.select(*keys, "cls", F.when(F.col("blend"), F.col("_m")).otherwise(F.col("n")).alias("n"))


def minimum_budget(cont: DataFrame, keys: Sequence[str], demand: DataFrame) -> DataFrame:
    """Changes any allocation needs: sum of positive (demand - start) per class."""
    s = class_counts(cont, keys, "start_cls").withColumnRenamed("n", "_s")
    j = s.join(demand.withColumnRenamed("n", "_d"), [*keys, "cls"], "full_outer")
    gap = F.greatest(F.lit(0), F.coalesce("_d", F.lit(0)) - F.coalesce("_s", F.lit(0)))
    return j.groupBy(*keys).agg(F.sum(gap).cast("bigint").alias("min_budget"))


def gross_budget(cont: DataFrame, keys: Sequence[str], source: str, demand: DataFrame | None = None) -> DataFrame:
    """Changed cells of the chosen source (``none`` gives NULL)."""
    if source == "demand_delta":
        if demand is None:
            raise DemandError("demand_delta needs a demand table")
        return minimum_budget(cont, keys, demand).withColumnRenamed("min_budget", "budget")
    cols = {"prediction": "pred_cls", "observed_end": "end_cls"}
    if source == "none":
        return cont.groupBy(*keys).agg(F.lit(None).cast("bigint").alias("budget"))
    if source not in cols:
        raise DemandError(f"unsupported budget source: {source}")
    return cont.groupBy(*keys).agg(
        n_if(F.col(cols[source]) != F.col("start_cls"), F.col("n")).alias("budget")
    )


def change_budget(
    cont: DataFrame, keys: Sequence[str], demand: DataFrame, source: str, scale: Column | float = 1.0
) -> DataFrame:
    """max(minimum, round(gross * scale)) per key."""
    j = gross_budget(cont, keys, source, demand).join(minimum_budget(cont, keys, demand), list(keys))
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    scaled = F.greatest("min_budget", half_even(F.col("budget") * s))
    return j.withColumn("scaled_budget", F.when(F.col("budget").isNotNull(), scaled))


def budget_scale(
    features: DataFrame, base: float, adaptive: float | None, low: float, high: float,
    churn_scale: float | None, churn_high: float, hold_low: Column | None = None,
) -> DataFrame:
    """Scale per key from (budget, total, churn): churn first, then change fraction.

    ``hold_low`` keeps the base scale for low change fractions (set when the
    demand was blended).
    """
    if low < 0.0 or high > 1.0 or low >= high:
        raise DemandError(f"need 0 <= low < high <= 1: {low}, {high}")
    frac = ratio(F.col("budget"), F.col("total"))
    out = F.when(F.col("budget").isNull(), F.lit(base))
    if churn_scale is not None:
        out = out.when(F.col("churn") >= churn_high, F.lit(churn_scale))
    if adaptive is not None:
        out = out.when(frac >= high, F.lit(adaptive))
        low_ok = frac <= low if hold_low is None else (frac <= low) & ~hold_low
        out = out.when(low_ok, F.lit(adaptive))
    return features.withColumn("scale", out.otherwise(F.lit(base)))


def demand_violations(cont: DataFrame, keys: Sequence[str], demand: DataFrame) -> DataFrame:
    """Totals that differ from the cell count, and negative class demands."""
    d = demand.groupBy(*keys).agg(F.sum("n").alias("_d"))
    j = _totals(cont, keys).join(d, list(keys), "left")
    bad = j.filter(F.coalesce("_d", F.lit(0)) != F.col("total")).select(
        *keys, F.lit("total_mismatch").alias("reason"), F.coalesce("_d", F.lit(0)).alias("value")
    )
    neg = demand.filter("n < 0").select(*keys, F.lit("negative_class").alias("reason"), F.col("n").alias("value"))
    return bad.unionByName(neg)


def editable(start: Column, excluded: Column | None = None, immutable: Sequence[int] = ()) -> Column:
    out = F.lit(True) if excluded is None else ~excluded
    return out & ~start.isin([int(c) for c in immutable]) if immutable else out


def remaining_demand(cells: DataFrame, keys: Sequence[str], demand: DataFrame, can_edit: Column) -> DataFrame:
    """Demand left for editable cells; negative values are infeasible fixed classes."""
    fixed = cells.filter(~can_edit).groupBy(*keys, F.col("start_cls").alias("cls")).agg(
        F.count(F.lit(1)).alias("_f")
    )
    j = demand.join(fixed, [*keys, "cls"], "left")
    left = F.col("n") - F.coalesce("_f", F.lit(0))
    return j.select(*keys, "cls", left.cast("bigint").alias("remaining"), (left < 0).alias("infeasible"))


def markov_row(demand: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """One row per key with the demand of each class as type1..typeC."""
    return demand.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("cls") == int(c), F.col("n"))), F.lit(0)).alias(f"type{i}")
          for i, c in enumerate(classes, 1)]
    )
