"""Resampling and paired tests over areas, clusters and seeds.

Random draws are hash draws (``hash_unit``), so results repeat exactly whatever
the partitioning.  Replicates are rows; values are reduced to one row per
cluster before any replicate is made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.window import Window as W

from ..functions.columns import finite, hash_unit, n_if, stable_hash, steady_sum
from .ranking import attach_row, group_agg, group_rank, group_stats, join_small, value_positions

Z_975 = 1.959963984540054  # fixed values: normal quantiles at 0.975 and 0.80
Z_80 = 0.8416212335729143


CHUNK = 50  # replicates of a key that a task makes at once
DROPS = 256  # clusters of a key whose intervals a task makes at once
ARRAY_CLUSTERS = 20_000  # clusters of a key that one replicate draws from an array; more are joined by number


def clusters(rows: DataFrame, keys: Sequence[str], cluster: str, value: str) -> DataFrame:
    """(keys, cluster, total, n) of the finite values."""
    v = rows.withColumn("_v", finite(F.col(value))).filter(F.col("_v").isNotNull())
    v = v.filter(F.trim(F.col(cluster).cast("string")) != "")
    return v.groupBy(*keys, cluster).agg(steady_sum(F.col("_v")).alias("total"), F.count("_v").alias("n"))


def _indexed(cl: DataFrame, keys: Sequence[str], cluster: str) -> tuple[DataFrame, DataFrame, int]:
    """Number the clusters per key; also per-key sizes."""
    st = group_stats(cl, keys)
    idx = group_rank(cl, keys, [F.col(cluster)], "_i", st)
    return idx, st.sizes.withColumnRenamed("n", "_sz"), st.groups


def _draws(idx: DataFrame, sizes: DataFrame, groups: int, keys: Sequence[str], n_boot: int, seed, minus: int = 0) -> DataFrame:
    """One row per replicate and slot with the drawn cluster number (1-based)."""
    slots = join_small(idx.select(*keys, "_i"), sizes, keys, groups, "inner")
    if minus:
        slots = slots.filter(F.col("_i") <= F.col("_sz") - minus)
    reps = slots.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("_b"))
    u = hash_unit(seed, "_b", "_i")
    return reps.withColumn("_d", (F.floor(u * (F.col("_sz") - minus)) + 1).cast("bigint"))


def _packed(idx: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """One row per key: its clusters' totals (_t), sizes (_m) and ``more`` columns as arrays in cluster order."""
    one = F.struct("_i", F.col("total").cast("double").alias("t"), F.col("n").cast("double").alias("m"), *more)
    rows = idx.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    return rows.select(*keys, *(
        F.col(f"_all.{c}").alias(n) for c, n in (("t", "_t"), ("m", "_m"), *((c, c) for c in more))))


def _units(seed: int, replicate: int, n: int) -> np.ndarray:
    """``hash_unit(seed, replicate, i)`` for i = 1..n."""
    md5, head = hashlib.md5, f"{seed}|{replicate}|"
    return np.array([int(md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in range(1, n + 1)], float) / 4294967296.0


def _doubles(column: pa.Array, row: int) -> np.ndarray:
    return np.asarray(column[row].values, float)


def replicate_means(
    cl: DataFrame, keys: Sequence[str], cluster: str, n_boot: int, seed: int
) -> DataFrame:
    """Pooled mean per replicate: sum of drawn totals over sum of drawn sizes.

    A task takes a chunk of replicates of a key and its clusters as arrays; the draws of a replicate are made once for all
    keys of the batch.
    """
    keys = list(keys)
    idx, sizes, groups = _indexed(cl, keys, cluster)
    most = sizes.agg(F.max("_sz")).first()[0] or 0
    if most <= ARRAY_CLUSTERS:
        packed = _packed(idx, keys)
        chunks = packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK))))
        chunks = chunks.repartition((n_boot - 1) // CHUNK + 1, "_chunk")  # small rows, much work: a fixed number of tasks
        shape = StructType([packed.schema[k] for k in keys]).add("_b", "integer").add("mean", "double")

        def run(batches):
            chunk, units = None, {}
            for b in batches:
                t, m, at = (b.column(b.schema.get_field_index(c)) for c in ("_t", "_m", "_chunk"))
                row, rep, mean = [], [], []
                for r in range(b.num_rows):
                    total, size = _doubles(t, r), _doubles(m, r)
                    n, finite_all = len(total), bool(np.isfinite(total).all())
                    if at[r].as_py() != chunk:
                        chunk, units = at[r].as_py(), {}
                    for k in range(chunk * CHUNK + 1, min(chunk * CHUNK + CHUNK, n_boot) + 1):
                        if len(units.get(k, ())) < n:
                            units[k] = _units(seed, k, n)
                        d = (units[k][:n] * n).astype(np.int64)
                        row.append(r)
                        rep.append(k)
                        drawn = math.fsum(total[d].tolist()) if finite_all else total[d].sum()  # the same in any order
                        mean.append(drawn / size[d].sum())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(k)).take(take) for k in keys), pa.array(rep, pa.int32()), pa.array(mean, pa.float64())],
                    names=[*keys, "_b", "mean"])

        return chunks.mapInArrow(run, shape)
    draws = _draws(idx, sizes, groups, keys, n_boot, seed).select(*keys, "_b", F.col("_d").alias("_i"))
    # count repeated draws first, so each cluster is joined once per replicate
    tally = draws.groupBy(*keys, "_b", "_i").agg(F.count(F.lit(1)).alias("_c"))
    j = tally.join(idx, [*keys, "_i"])
    return j.groupBy(*keys, "_b").agg(
        (steady_sum(F.col("_c") * F.col("total")) / F.sum(F.col("_c") * F.col("n"))).alias("mean")
    )


def _between(ordered: Column, q: float) -> Column:
    """Interpolated quantile of a sorted array of replicates; between two equal ones it is that value to the last bit."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = (F.get(ordered, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def cluster_bootstrap(
    rows: DataFrame, keys: Sequence[str], cluster: str, value: str, n_boot: int = 5000, seed: int = 42
) -> DataFrame:
    """Mean and 2.5/97.5 % limits per key; fewer than two clusters give a NULL interval."""
    keys = list(keys)
    cl = clusters(rows, keys, cluster, value)
    base = cl.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"),
        (steady_sum(F.col("total")) / F.sum("n")).alias("mean"),
    )
    reps = replicate_means(cl, keys, cluster, n_boot, seed)
    ci = reps.groupBy(*keys).agg(F.array_sort(F.collect_list("mean")).alias("_r")).select(
        *keys, _between(F.col("_r"), 0.025).alias("ci_low"), _between(F.col("_r"), 0.975).alias("ci_high"))
    v = rows.withColumn("_v", finite(F.col(value))).filter(
        F.col("_v").isNotNull() & (F.trim(F.col(cluster).cast("string")) != "")
    )
    j = base.join(group_agg(v, keys, [], "_v", {"median": 0.5}), keys).join(ci, keys, "left")
    two = F.col("n_clusters") >= 2
    return j.withColumns({c: F.when(two, F.col(c)) for c in ("ci_low", "ci_high")})


def bootstrap_mean(rows: DataFrame, keys: Sequence[str], unit: str, value: str, n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """Bootstrap of the mean with single rows as the sampling unit (``unit`` is unique)."""
    return cluster_bootstrap(rows, keys, unit, value, n_boot, seed)


def leave_one_out_bootstrap(
    rows: DataFrame, keys: Sequence[str], cluster: str, value: str, n_boot: int, seed: int
) -> DataFrame:
    """Bootstrap interval with each cluster dropped in turn.

    All drops share the draws among k-1 slots: dropping cluster d moves the slots
    from d upwards by one.  Prefix sums over the counted draws then give every drop
    of a replicate at once, instead of k resamplings of k-1 clusters. A task takes a
    block of drops of a key with all replicates, so only the intervals leave it.
    """
    keys = list(keys)
    cl = clusters(rows, keys, cluster, value)
    idx, sizes, groups = _indexed(cl, keys, cluster)
    if (sizes.agg(F.max("_sz")).first()[0] or 0) <= ARRAY_CLUSTERS:
        packed = _packed(idx.withColumn("dropped", F.col(cluster)), keys, "dropped")
        last = F.greatest(F.lit(0), F.ceil(F.size("dropped") / F.lit(DROPS)).cast("int") - 1)
        blocks = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
        blocks = blocks.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys, "_block")
        shape = StructType([packed.schema[k] for k in keys]).add("dropped", packed.schema["dropped"].dataType.elementType)
        shape = shape.add("ci_low", "double").add("ci_high", "double")

        def run(batches):
            for b in batches:
                t, m, names, block = (b.column(b.schema.get_field_index(c)) for c in ("_t", "_m", "dropped", "_block"))
                for r in range(b.num_rows):
                    total, size = _doubles(t, r), _doubles(m, r)
                    n, first = len(total), block[r].as_py() * DROPS
                    if n < 2:
                        continue
                    to = min(first + DROPS, n)
                    means = np.empty((n_boot, to - first))
                    for k in range(n_boot):
                        c = np.bincount((_units(seed, k + 1, n - 1) * (n - 1)).astype(np.int64), minlength=n - 1)
                        sums = []
                        for v in (total, size):
                            below = np.concatenate([[0.0], np.cumsum(c * v[:-1])])  # slots before the dropped one as drawn
                            moved = np.concatenate([[0.0], np.cumsum(c * v[1:])])  # the others moved up by one
                            sums.append(below + (moved[-1] - moved))
                        means[k] = (sums[0] / sums[1])[first:to]
                    low, high = np.quantile(means, [0.025, 0.975], axis=0)
                    take = pa.array(np.full(to - first, r))
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(b.schema.get_field_index(x)).take(take) for x in keys), names[r].values.slice(first, to - first),
                         pa.array(low), pa.array(high)], names=shape.names)

        return blocks.mapInArrow(run, shape)
    draws = _draws(idx, sizes, groups, keys, n_boot, seed, minus=1)
    tally = draws.groupBy(*keys, "_b", F.col("_d").alias("_i")).agg(F.count(F.lit(1)).alias("_c"))
    slots = idx.select(*keys, "_i", cluster, "total", "n")
    after = slots.select(*keys, (F.col("_i") - 1).alias("_i"), F.col("total").alias("t1"), F.col("n").alias("n1"))
    slots = slots.join(after, [*keys, "_i"], "left")
    grid = slots.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("_b"))
    g = grid.join(tally, [*keys, "_b", "_i"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    w = W.partitionBy(*keys, "_b").orderBy("_i")
    below = w.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys, "_b")

    def pooled(own: str, moved: str) -> Column:
        """Slots before the dropped one as drawn, the others moved up by one."""
        a = F.col("_c") * F.col(own)
        b = F.col("_c") * F.coalesce(moved, F.lit(0))
        zero = F.lit(0)
        return F.coalesce(F.sum(a).over(below), zero) + (
            F.sum(b).over(every) - F.coalesce(F.sum(b).over(below), zero)
        )

    tot, cnt = pooled("total", "t1"), pooled("n", "n1")
    means = g.select(*keys, F.col(cluster).alias("dropped"), "_b", (tot / cnt).alias("mean"))
    return means.groupBy(*keys, "dropped").agg(
        F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high")
    )


@F.pandas_udf(DoubleType())
def _binomial_tail(n: pd.Series, k: pd.Series) -> pd.Series:
    """P(X <= k) for X ~ Binomial(n, 1/2), summed from logarithms in pieces of fixed size; one row per group."""
    out = []
    for trials, most in zip(n, k):
        last = trials * math.log(0.5)
        total = math.exp(last)
        for at in range(1, int(most) + 1, 1_000_000):
            i = np.arange(at, min(at + 1_000_000, int(most) + 1), dtype=np.float64)
            logs = last + np.cumsum(np.log((trials - i + 1) / i))
            total += float(np.exp(logs).sum())
            last = float(logs[-1])
        out.append(total)
    return pd.Series(out, dtype="float64")


def sign_test(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact two-sided sign test; ties are left out, p = 1 without untied values."""
    v = finite(F.col(value))
    a = rows.groupBy(*keys).agg(
        n_if(v > 0).alias("n_positive"), n_if(v < 0).alias("n_negative"), n_if(v == 0).alias("n_tie")
    )
    n = F.col("n_positive") + F.col("n_negative")
    k = F.least("n_positive", "n_negative")
    a = a.withColumn("n_effective", n)
    p = F.least(F.lit(1.0), 2.0 * _binomial_tail(F.col("n_effective"), k))
    return a.withColumn("p_value", F.when(F.col("n_effective") == 0, F.lit(1.0)).otherwise(p))


def permutation_test(
    rows: DataFrame, keys: Sequence[str], unit: str, value: str, n_perm: int = 1000, seed: int = 42
) -> DataFrame:
    """Sign-flip test of the mean: share of flipped means at least as far from zero."""
    v = rows.withColumn("_v", finite(F.col(value))).filter(F.col("_v").isNotNull())
    obs = v.groupBy(*keys).agg(F.avg("_v").alias("observed"), F.count("_v").alias("n"))
    flips = v.select(*keys, unit, "_v", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("_b"))
    sign = F.when(F.substring(stable_hash(seed, "_b", unit), 1, 1) < "8", 1.0).otherwise(-1.0)
    per = flips.groupBy(*keys, "_b").agg(F.round(F.avg(sign * F.col("_v")), 12).alias("_m"))
    j = per.join(obs, list(keys))
    far = F.abs("_m") >= F.abs(F.round("observed", 12))
    return j.groupBy(*keys).agg(
        F.first("observed").alias("observed"), F.first("n").alias("n"),
        F.avg(far.cast("double")).alias("p_value"),
    )


def one_sample(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, standard error, t and Cohen's dz."""
    v = finite(F.col(value))
    a = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")
    )
    a = a.withColumn("se", F.col("sd") / F.sqrt("n"))
    return a.withColumns({
        "t_stat": F.when(F.col("se") > 0, F.col("mean") / F.col("se")),
        "cohen_dz": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")),
    })


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(ln_front + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def with_t_p_value(summary: DataFrame) -> DataFrame:
    """Add ``t_p`` to the one-row-per-group output of ``one_sample``."""
    @F.pandas_udf(DoubleType())
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(
            [t_two_sided(a, b - 1) if pd.notna(a) and b > 1 else None for a, b in zip(t, n)], dtype="float64"
        )

    return summary.withColumn("t_p", p("t_stat", "n"))


def wilcoxon(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Signed-rank sums W+ and W- with mid-ranks (zeros dropped) and the tie correction.

    Equal absolute values are counted first, so ranks come from distinct values.
    """
    keys = list(keys)
    v = rows.withColumn("_x", finite(F.col(value))).filter("_x is not null and _x <> 0")
    v = v.withColumn("_a", F.abs("_x"))
    pos = value_positions(v, keys, "_a")
    signs = v.groupBy(*keys, F.col("_a").alias("_v")).agg(
        n_if(F.col("_x") > 0).alias("_p"), n_if(F.col("_x") < 0).alias("_q")
    )
    j = pos.join(signs, [*keys, "_v"])
    mid = (F.col("_first") + F.col("_last")) / 2.0
    m = F.col("_m").cast("double")
    return j.groupBy(*keys).agg(
        F.sum(F.col("_m")).alias("n"),
        F.sum(mid * F.col("_p")).alias("w_plus"), F.sum(mid * F.col("_q")).alias("w_minus"),
        F.sum(m * m * m - m).alias("ties"),
    )


def signed_rank_p(w: float, n: int, ties: float) -> float:
    """Two-sided p: exact for n <= 50 without ties, else the normal approximation."""
    if n == 0:
        return float("nan")
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2.0 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    z = (w - n * (n + 1) / 4.0) / math.sqrt(var)
    return math.erfc(abs(z) / math.sqrt(2.0))


def with_wilcoxon_p(summary: DataFrame) -> DataFrame:
    """Add ``wilcoxon_p`` to the one-row-per-group output of ``wilcoxon``."""
    @F.pandas_udf(DoubleType())
    def p(a: pd.Series, b: pd.Series, n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(min(x, y), int(k), q) for x, y, k, q in zip(a, b, n, t)], dtype="float64")

    return summary.withColumn("wilcoxon_p", p("w_plus", "w_minus", "n", "ties"))


def paired_table(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sign test, moments and signed-rank sums side by side per key (metric x control)."""
    keys = list(keys)
    s = sign_test(rows, keys, value).withColumnRenamed("p_value", "sign_p")
    o = one_sample(rows, keys, value).select(*keys, "n", "mean", "sd")
    w = wilcoxon(rows, keys, value).select(*keys, "w_plus", "w_minus")
    return o.join(s, keys).join(w, keys, "left")


def required_n(summary: DataFrame) -> DataFrame:
    """Sample size for 80 % power at two-sided 0.05; -1 when the effect is zero."""
    z = Z_975 + Z_80
    need = F.ceil(F.pow(F.lit(z) / F.col("cohen_dz"), 2)).cast("bigint")
    return summary.withColumn("required_n", F.when(F.col("cohen_dz") != 0, need).otherwise(-1))


def gate_report(
    rows: DataFrame, cluster: str, primary: str, spatial: str, embedding: str, n_boot: int, seed: int, need_strata: int = 3
) -> DataFrame:
    """Tier-1 intervals above zero and enough positive strata -> pass / fail / insufficient, with the three gates.

    The embedding interval is reported and gates nothing.
    """
    t1 = rows.filter("tier = 'tier1'").withColumn("_k", F.lit(1))
    p = cluster_bootstrap(t1, ["_k"], cluster, primary, n_boot, seed)
    s = cluster_bootstrap(t1, ["_k"], cluster, spatial, n_boot, seed + 1)
    e = cluster_bootstrap(t1, ["_k"], cluster, embedding, n_boot, seed + 2)
    v = finite(F.col(primary))
    strata = t1.groupBy("_k", "stratum").agg(F.avg(v).alias("_m")).groupBy("_k").agg(
        n_if(F.col("_m") > 0).alias("positive_strata")
    )
    j = attach_row(
        rows.agg(F.count(F.lit(1)).alias("n_rows")), p.select("n_clusters", F.col("ci_low").alias("primary_ci_low"))
    )
    j = attach_row(j, s.select(F.col("ci_low").alias("spatial_ci_low")))
    j = attach_row(j, e.select(F.col("ci_low").alias("embedding_ci_low"), F.col("ci_high").alias("embedding_ci_high")))
    j = attach_row(j, strata.select("positive_strata"))
    gates = {
        "primary_gate_pass": F.coalesce(F.col("primary_ci_low") > 0, F.lit(False)),
        "spatial_gate_pass": F.coalesce(F.col("spatial_ci_low") > 0, F.lit(False)),
        "strata_gate_pass": F.coalesce(F.col("positive_strata") >= need_strata, F.lit(False)),
    }
    ok = gates["primary_gate_pass"] & gates["spatial_gate_pass"] & gates["strata_gate_pass"]
    status = (
        F.when(F.col("n_clusters").isNull(), "insufficient_tier1")
        .when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    )
    return j.select(
        "primary_ci_low", "spatial_ci_low", "embedding_ci_low", "embedding_ci_high",
        F.coalesce("positive_strata", F.lit(0)).alias("positive_strata"), *[v.alias(k) for k, v in gates.items()],
        status.alias("status"),
    )


def stratified_effect(
    rows: DataFrame, treated: str, outcome: str, propensity: str, n_strata: int = 5,
    trim: tuple[float, float] = (0.05, 0.95),
) -> DataFrame:
    """Treated minus control outcome per equal-width band of the trimmed propensity."""
    lo, hi = trim
    p, t, y = F.col(propensity), F.col(treated) == 1, F.col(outcome)
    band = F.lit(0)
    for i in range(1, n_strata):
        band = band + (p >= F.lit(lo + (hi - lo) * i / n_strata)).cast("int")
    s = rows.filter(p.between(lo, hi)).groupBy(band.alias("stratum")).agg(
        n_if(t).alias("n_treated"), n_if(~t).alias("n_control"),
        F.avg(F.when(t, y)).alias("treated_mean"), F.avg(F.when(~t, y)).alias("control_mean"),
    )
    return s.withColumn("effect", F.col("treated_mean") - F.col("control_mean"))


def average_effect(strata: DataFrame) -> DataFrame:
    """Mean of the band differences and its standard error; 0 when a side has under 3 units."""
    e = strata.agg(
        F.coalesce(F.sum("n_treated"), F.lit(0)).alias("n_treated"),
        F.coalesce(F.sum("n_control"), F.lit(0)).alias("n_control"),
        F.count("effect").alias("n_strata"), F.avg("effect").alias("_m"), F.stddev_pop("effect").alias("_s"),
    )
    ok = (F.col("n_treated") >= 3) & (F.col("n_control") >= 3) & (F.col("n_strata") > 0)
    return e.select(
        "n_treated", "n_control", "n_strata", F.when(ok, F.col("_m")).otherwise(0.0).alias("att"),
        F.when(ok, F.col("_s") / F.sqrt("n_strata")).otherwise(0.0).alias("se"),
    )


def calibration_factor(effects: DataFrame, att: str = "att", predicted: str = "predicted") -> DataFrame:
    """ATT over predicted effect, clipped to [0.1, 5]; a tiny predicted effect gives NULL and a flag."""
    small = F.abs(F.col(predicted)) < 0.01
    f = F.least(F.lit(5.0), F.greatest(F.lit(0.1), F.col(att) / F.col(predicted)))
    return effects.withColumns({"factor": F.when(~small, f), "small_effect": small})
