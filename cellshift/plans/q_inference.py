"""Resampling and paired tests over the area table, with hash draws on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import steady_mean
from ..operators import inference as I
from . import bindings as B
from .q_summaries import deltas
from .registry import query, sql


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def r10(df, *names):
    return df.withColumns({n: F.round(n, 10) for n in names})


def unit(text):
    """DuckDB text of ``hash_unit``: first 8 hex digits of an md5 as a fraction."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def _boot(name, source, keys, cluster, value, n_boot, seed):
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join([f"c.{c}=s.{c}" for c in keys] + ["true"])
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""
{name}_c AS (SELECT {k}{cluster} AS cl, sum({value}) AS total, count({value}) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
{name}_i AS (SELECT *, row_number() OVER ({part}ORDER BY cl) AS i, count(*) OVER ({part}) AS k FROM {name}_c),
{name}_d AS (SELECT {k}b, floor({unit(f"'{seed}|' || b || '|' || i")} * k)::BIGINT + 1 AS d FROM {name}_i, (SELECT unnest(range(1, {n_boot + 1})) AS b)),
{name}_r AS (SELECT {"".join(f"s.{c}, " for c in keys)}b, sum(total)/sum(n) AS m FROM {name}_d s JOIN {name}_i c ON {on} AND c.i = s.d GROUP BY ALL),
{name} AS (SELECT {k}quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {name}_r {'GROUP BY ALL' if keys else ''}),
{name}_b AS (SELECT {k}count({value}) AS n_rows, count(DISTINCT {cluster}) AS n_clusters, avg({value}) AS mean, quantile_cont({value}, 0.5) AS median
 FROM {source} WHERE {value} IS NOT NULL {'GROUP BY ALL' if keys else ''})"""


_CI = """n_rows, n_clusters, round(mean, 10) AS mean, round(median, 10) AS median,
 CASE WHEN n_clusters>=2 THEN round(ci_low, 10) END AS ci_low, CASE WHEN n_clusters>=2 THEN round(ci_high, 10) END AS ci_high"""
CI_COLS = ("mean", "median", "ci_low", "ci_high")


@query("s01_bootstrap_mean", sql("adv", _boot("bt", "adv", ["tier"], "area", "primary_adv", 5000, 7),
       f"SELECT tier, {_CI} FROM bt JOIN bt_b USING (tier)"))
def s01(spark, sf):
    b = I.bootstrap_mean(B.advantages(spark, sf), ["tier"], "area", "primary_adv", 5000, 7)
    return r10(b, *CI_COLS)


@query("s02_cluster_bootstrap", sql("deltas", _boot("bt", "deltas", ["metric"], "area", "delta", 5000, 42),
       f"SELECT metric, {_CI} FROM bt JOIN bt_b USING (metric)"))
def s02(spark, sf):
    b = I.cluster_bootstrap(deltas(spark, sf), ["metric"], "area", "delta", 5000, 42)
    return r10(b, *CI_COLS)


@query("s03_leave_one_out_bootstrap", sql("adv", f"""
c AS (SELECT tier, area, primary_adv AS total, 1 AS n FROM adv WHERE primary_adv IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY area) AS i, count(*) OVER (PARTITION BY tier) AS k FROM c),
d AS (SELECT tier, b, floor({unit("'43|' || b || '|' || i")} * (k-1))::BIGINT + 1 AS d FROM i, (SELECT unnest(range(1, 1001)) AS b) WHERE i <= k-1),
x AS (SELECT d.tier, o.area AS dropped, b, CASE WHEN d.d >= o.i THEN d.d+1 ELSE d.d END AS pick FROM d JOIN i o ON o.tier=d.tier),
m AS (SELECT x.tier, dropped, b, sum(total)/sum(n) AS m FROM x JOIN i ON i.tier=x.tier AND i.i=pick GROUP BY ALL)""", """
SELECT tier, dropped, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY ALL"""))
def s03(spark, sf):
    out = I.leave_one_out_bootstrap(B.advantages(spark, sf), ["tier"], "area", "primary_adv", 1000, 43)
    return r6(out, "ci_low", "ci_high")


_SIGN = """
sg AS (SELECT metric, sum((delta>0)::INT)::BIGINT AS n_positive, sum((delta<0)::INT)::BIGINT AS n_negative, sum((delta=0)::INT)::BIGINT AS n_tie FROM deltas GROUP BY metric),
st AS (SELECT *, n_positive+n_negative AS n_effective, least(n_positive, n_negative) AS k FROM sg),
sp AS (SELECT *, CASE WHEN n_effective=0 THEN 1.0 ELSE least(1.0, 2*(SELECT sum(exp(lgamma(n_effective+1)-lgamma(i+1)-lgamma(n_effective-i+1)-n_effective*ln(2)))
 FROM (SELECT unnest(range(0, k+1)) AS i))) END AS p FROM st)"""


@query("s04_sign_test", sql("deltas", _SIGN, """
SELECT metric, n_positive, n_negative, n_tie, n_effective, round(p::DOUBLE, 6) AS p_value FROM sp"""))
def s04(spark, sf):
    return r6(I.sign_test(deltas(spark, sf), ["metric"], "delta"), "p_value")


@query("s05_permutation_test", sql("adv", """
o AS (SELECT tier, avg(primary_adv) AS observed, count(primary_adv) AS n FROM adv GROUP BY tier),
p AS (SELECT tier, b, round(avg(CASE WHEN substr(md5('11|' || b || '|' || area),1,1) < '8' THEN 1.0 ELSE -1.0 END * primary_adv), 12) AS m
 FROM adv, (SELECT unnest(range(1,5001)) AS b) WHERE primary_adv IS NOT NULL GROUP BY ALL)""", """
SELECT tier, round(any_value(observed), 6) AS observed, any_value(n) AS n, round(avg((abs(m) >= abs(round(observed, 12)))::INT), 6) AS p_value FROM p JOIN o USING (tier) GROUP BY tier"""))
def s05(spark, sf):
    p = I.permutation_test(B.advantages(spark, sf), ["tier"], "area", "primary_adv", 5000, 11)
    return r6(p, "observed", "p_value")


@query("s06_one_sample", sql("deltas", """
a AS (SELECT metric, count(delta) AS n, avg(delta) AS m, stddev_samp(delta) AS sd FROM deltas GROUP BY metric)""", """
SELECT metric, n, round(m, 6) AS mean, round(sd, 6) AS sd, round(sd/sqrt(n), 6) AS se, round(m/(sd/sqrt(n)), 6) AS t_stat, round(m/sd, 6) AS cohen_dz FROM a"""))
def s06(spark, sf):
    return r6(I.one_sample(deltas(spark, sf), ["metric"], "delta"), "mean", "sd", "se", "t_stat", "cohen_dz")


@query("s06_t_test")
def s06b(spark, sf):
    return r6(I.with_t_p_value(I.one_sample(deltas(spark, sf), ["metric"], "delta")), "t_stat", "t_p")


_WIL = """
wx AS (SELECT metric, delta, abs(delta) AS a FROM deltas WHERE delta<>0),
wr AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY a) + (count(*) OVER (PARTITION BY metric, a) - 1)/2.0 AS mid FROM wx),
wt AS (SELECT metric, sum(c*c*c-c) AS ties FROM (SELECT metric, a, count(*)::DOUBLE AS c FROM wx GROUP BY ALL) GROUP BY metric),
wl AS (SELECT metric, count(*) AS n, sum(CASE WHEN delta>0 THEN mid ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN delta<0 THEN mid ELSE 0 END)::DOUBLE AS w_minus FROM wr GROUP BY metric)"""


@query("s07_wilcoxon", sql("deltas", _WIL, "SELECT metric, n, w_plus, w_minus, ties FROM wl JOIN wt USING (metric)"))
def s07(spark, sf):
    return I.wilcoxon(deltas(spark, sf), ["metric"], "delta")


@query("s07_wilcoxon_p")
def s07b(spark, sf):
    return r6(I.with_wilcoxon_p(I.wilcoxon(deltas(spark, sf), ["metric"], "delta")), "wilcoxon_p")


@query("s08_paired_table", sql("deltas", _SIGN, _WIL, """
SELECT metric, (SELECT count(delta) FROM deltas d WHERE d.metric=sp.metric) AS n, round((SELECT avg(delta) FROM deltas d WHERE d.metric=sp.metric), 6) AS mean,
 round((SELECT stddev_samp(delta) FROM deltas d WHERE d.metric=sp.metric), 6) AS sd, n_positive, n_negative, n_tie, n_effective, round(p::DOUBLE, 6) AS sign_p, w_plus, w_minus
FROM sp LEFT JOIN wl USING (metric)"""))
def s08(spark, sf):
    return r6(I.paired_table(deltas(spark, sf), ["metric"], "delta"), "mean", "sd", "sign_p")


@query("s09_required_n", sql("deltas", """
a AS (SELECT metric, avg(delta)/stddev_samp(delta) AS dz FROM deltas GROUP BY metric)""", """
SELECT metric, round(dz, 6) AS cohen_dz, CASE WHEN dz<>0 THEN ceil(((1.959963984540054 + 0.8416212335729143)/dz)**2)::BIGINT ELSE -1 END AS required_n FROM a"""))
def s09(spark, sf):
    n = I.required_n(I.one_sample(deltas(spark, sf), ["metric"], "delta"))
    return r6(n, "cohen_dz").select("metric", "cohen_dz", "required_n")


@query("s10_gate_report", sql("adv", "t1 AS (SELECT * FROM adv WHERE tier='tier1')",
       _boot("bp", "t1", [], "area", "primary_adv", 5000, 5), _boot("bs", "t1", [], "area", "spatial_adv", 5000, 6),
       _boot("be", "(SELECT area, primary_adv - spatial_adv AS emb_adv FROM t1)", [], "area", "emb_adv", 5000, 7), """
ps AS (SELECT sum((m>0)::INT)::BIGINT AS positive_strata FROM (SELECT stratum, avg(primary_adv) AS m FROM t1 GROUP BY stratum))""", """
SELECT round(bp.ci_low, 6) AS primary_ci_low, round(bs.ci_low, 6) AS spatial_ci_low, round(be.ci_low, 6) AS embedding_ci_low,
 round(be.ci_high, 6) AS embedding_ci_high, positive_strata, coalesce(bp.ci_low>0, false) AS primary_gate_pass,
 coalesce(bs.ci_low>0, false) AS spatial_gate_pass, positive_strata>=3 AS strata_gate_pass,
 CASE WHEN bp.ci_low>0 AND bs.ci_low>0 AND positive_strata>=3 THEN 'pass' ELSE 'fail' END AS status FROM bp, bs, be, ps"""))
def s10(spark, sf):
    a = B.advantages(spark, sf).withColumn("emb_adv", F.col("primary_adv") - F.col("spatial_adv"))
    g = I.gate_report(a, "area", "primary_adv", "spatial_adv", "emb_adv", 5000, 5)
    return r6(g, "primary_ci_low", "spatial_ci_low", "embedding_ci_low", "embedding_ci_high")


@query("e19_intervals", sql("adv", "b AS (SELECT *, CASE WHEN area < 50 THEN 'first' ELSE 'second' END AS batch FROM adv WHERE stratum='stratum_2' AND tier='tier1')",
       _boot("bp", "b", ["batch"], "area", "primary_adv", 5000, 3), _boot("bs", "b", ["batch"], "area", "spatial_adv", 5000, 4), """
SELECT batch, round(bp.ci_low, 6) AS primary_ci_low, round(bs.ci_low, 6) AS spatial_ci_low FROM bp JOIN bs USING (batch)"""))
def e19c(spark, sf):
    from ..operators import summaries as S

    rows = B.advantages(spark, sf).withColumn("batch", F.expr("if(area < 50, 'first', 'second')"))
    return r6(S.stratum_intervals(rows, "stratum_2", "tier1", 5000, 3), "primary_ci_low", "spatial_ci_low")


@query("e25_matched_comparison", sql("deltas", "ad AS (SELECT metric, area, avg(delta*dir) AS advantage FROM deltas GROUP BY ALL)",
       _boot("bt", "ad", ["metric"], "area", "advantage", 5000, 9), """
SELECT metric, n_rows, n_clusters, round(mean, 8) AS mean, round(median, 8) AS median, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high,
 (SELECT sum((advantage>0)::INT) FROM ad a WHERE a.metric=bt.metric)::BIGINT AS n_positive,
 (SELECT sum((advantage<0)::INT) FROM ad a WHERE a.metric=bt.metric)::BIGINT AS n_negative FROM bt JOIN bt_b USING (metric)"""))
def e25(spark, sf):
    d = deltas(spark, sf)
    adv = d.groupBy("metric", "area").agg(
        steady_mean(F.when(F.col("higher"), F.col("delta")).otherwise(-F.col("delta"))).alias("advantage"))
    ci = I.cluster_bootstrap(adv, ["metric"], "area", "advantage", 5000, 9)
    sg = I.sign_test(adv, ["metric"], "advantage").select("metric", "n_positive", "n_negative")
    return ci.join(sg, "metric").withColumns({c: F.round(c, 8) for c in CI_COLS})


_ATT = """
u AS (SELECT l_orderkey % 97 / 97.0 AS ps, (l_linenumber % 2)::INT AS treated, l_extendedprice/10000.0 AS y FROM lineitem),
t AS (SELECT *, (ps>=0.05+0.9*1/5)::INT + (ps>=0.05+0.9*2/5)::INT + (ps>=0.05+0.9*3/5)::INT + (ps>=0.05+0.9*4/5)::INT AS stratum FROM u WHERE ps BETWEEN 0.05 AND 0.95),
s AS (SELECT stratum, sum((treated=1)::INT)::BIGINT AS n_treated, sum((treated=0)::INT)::BIGINT AS n_control, avg(y) FILTER (treated=1) AS treated_mean,
 avg(y) FILTER (treated=0) AS control_mean FROM t GROUP BY stratum)"""


def treated_units(spark, sf):
    return B.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 97 / 97.0D as ps", "cast(l_linenumber % 2 as int) as treated", "l_extendedprice/10000.0D as y")


@query("s11_stratified_effect", sql(_ATT, """
SELECT stratum, n_treated, n_control, round(treated_mean, 6) AS treated_mean, round(control_mean, 6) AS control_mean, round(treated_mean-control_mean, 6) AS effect FROM s"""))
def s11(spark, sf):
    s = I.stratified_effect(treated_units(spark, sf), "treated", "y", "ps")
    return r6(s, "treated_mean", "control_mean", "effect")


@query("s11_average_effect", sql(_ATT, """
SELECT sum(n_treated)::BIGINT AS n_treated, sum(n_control)::BIGINT AS n_control, count(treated_mean-control_mean) AS n_strata, round(avg(treated_mean-control_mean), 6) AS att,
 round(stddev_pop(treated_mean-control_mean)/sqrt(count(treated_mean-control_mean)), 6) AS se FROM s"""))
def s11b(spark, sf):
    s = I.stratified_effect(treated_units(spark, sf), "treated", "y", "ps")
    return r6(I.average_effect(s), "att", "se")


@query("s12_calibration_factor", sql("grid", """
d AS (SELECT area, 100.0*avg((pred_cls=3)::INT) - 100.0*avg((start_cls=3)::INT) AS predicted, 100.0*avg((end_cls=3)::INT) - 100.0*avg((start_cls=3)::INT) AS att FROM grid GROUP BY area)""", """
SELECT area, round(predicted::DOUBLE, 6) AS predicted, round(att::DOUBLE, 6) AS att, round(CASE WHEN abs(predicted)<0.01 THEN NULL ELSE least(5.0, greatest(0.1, att/predicted)) END::DOUBLE, 6) AS factor,
 abs(predicted)<0.01 AS small_effect FROM d"""))
def s12(spark, sf):
    pct = lambda c: F.lit(100.0) * F.avg((F.col(c) == 3).cast("int"))
    d = B.grid(spark, sf).groupBy("area").agg(
        (pct("pred_cls") - pct("start_cls")).alias("predicted"), (pct("end_cls") - pct("start_cls")).alias("att"))
    return r6(I.calibration_factor(d), "predicted", "att", "factor")


