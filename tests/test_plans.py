"""Plan shapes that must hold at scale."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, key):
    return entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "d06_method_metrics", "d13_transition_matrix", "d24_pair_evidence", "e01_summary_by_scope", "e08_cross_area_summary",
    "f03_transition_prior_map", "g01_keep_fraction", "g02_sweep_fractions", "h07_best_shift", "i05_adaptive_blend",
    "j08_threshold_rules", "j10_conjunctive_rules", "s02_cluster_bootstrap", "v13_nearest_centre",
])
def test_no_cross_joins(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "d06_method_metrics")
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schema and all("o_totalprice" not in s for s in schema)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey < 10").select("o_orderkey")
    assert "LessThan(o_orderkey,10)" in df._jdf.queryExecution().executedPlan().toString()


def test_neighbourhood_takes_one_shuffle(spark):
    text = plan(spark, "h02_class_aligned_support")
    assert len(re.findall(r"\bExchange hashpartitioning|\bExchange \(|Exchange hash", text)) == 1


def test_contingency_is_combined_before_the_shuffle(spark):
    text = plan(spark, "d01_binary_change")
    assert text.count("partial_count(1)") == 1


def test_python_stays_out_of_sql_operators(spark):
    for key in ("h05_latent_affinity", "v07_semantic_decode", "g08_demand_gate"):
        assert "Python" not in plan(spark, key)
