"""Every registered query against DuckDB on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from harness import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    n, problems = compare(spark, con, entry.queries()[key], entry.oracle_sql().get(key), SF)
    assert not problems, problems


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


#: Queries that SQL can't state, with the test that holds each.
HELD_BY = {
    "f05_linear_forecast": "test_linear_forecast_matches_closed_form", "i12_restricted": "restricted", "s06_t_test": "t_p",
    "s07_wilcoxon_p": "wilcoxon", "s11_propensity": "test_propensity_and_regions_and_decoder",
    "v12_region_partition": "test_propensity_and_regions_and_decoder", "v17_decode": "test_propensity_and_regions_and_decoder",
    "v16_decoder_cv": "test_joint_fit_of_folds_equals_separate_fits", "v16_by_year": "test_joint_fit_of_folds_equals_separate_fits",
}


def test_every_query_has_a_statement_or_a_test():
    from cellshift.plans import load_queries

    queries, statements = load_queries()
    assert set(queries) - set(statements) == set(HELD_BY)
    text = open(os.path.join(os.path.dirname(__file__), "test_operators.py")).read()
    assert all(name in text for name in HELD_BY.values())


def test_no_orphan_statements():
    assert set(entry.oracle_sql()) <= set(entry.queries())
