"""Queries that take whole tables: no rows are filtered away before the operator."""

import __spark_entry__ as entry
from cellshift.plans import bindings as B

SF = "/root/testdata/sf0.01"


def test_read_holdouts_of_all_areas(spark):
    got = [r.area for r in entry.queries()["a07_read_holdouts"](spark, SF).select("area").collect()]
    assert sorted(got) == sorted(f"area_{r.area_id}" for r in B.areas(spark, SF).select("area_id").collect())


def test_violations_of_all_seeds(spark):
    rows = B.metric_rows(spark, SF).groupBy("method", "area").count().where("count > 1").collect()
    got = entry.queries()["a20_candidate_violations"](spark, SF).where("reason = 'duplicate_area'").collect()
    assert {(r.candidate, r.area) for r in got} == {(r.method, str(r.area)) for r in rows}


def test_disclosure_of_all_recorded_steps(spark):
    from cellshift.plans.q_summaries import step_rows

    known = {r.area for r in B.advantages(spark, SF).select("area").collect()}
    steps = {(r.area, r.step) for r in step_rows(spark, SF).collect() if r.area in known}
    got = entry.queries()["e24_multistep_disclosure"](spark, SF).where("status = 'recorded'").collect()
    assert {(r.area, r.step) for r in got} == steps and any(a % 4 != 1 for a, _ in steps)
