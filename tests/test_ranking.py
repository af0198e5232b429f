"""Sliced ranks and quantiles must equal plain ones, also for one dominating group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellshift.operators.ranking import group_agg, group_rank, group_stats, join_small, value_positions


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    area = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 30, n))
    score = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.random(n), 3))
    rows = [(int(a), int(i), float(s)) for i, (a, s) in enumerate(zip(area, score))]
    return spark.createDataFrame(rows, "area int, id int, score double").cache()


def test_sliced_rank_is_exact(skewed):
    plain = group_rank(skewed, ["area"], [-F.col("score"), "id"], "a")
    st = group_stats(skewed, ["area"], limit=200)
    assert st.slices > 10
    sliced = group_rank(skewed, ["area"], [-F.col("score"), "id"], "b", st)
    j = plain.join(sliced.select("id", "b"), "id")
    assert j.count() == 6000
    assert j.filter("a <> b").count() == 0


def test_sliced_rank_takes_columns_of_any_name(skewed):
    wide = skewed.withColumns({"_b": F.col("id"), "_t": F.lit(1), "_slice": F.lit(2), "_n": F.lit(3), "_o0": F.lit(4)})
    plain = group_rank(wide, ["area"], [-F.col("score"), "_b"], "a").select("id", "a")
    sliced = group_rank(wide, ["area"], [-F.col("score"), "_b"], "b", limit=200)
    assert sliced.columns == [*wide.columns, "b"]
    assert sliced.join(plain, "id").filter("a = b and _slice = 2").count() == 6000


def test_slices_bound_the_window_groups(skewed):
    """No window partition of the sliced plan holds the hot group."""
    st = group_stats(skewed, ["area"], limit=200)
    sliced = group_rank(skewed, ["area"], ["score", "id"], "b", st)
    plan = sliced._jdf.queryExecution().toString()
    assert "_slice" in plan


def test_sliced_quantiles(skewed):
    q = {"q10": 0.1, "q50": 0.5, "q95": 0.95}
    plain = {r["area"]: r for r in group_agg(skewed, ["area"], [F.count("*").alias("n")], "score", q).collect()}
    sliced = {r["area"]: r for r in group_agg(skewed, ["area"], [F.count("*").alias("n")], "score", q, limit=100).collect()}
    assert plain.keys() == sliced.keys()
    for a, r in plain.items():
        assert r["n"] == sliced[a]["n"]
        for c in q:
            assert r[c] == pytest.approx(sliced[a][c], abs=1e-12)


def test_value_positions(spark):
    df = spark.createDataFrame([(1, v) for v in [2.0, 1.0, 2.0, 5.0]], "k int, v double")
    rows = sorted(tuple(r)[1:] for r in value_positions(df, ["k"], "v").collect())
    assert rows == [(1.0, 1, 1, 1), (2.0, 2, 2, 3), (5.0, 1, 4, 4)]


def test_join_small_broadcasts_only_below_the_bound(spark, monkeypatch):
    import cellshift.operators.ranking as R

    a = spark.range(1000).selectExpr("id % 7 as k", "id")
    b = spark.range(7).selectExpr("id as k", "id * 2 as v")
    plan = join_small(a, b, ["k"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", 3)
    plan = R.join_small(a, b, ["k"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
