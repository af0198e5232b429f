"""Small cases with known answers, and brute-force comparisons."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cellshift.functions import columns as K
from cellshift.operators import allocation as A
from cellshift.operators import baselines as Z
from cellshift.operators import cells as C
from cellshift.operators import demand as D
from cellshift.operators import flow as FL
from cellshift.operators import gates as G
from cellshift.operators import inference as I
from cellshift.operators import mapmetrics as M
from cellshift.operators import neighbourhood as H
from cellshift.operators import parcels as P
from cellshift.operators import selection as J
from cellshift.operators import summaries as S
from cellshift.operators.ranking import group_stats
from cellshift.sources import catalog as CAT


def triple(spark, start, end, pred, area=0):
    rows = [
        (area, r, c, int(start[r][c]), int(end[r][c]), int(pred[r][c]))
        for r in range(len(start)) for c in range(len(start[0]))
    ]
    return spark.createDataFrame(rows, "area int, row int, col int, start_cls int, end_cls int, pred_cls int")


def one(df):
    return df.collect()[0].asDict()


# ---- metrics -------------------------------------------------------------------

@pytest.mark.parametrize("start,end,pred,metric,value", [
    ([[1, 1], [2, 2]], [[1, 2], [2, 3]], [[1, 2], [3, 2]], "fom", 1 / 3),
    ([[1]], [[2]], [[3]], "fom", 0.0),
    ([[1]], [[1]], [[1]], "fom", 1.0),
    ([[1, 1], [2, 2]], [[1, 2], [2, 3]], [[1, 2], [2, 2]], "transition_accuracy", 0.5),
    ([[1, 1]], [[1, 1]], [[1, 2]], "transition_accuracy", 1.0),
    ([[1, 1], [2, 2]], [[1, 1], [2, 2]], [[1, 2], [2, 2]], "quantity_disagreement", 0.25),
    ([[1, 1], [2, 2]], [[1, 1], [2, 2]], [[1, 2], [2, 2]], "allocation_disagreement", 0.0),
    ([[1, 2], [2, 1]], [[1, 2], [2, 1]], [[2, 1], [1, 2]], "quantity_disagreement", 0.0),
    ([[1, 2], [2, 1]], [[1, 2], [2, 1]], [[2, 1], [1, 2]], "allocation_disagreement", 1.0),
])
def test_metric_cases(spark, start, end, pred, metric, value):
    row = one(M.metric_row(M.contingency(triple(spark, start, end, pred), ["area"]), ["area"]))
    assert row[metric] == pytest.approx(value)


def test_dialects_differ_on_empty_change(spark):
    cont = M.contingency(triple(spark, [[1]], [[1]], [[1]]), ["area"])
    assert one(M.metric_row(cont, ["area"]))["fom"] == 1.0
    assert one(M.variant_metrics(cont, ["area"]))["fom"] == 0.0
    assert one(M.validation_row(cont, ["area"]))["changed_cell_accuracy"] == 0.0


def test_half_even_and_finite(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(K.half_even(F.col("x"))).collect()] == [0, 2, 2]
    s = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "t string")
    assert [r[0] for r in s.select(K.finite(F.col("t"))).collect()] == [1.5, None, None, None, None]


# ---- neighbourhoods --------------------------------------------------------------

@pytest.fixture(scope="module")
def holes(spark):
    """A random grid with missing cells."""
    rng = np.random.default_rng(5)
    grid = {(r, c): (int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(0, 4)))
            for r in range(9) for c in range(8) if rng.random() > 0.2}
    rows = [(0, r, c, *v) for (r, c), v in grid.items()]
    df = spark.createDataFrame(rows, "area int, row int, col int, start_cls int, end_cls int, pred_cls int")
    return grid, df.cache()


def test_support_with_missing_cells(holes):
    grid, df = holes
    got = {(r["row"], r["col"]): r for r in H.class_support(df, ["area"], range(4), (3, 5)).collect()}
    for (r, c), (s, _, p) in grid.items():
        want_t = want_s = 0.0
        for rad in (1, 2):
            near = [grid[q] for q in itertools.product(range(r - rad, r + rad + 1), range(c - rad, c + rad + 1))
                    if q in grid and q != (r, c)]
            if near:
                want_t += sum(x[0] == p for x in near) / len(near) / 2
                want_s += sum(x[0] == s for x in near) / len(near) / 2
        assert got[r, c]["target_support"] == pytest.approx(want_t)
        assert got[r, c]["source_support"] == pytest.approx(want_s)


def test_distance_affinity_brute_force(holes):
    grid, df = holes
    got = {(x["row"], x["col"], x["nb_cls"]): x["affinity"]
           for x in H.distance_affinity(df, ["area"], "start_cls", range(4), 3).collect()}
    want = {}
    for (r, c), _ in grid.items():
        for k in range(4):
            d = [max(abs(a - r), abs(b - c)) for (a, b), v in grid.items() if v[0] == k]
            if d and min(d) <= 3:
                want[r, c, k] = (4 - min(d)) / 4
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_best_shift_brute_force(holes):
    grid, df = holes
    h, w = max(r for r, _ in grid) + 1, max(c for _, c in grid) + 1
    true = {q for q, v in grid.items() if v[1] != v[0]}
    pred = {q for q, v in grid.items() if v[2] != v[0]}

    def f1(dy, dx):
        moved = {(r + dy, c + dx) for r, c in pred if 0 <= r + dy < h and 0 <= c + dx < w}
        tp = len(true & moved)
        return 2 * tp / (len(true) + len(moved)) if tp else 0.0

    best = min(itertools.product(range(-2, 3), range(-2, 3)), key=lambda s: (-round(f1(*s), 12), s != (0, 0), s))
    row = one(H.best_shift(df, ["area"], 2))
    assert row["raw_f1"] == pytest.approx(f1(0, 0))
    assert row["best_f1"] == pytest.approx(f1(*best))


def test_shift_drops_off_grid_cells(spark):
    df = triple(spark, [[1, 1, 1]], [[1, 1, 1]], [[2, 1, 3]])
    got = {r["col"]: r["shifted_cls"] for r in H.shift_prediction(df, ["area"], 0, 1).collect()}
    assert got == {0: 1, 1: 2, 2: 1}


# ---- gates -----------------------------------------------------------------------

def test_keep_fraction_case(spark):
    rows = [(0, 0, c, s, s, p, sc) for c, (s, p, sc) in enumerate([(1, 1, 9.0), (1, 5, 0.2), (1, 7, 0.9), (2, 5, 0.5)])]
    df = spark.createDataFrame(rows, "area int, row int, col int, start_cls int, end_cls int, pred_cls int, score double")
    got = [r["gated_cls"] for r in G.keep_fraction(df, ["area"], 2 / 3).orderBy("col").collect()]
    assert got == [1, 1, 7, 5]
    assert [r["gated_cls"] for r in G.keep_fraction(df, ["area"], 0.0).orderBy("col").collect()] == [1, 1, 1, 2]
    with pytest.raises(ValueError):
        G.keep_fraction(df, ["area"], 1.5)


def test_gate_in_sliced_mode(spark, holes):
    _, df = holes
    df = df.withColumn("score", (F.col("row") * 7 + F.col("col") * 3) % 11 / 11.0)
    plain = G.keep_fraction(df, ["area"], 0.5)
    spark.conf.set("spark.cellshift.maxGroupRows", "8")
    try:
        sliced = G.keep_fraction(df, ["area"], 0.5)
        a = {(r["row"], r["col"]): r["gated_cls"] for r in sliced.collect()}
    finally:
        spark.conf.unset("spark.cellshift.maxGroupRows")
    assert a == {(r["row"], r["col"]): r["gated_cls"] for r in plain.collect()}


def test_class_budget_sequential(spark):
    rng = np.random.default_rng(11)
    cells = [(r, c, int(rng.integers(1, 4)), int(rng.integers(1, 4)), float(rng.random())) for r in range(12) for c in range(12)]
    df = spark.createDataFrame([(0, r, c, s, s, p, x) for r, c, s, p, x in cells],
                               "area int, row int, col int, start_cls int, end_cls int, pred_cls int, score double")
    ratio = {1: 0.6, 2: 0.8, 3: 0.7}
    gated = {(r, c): p for r, c, s, p, x in cells}
    for k in (1, 2, 3):
        n = sum(v == k for v in gated.values())
        target = round(0.5 * n + 0.5 * round(n * ratio[k]))
        over = max(0, n - target)
        cand = sorted((x, r, c, s) for r, c, s, p, x in cells if gated[r, c] == k and s != k)
        if over >= 2:
            for x, r, c, s in cand[: min(over, len(cand))]:
                gated[r, c] = s
    table = spark.createDataFrame(list(ratio.items()), "cls int, ratio double")
    got = {(r["row"], r["col"]): r["gated_cls"] for r in G.class_budget(df, ["area"], table, (1, 2, 3), 0.5, 2).collect()}
    assert got == gated


# ---- demand and allocation ----------------------------------------------------------

def test_largest_remainder_both_directions(spark):
    df = spark.createDataFrame([(0, 1, 1.5, 4), (0, 2, 1.5, 4), (0, 3, 0.4, 4)], "area int, cls int, expected double, total int")
    assert {r["cls"]: r["n"] for r in D.largest_remainder(df, ["area"]).collect()} == {1: 2, 2: 2, 3: 0}
    df = spark.createDataFrame([(0, 1, 2.0, 3), (0, 2, 2.0, 3)], "area int, cls int, expected double, total int")
    assert {r["cls"]: r["n"] for r in D.largest_remainder(df, ["area"]).collect()} == {1: 2, 2: 1}


def suit_cells(spark, seed, h=8, w=9, k=4, ties=False, areas=2):
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(areas):
        for r in range(h):
            for c in range(w):
                sc = rng.integers(0, 5, k) / 4.0 if ties else rng.random(k)
                rows.append((a, r, c, int(rng.integers(0, k)), [(i, float(x)) for i, x in enumerate(sc)]))
    return rows, spark.createDataFrame(rows, "area int, row int, col int, start_cls int, suit array<struct<cls:int,score:double>>")


def greedy_allocate(cells, demand):
    """Cell-by-cell reference: stay phase, then best open pair first."""
    left, out = dict(demand), {}
    order = []
    for _, r, c, s, suit in cells:
        sc = dict(suit)
        if left.get(s, 0) > 0:
            change = [v for k, v in sc.items() if k != s and demand.get(k, 0) > 0]
            margin = sc[s] - max(change) if change else math.inf
            order.append((-margin, -sc[s], r, c, s))
    for _, _, r, c, s in sorted(order):
        if left[s] > 0:
            out[r, c] = s
            left[s] -= 1
    pairs = sorted((-v, r, c, k) for _, r, c, s, suit in cells if (r, c) not in out for k, v in suit if left.get(k, 0) > 0)
    for _, r, c, k in pairs:
        if (r, c) not in out and left[k] > 0:
            out[r, c] = k
            left[k] -= 1
    return out


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True), (3, True)])
def test_allocation_equals_sequential_greedy(spark, seed, ties):
    rows, df = suit_cells(spark, seed, ties=ties)
    rng = np.random.default_rng(seed + 100)
    demand, want = [], {}
    for a in range(2):
        mine = [x for x in rows if x[0] == a]
        n = rng.multinomial(len(mine), [0.4, 0.3, 0.2, 0.1])
        demand += [(a, i, int(x)) for i, x in enumerate(n)]
        want.update({(a, *k): v for k, v in greedy_allocate(mine, {i: int(x) for i, x in enumerate(n)}).items()})
    d = spark.createDataFrame(demand, "area int, cls int, n bigint")
    out = A.allocate(df, ["area"], d)
    assert {(r["area"], r["row"], r["col"]): r["alloc_cls"] for r in out.collect()} == want
    res = A.allocation_result(out, ["area"], d)
    assert res.filter("violated").count() == 0


def test_allocation_rejects_fixed_overflow(spark):
    _, df = suit_cells(spark, 4, 2, 2, areas=1)
    d = spark.createDataFrame([(0, i, 1) for i in range(4)], "area int, cls int, n bigint")
    with pytest.raises(D.DemandError):
        A.allocate(df.withColumn("start_cls", F.lit(0)), ["area"], d, can_edit=F.lit(False))


def can_meet(have, want, allowed):
    """Hall's condition over all sets of wanted classes."""
    cls = [c for c, n in want.items() if n > 0]
    for k in range(1, len(cls) + 1):
        for some in itertools.combinations(cls, k):
            reach = sum(n for c, n in have.items() if any(c == t or (c, t) in allowed for t in some))
            if reach < sum(want[t] for t in some):
                return False
    return True


def greedy_restricted(cells, demand, allowed):
    """Cell by cell, with the test that the rest can still be met before every step."""
    left, have, out = dict(demand), {}, {}
    for _, _, _, s, _ in cells:
        have[s] = have.get(s, 0) + 1
    ok = lambda a, b: a == b or (a, b) in allowed

    def take(s, t):
        if left.get(t, 0) > 0 and can_meet({**have, s: have[s] - 1}, {**left, t: left[t] - 1}, allowed):
            have[s] -= 1
            left[t] -= 1
            return True
        return False

    order = []
    for _, r, c, s, suit in cells:
        sc = dict(suit)
        if left.get(s, 0) > 0:
            change = [v for k, v in sc.items() if k != s and demand.get(k, 0) > 0 and ok(s, k)]
            order.append((-(sc[s] - max(change)) if change else -math.inf, -sc[s], r, c, s))
    for _, _, r, c, s in sorted(order):
        if take(s, s):
            out[r, c] = s
    start = {(r, c): s for _, r, c, s, _ in cells}
    pairs = sorted((-(v + 1e-6 * (k == s)), r, c, k) for _, r, c, s, suit in cells if (r, c) not in out for k, v in suit
                   if left.get(k, 0) > 0 and ok(s, k))
    for _, r, c, k in pairs:
        if (r, c) not in out and take(start[r, c], k):
            out[r, c] = k
    for r, c in sorted(start):
        if (r, c) not in out:
            s = start[r, c]
            out[r, c] = next((k for k in sorted(left) if left[k] > 0 and ok(s, k)), s)
            if left.get(out[r, c], 0) > 0 and ok(s, out[r, c]):
                left[out[r, c]] -= 1
    return out


@pytest.mark.parametrize("seed,slices", [(1, 1000), (2, 3), (3, 1000), (4, 3), (5, 1000), (6, 2)])
def test_restricted_allocation_equals_sequential_greedy(spark, seed, slices, monkeypatch):
    monkeypatch.setattr(FL, "SLICES", slices)
    rows, df = suit_cells(spark, seed, ties=seed % 2 == 0)
    rng = np.random.default_rng(seed + 500)
    allowed = {(int(a), int(b)) for a, b in rng.integers(0, 4, (5, 2)) if a != b}
    demand, want = [], {}
    for a in range(2):
        mine = [x for x in rows if x[0] == a]
        if seed % 3 == 0:  # a demand that cannot always be met
            n = rng.multinomial(len(mine), [0.1, 0.2, 0.3, 0.4])
        else:  # one that can: every cell moves along an allowed pair or stays
            to = [int(rng.choice([s] + [b for x, b in sorted(allowed) if x == s])) for _, _, _, s, _ in mine]
            n = [to.count(i) for i in range(4)]
        demand += [(a, i, int(x)) for i, x in enumerate(n)]
        want.update({(a, *k): v for k, v in greedy_restricted(mine, {i: int(x) for i, x in enumerate(n)}, allowed).items()})
    d = spark.createDataFrame(demand, "area int, cls int, n bigint")
    out = A.allocate(df, ["area"], d, allowed=sorted(allowed))
    assert {(r["area"], r["row"], r["col"]): r["alloc_cls"] for r in out.collect()} == want
    if seed % 3:
        assert A.allocation_result(out, ["area"], d).filter("violated").count() == 0


def test_restricted_stay_is_refused_for_the_rest(spark):
    suit = [(1, 0.1), (2, 0.9), (3, 0.5)]
    df = spark.createDataFrame([(0, 0, 0, 2, suit), (0, 0, 1, 1, suit)],
                               "area int, row int, col int, start_cls int, suit array<struct<cls:int,score:double>>")
    d = spark.createDataFrame([(0, 2, 1), (0, 3, 1)], "area int, cls int, n bigint")
    out = A.allocate(df, ["area"], d, allowed=[(2, 3), (1, 2)])
    assert sorted(r["alloc_cls"] for r in out.collect()) == [2, 3]
    assert A.allocation_result(out, ["area"], d).filter("violated").count() == 0


def test_flow_of_many_classes(spark):
    n = 14
    supply = spark.createDataFrame([(0, i, 10) for i in range(n)], "area int, cls int, n bigint")
    need = spark.createDataFrame([(0, i, 10) for i in range(n)], "area int, cls int, n bigint")
    assert one(A.feasibility(supply, need, ["area"], [(i, (i + 1) % n) for i in range(n)]))["feasible"]
    more = spark.createDataFrame([(0, 0, 25)] + [(0, i, 5) for i in range(1, n)], "area int, cls int, n bigint")
    assert one(A.feasibility(supply, more, ["area"], [(1, 0)]))["shortfall"] == 25 - 15


def test_restricted_allocation_reports_violations(spark):
    _, df = suit_cells(spark, 5, 3, 3, areas=1)
    df = df.withColumn("start_cls", F.lit(0))
    d = spark.createDataFrame([(0, 0, 0), (0, 1, 4), (0, 2, 5), (0, 3, 0)], "area int, cls int, n bigint")
    out = A.allocate(df, ["area"], d, allowed=[(0, 1)])
    n = {r["phase"]: r["count"] for r in out.groupBy("phase").count().collect()}
    assert n == {"leftover": 4, "violation": 5}
    ok = A.feasibility(D.class_counts(df.groupBy("area", "start_cls").agg(F.count("*").alias("n")), ["area"], "start_cls"), d,
                       ["area"], [(0, 1)])
    assert one(ok)["feasible"] is False and one(ok)["shortfall"] == 5


def greedy_swaps(cells, budget, min_margin, min_base=-99.0):
    """All pairs, best sum first: the small brute force."""
    cand = []
    for x, y in itertools.combinations(sorted(cells), 2):
        (r1, c1, s1, a), (r2, c2, s2, b) = x[:3] + (dict(x[3]),), y[:3] + (dict(y[3]),)
        if s1 == s2:
            continue
        total, stay = a[s2] + b[s1], a[s1] + b[s2]
        if total - stay >= min_margin and total >= min_base:
            cand.append((-total, (r1, c1), (r2, c2), s1, s2))
    used, out = set(), {}
    for _, p, q, s1, s2 in sorted(cand):
        if len(out) >= 2 * budget:
            break
        if p not in used and q not in used:
            used |= {p, q}
            out[p], out[q] = s2, s1
    return out


@pytest.mark.parametrize("slice_rows,margin,base", [(2_000, None, None), (2_000, -0.1, 0.9), (4, 0.2, None), (2, 9.0, None)])
def test_swaps_equal_brute_force(spark, slice_rows, margin, base):
    """Twenty random areas with many equal scores; several rounds and slices each."""
    rng = random.Random(11)
    rows, budgets, expected = [], [], {}
    for area in range(20):
        cells = [(r, c, rng.randint(0, 3), [(k, rng.randint(0, 6) / 8) for k in range(4)]) for r in range(5) for c in range(5)]
        rows += [(area, *x) for x in cells]
        budgets.append((area, rng.choice([0, 1, 4, 12])))
        m = -99.0 if margin is None else margin
        expected |= {(area, *p): t for p, t in greedy_swaps(cells, budgets[-1][1], m, -99.0 if base is None else base).items()}
    df = spark.createDataFrame(rows, "area int, row int, col int, start_cls int, suit array<struct<cls:int,score:double>>")
    sides = A.swap_sides(df.withColumn("alloc_cls", F.col("start_cls")), ["area"])
    b = spark.createDataFrame(budgets, "area int, n_swaps bigint")
    got = A.balanced_swaps(sides, ["area"], b, min_margin=margin, min_base=base, slice_rows=slice_rows).collect()
    assert {(r["area"], r["row"], r["col"]): r["to_cls"] for r in got} == expected


def test_swaps_of_one_area_over_many_slices(spark):
    rng = random.Random(12)
    rows = [(0, r, c, rng.randint(0, 1), [(k, rng.random()) for k in range(2)]) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(rows, "area int, row int, col int, start_cls int, suit array<struct<cls:int,score:double>>")
    sides = A.swap_sides(df.withColumn("alloc_cls", F.col("start_cls")), ["area"])
    b = spark.createDataFrame([(0, 300)], "area int, n_swaps bigint")
    got = A.balanced_swaps(sides, ["area"], b, slice_rows=100)
    assert got.count() == 600
    assert {(r["row"], r["col"]): r["to_cls"] for r in got.collect()} == greedy_swaps([(r, c, s, suit) for _, r, c, s, suit in rows], 300, -99.0)


@pytest.mark.parametrize("margin,base,thin_rows,parts", [(0.1, None, 1 << 18, 1), (0.1, 1.1, 60, 3), (None, 1.1, 60, 3), (None, None, 60, 3)])
def test_cells_that_never_swap_go_before_ranking(spark, margin, base, thin_rows, parts):
    """Many equal scores: what is kept for three swaps of an area does not grow with its cells."""
    rng = random.Random(13)
    low = [-99.0 if x is None else x for x in (margin, base)]
    kept = {}
    for side in (12, 24):
        cells = [(r, c, rng.randint(0, 2), [(k, rng.randint(0, 6) / 8) for k in range(3)]) for r in range(side) for c in range(side)]
        df = spark.createDataFrame([(0, *x) for x in cells], "area int, row int, col int, start_cls int, suit array<struct<cls:int,score:double>>")
        sides = A.swap_sides(df.withColumn("alloc_cls", F.col("start_cls")), ["area"]).repartition(parts)
        few = A._undominated(sides.withColumn("_want", F.lit(3).cast("bigint")), ["area"], *(float("-inf") if x == -99.0 else x for x in low), thin_rows)
        kept[side] = few.count()
        assert kept[side] < sides.count()
        if side == 24:
            continue
        got = A.balanced_swaps(few.drop("_want"), ["area"], spark.createDataFrame([(0, 3)], "area int, n_swaps bigint"), margin, base).collect()
        assert {(r["row"], r["col"]): r["to_cls"] for r in got} == greedy_swaps(cells, 3, *low)
    if parts == 1:
        assert kept[24] < 1.5 * kept[12]


# ---- baselines ---------------------------------------------------------------------

def test_shuffle_keeps_class_counts(holes):
    _, df = holes
    out = Z.spatial_shuffle(df, ["area"], 1)
    a = {r[0]: r[1] for r in out.groupBy("pred_cls").count().collect()}
    assert a == {r[0]: r[1] for r in out.groupBy("shuffled_cls").count().collect()}


def test_linear_forecast_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(200, 5)), rng.normal(size=(5, 5))
    y = x + x @ w + 0.3
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(4)
    coef, icpt = Z.solve_ridge(Z.vector_moments(df, "x", "y"), 5, 1e-6)
    assert np.allclose(coef, w, atol=1e-5) and np.allclose(icpt, 0.3, atol=1e-5)
    out = np.stack([r["forecast"] for r in Z.linear_delta_forecast(df, "x", coef, icpt).select("forecast").collect()])
    assert out.shape == (200, 5)


# ---- statistics ---------------------------------------------------------------------

def test_sign_test_vector(spark):
    df = spark.createDataFrame([(1, v) for v in [0.1, 0.2, -0.1, 0.0]], "k int, v double")
    r = one(I.sign_test(df, ["k"], "v"))
    assert (r["n_positive"], r["n_negative"], r["n_tie"]) == (2, 1, 1)
    assert r["p_value"] == pytest.approx(1.0)
    df = spark.createDataFrame([(1, 1.0)] * 9 + [(1, -1.0)], "k int, v double")
    assert one(I.sign_test(df, ["k"], "v"))["p_value"] == pytest.approx(2 * 11 / 1024)


def test_equal_means_tie_however_seeds_are_spread(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, i, m, 281.99, '{"k": 32}') for i in range(5) for m in ("click", "view")]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1, 2, 3, 5, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = entry.queries()["e20_win_loss"](spark, str(tmp_path)).filter("control = 'view'").collect()
            assert [(r.delta, r.model_won) for r in got] == [(0.0, False)] * 2, n
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_steady_sums_keep_odd_values(spark):
    cases = {"a": [0.1] * 10, "b": [1.0, float("nan")], "c": [1e300, 1.0], "d": [None], "e": [1.0, None, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(K.steady_sum(F.col("v")).alias("s"), K.steady_mean(F.col("v")).alias("m")).collect()}
    assert got["a"] == (1.0, 0.1) and math.isnan(got["b"][0]) and got["c"][0] == 1e300 + 1.0
    assert got["d"] == (None, None) and got["e"] == (3.0, 1.5)


def test_bootstrap_is_the_same_in_any_order(spark):
    """Cluster sums and replicates to the last bit, on rows dealt differently."""
    rnd = random.Random(4)
    rows = [(1, a, round(rnd.uniform(-1, 1), 2) / 500) for a in range(40) for _ in range(30)]
    df = spark.createDataFrame(rows, "k int, area int, v double")
    got = {tuple(I.cluster_bootstrap(df.repartition(n, F.rand(n)), ["k"], "area", "v", 100, 9).collect()[0]) for n in (1, 3, 8, 31)}
    assert len(got) == 1


def test_cluster_bootstrap_cases(spark):
    df = spark.createDataFrame([("a", 0.10), ("a", 0.20), ("b", -0.05)], "area string, v double").withColumn("k", F.lit(1))
    r = one(I.cluster_bootstrap(df, ["k"], "area", "v", 200, 1))
    assert r["n_clusters"] == 2 and r["mean"] == pytest.approx(0.25 / 3) and r["ci_low"] <= r["mean"] <= r["ci_high"]
    r = one(I.cluster_bootstrap(df.filter("area = 'a'"), ["k"], "area", "v", 50, 1))
    assert r["ci_low"] is None and r["mean"] == pytest.approx(0.15)


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (0.5, 3, 0.65145), (5.0, 30, 2.3e-5), (0.0, 4, 1.0)])
def test_t_distribution(t, df, p):
    assert I.t_two_sided(t, df) == pytest.approx(p, rel=3e-2, abs=1e-6)


def test_signed_rank_p_exact():
    n = 7
    ways = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in (0, 3, 10):
        assert I.signed_rank_p(w, n, 0.0) == pytest.approx(min(1.0, 2 * sum(x <= w for x in ways) / 2**n))


def test_wilcoxon_midranks(spark):
    df = spark.createDataFrame([(1, v) for v in [1.0, -1.0, 2.0, 3.0, 0.0]], "k int, v double")
    r = one(I.wilcoxon(df, ["k"], "v"))
    assert (r["n"], r["w_plus"], r["w_minus"], r["ties"]) == (4, 8.5, 1.5, 6.0)


def test_effect_needs_three_units_per_side(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5), (1, 2.0, 0.5), (0, 0.5, 0.5)], "t int, y double, p double")
    assert one(I.average_effect(I.stratified_effect(df, "t", "y", "p")))["att"] == 0.0


# ---- selection ------------------------------------------------------------------------

def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((40, 3)), rng.random(40)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    d = np.c_[np.ones(40), x]
    want = np.linalg.solve(d.T @ d + 0.01 * np.diag([0, 1, 1, 1]), d.T @ y)
    assert np.allclose(J.fit_ridge(df, ["a", "b", "c"], "y", 0.01), want)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_leave_one_out_quantile(spark, q):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([(i, v, i != 6) for i, v in enumerate(vals)], "area int, v double, ok boolean")
    got = {r["area"]: r["q"] for r in J.leave_one_out_quantile(df, F.col("ok"), "v", {"q": q}).collect()}
    for i in range(7):
        rest = [v for j, v in enumerate(vals) if j != i and j != 6]
        assert got[i] == pytest.approx(np.quantile(rest, q))


def walk_round_robin(units, sample_size, cap, key):
    """One turn after the other: (id, region, size_class, province) rows."""
    groups = {}
    for u in sorted(units, key=key):
        groups.setdefault((u[1], u[2]), []).append(u)
    used, chosen, go = {}, [], True
    while go and len(chosen) < sample_size:
        go = False
        for g in sorted(groups):
            while groups[g]:
                u = groups[g].pop(0)
                if used.get(u[3], 0) < cap:
                    used[u[3]] = used.get(u[3], 0) + 1
                    chosen.append(u[0])
                    go = True
                    break
            if len(chosen) >= sample_size:
                break
    return chosen


@pytest.mark.parametrize("seed,provinces,size,cap", [(9, 8, 14, 2), (1, 3, 100, 5), (2, 40, 60, 1), (3, 6, 25, 7), (4, 1, 10, 3), (5, 12, 1, 1)])
def test_stratified_sample_equals_the_walk(spark, seed, provinces, size, cap):
    import hashlib

    rng = np.random.default_rng(seed)
    units = [(i, f"R{int(rng.integers(0, 3) * rng.random())}", ["small", "large"][rng.integers(0, 2)], f"P{int(rng.integers(0, provinces) * rng.random())}")
             for i in range(150)]
    key = lambda u: hashlib.sha256(f"s|{u[0]}".encode()).hexdigest()
    df = spark.createDataFrame(units, "id int, region string, size_class string, province string")
    got = J.stratified_sample(df, size, cap, "s", ["id"]).orderBy("selection_rank").collect()
    assert [r["id"] for r in got] == walk_round_robin(units, size, cap, key)
    assert [r["selection_rank"] for r in got] == list(range(1, len(got) + 1))


def test_stratified_sample_of_nothing(spark):
    df = spark.createDataFrame([], "id int, region string, size_class string, province string")
    assert J.stratified_sample(df, 5, 2, "s", ["id"]).count() == 0


def test_always_baseline_rule_is_the_fallback(spark):
    rows = [("base", a, 0.5, 0.1 * a) for a in range(4)] + [("alt", a, 0.1, 0.1 * a) for a in range(4)]
    df = spark.createDataFrame(rows, "candidate string, area int, fom double, feature double")
    r = J.feasible_rules(J.threshold_rules(df, "base", "feature", ["fom"]), ["fom"], [])
    assert one(J.best_rule(r, [("fom", True)]))["alternate"] is None


# ---- graph, catalog, cells -----------------------------------------------------------

def test_components_of_a_descending_chain(spark):
    n = 10_000
    edges = spark.createDataFrame([(0, 2 * n)] + [(2 * n - i, 2 * n - i - 1) for i in range(n)], "src bigint, dst bigint")
    nodes = edges.selectExpr("explode(array(src, dst)) as node").distinct()
    got = {r["node"]: r["component"] for r in P.connected_components(nodes, edges).collect()}
    assert set(got.values()) == {0} and len(got) == n + 2


def test_components_of_a_long_chain(spark):
    n = 300
    nodes = spark.range(n + 3).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in P.connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(n)} == {0}
    assert [got[n + i] for i in range(3)] == [n, n + 1, n + 2]


def test_align_and_skip_rows(spark):
    s = spark.createDataFrame([(0, 0, c, 1) for c in range(3)] + [(1, 0, 0, 1)], "area int, row int, col int, cls int")
    good, skip = C.co_register(C.align(s, s, s.filter("col < 2"), ["area"]), ["area"])
    assert [r["area"] for r in good.collect()] == [1]
    assert [(r["area"], r["reason"]) for r in skip.collect()] == [(0, "shape_mismatch")]


def test_names_and_listing(spark, tmp_path):
    for n in ("x_a_lulc_2020.npy", "x_a_lulc_pred_2020_2021.npy", "bad_lulc_20.npy", "x_a_emb_2020.npy"):
        (tmp_path / n).write_bytes(b"1")
    files = CAT.list_files(spark, str(tmp_path))
    assert [tuple(r) for r in CAT.parse_labels(files).select("area", "year").collect()] == [("x_a", 2020)]
    assert [tuple(r)[1:] for r in CAT.parse_predictions(files).collect()] == [("x_a", 2020, 2021)]


def test_registry_and_manifest_contracts(spark, tmp_path):
    import json

    ok = {"area": "A", "bbox": [1, 2, 3, 4], "stratum": "S", "years": [2021, 2020, 2021], "data_source": "d",
          "selection_reason": "r", "development_contact_status": "none", "contact_evidence": "e", "expected_role": "x", "notes": ""}
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"areas": [ok]}))
    r = CAT.read_holdouts(spark, str(p)).collect()[0]
    assert r["area"] == "a" and r["years"] == [2020, 2021]
    p.write_text(json.dumps({"areas": [ok, {**ok, "area": "a"}]}))
    with pytest.raises(CAT.CatalogError):
        CAT.read_holdouts(spark, str(p))
    q = tmp_path / "r.json"
    q.write_text(json.dumps({"rows": [{"area": "a", "tier": "tier1", "development_contact_status": "uncertain", "contact_evidence": "e"}]}))
    schema = StructType([StructField(c, StringType()) for c in ("area", "tier", "development_contact_status", "contact_evidence")])
    with pytest.raises(CAT.CatalogError):
        CAT.read_registry(spark, str(q), schema)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x")], "id int, v array<double>, t string")
    CAT.write_table(df, str(tmp_path / "c"), "csv", ["id", "v"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()
    assert back[0]["v"] == "[1.0,2.0]" and back[0]["id"] == "1"
    CAT.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_qc_reasons_in_order(spark):
    rows = [(0, 0, 0, 1, None, 1), (1, 0, 0, 1, 1, 1), (2, 0, 0, 1, 2, 1), (2, 0, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "area int, row int, col int, start_cls int, end_cls int, pred_cls int")
    got = {r["area"]: r["excluded_reason"] for r in C.qc_status(C.pair_profile(df, ["area"]), F.lit(True)).collect()}
    assert got == {0: "missing_label", 1: "zero_reference_change", 2: "class_collapse"}


def test_leave_one_out_is_total_minus_own(spark):
    df = spark.createDataFrame([("s", 0, 1, 5), ("s", 1, 1, 7), ("t", 2, 1, 9)], "shape string, area int, k int, n bigint")
    got = {(r["shape"], r["area"]): r["n"] for r in C.leave_one_area_out(df, ["shape"], "area", ["k"]).collect()}
    assert got == {("s", 0): 7, ("s", 1): 5}


def test_summary_of_an_empty_group(spark):
    df = spark.createDataFrame([("tier1", "a", float("nan"))], "tier string, stratum string, v double")
    rows = S.summarise_scopes(df, "v").collect()
    assert {r["n"] for r in rows} == {0} and {r["mean"] for r in rows} == {None}


def test_group_stats_counts_slices(spark):
    st = group_stats(spark.range(100).selectExpr("id % 2 as k"), ["k"], limit=20)
    assert (st.groups, st.slices) == (2, 6)


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 2), (3, 3), (4, 3)])
def test_best_conjunction_equals_brute_force(spark, seed, k):
    rng = np.random.default_rng(seed)
    rows = [(c, a, float(np.round(rng.random(), 3)), float(np.round(rng.random(), 3)), float(np.round(rng.random(), 2)))
            for c in ("base", "x", "y") for a in range(6)]
    df = spark.createDataFrame(rows, "candidate string, area int, fom double, err double, feature double")
    got = J.best_conjunction(df, "base", ["feature"], k, ["fom"], ["err"], max_share=0.7, min_count=2).collect()
    by = {(c, a): (f, e, v) for c, a, f, e, v in rows}
    conditions = [(f"{c}|feature|{op}", v if op == "le" else -v) for c in ("base", "x", "y") for op in ("le", "ge")
                  for v in {by[c, a][2] for a in range(6)}]
    meets = {cd: {a for a in range(6) if (by[cd[0].split("|")[0], a][2] if cd[0].endswith("le") else -by[cd[0].split("|")[0], a][2]) <= cd[1]}
             for cd in conditions}
    best = None
    for size in range(1, k + 1):
        for some in itertools.combinations(sorted(set(conditions)), size):
            areas = set.intersection(*(meets[c] for c in some))
            if len(areas) < 2 or len(areas) / 6 > 0.7 + 1e-12:
                continue
            for alt in ("x", "y"):
                df_, de = (sum(by[alt, a][i] - by["base", a][i] for a in areas) / 6 for i in (0, 1))
                if df_ >= -1e-12 and de <= 1e-12:
                    key = (-round(df_, 12), round(de, 12), -len(areas))
                    best = min(best, key) if best else key
    if best is None:
        assert got == []
    else:
        r = got[0]
        assert (-round(r["delta_fom"], 12), round(r["delta_err"], 12), -r["n_alternate"]) == pytest.approx(best)
        cd = [(c["axis"], c["s"]) for c in r["conditions"]]
        assert len(set.intersection(*(meets[c] for c in cd))) == r["n_alternate"]


@pytest.mark.parametrize("seed,k,bounds", [(1, 1, (None, None)), (2, 2, (None, None)), (3, 3, (None, None)), (4, 3, (1, 2)), (5, 2, (2, None)), (6, 3, (None, 0))])
def test_best_conjunction_of_three_fields_and_target_counts(spark, seed, k, bounds):
    rng = np.random.default_rng(seed)
    names, fields, n = ("base", "x"), ("f", "g", "h"), 5
    rows = [(c, a, float(rng.integers(0, 9) / 8), float(rng.integers(0, 9) / 8), *(float(rng.integers(0, 4)) for _ in fields))
            for c in names for a in range(n)]
    target = [(c, a, *(float(rng.integers(0, 4)) for _ in fields)) for c in names for a in range(4)]
    head = "candidate string, area int, "
    df = spark.createDataFrame(rows, head + "fom double, err double, f double, g double, h double")
    tf = spark.createDataFrame(target, head + "f double, g double, h double")
    got = J.best_conjunction(df, "base", list(fields), k, ["fom"], ["err"], max_share=0.8, min_count=1, target=tf,
                             target_min=bounds[0], target_max=bounds[1]).collect()
    by = {(r[0], r[1]): r[2:] for r in rows}
    aim = {(r[0], r[1]): r[2:] for r in target}
    signed = lambda v, op: v if op == "le" else -v
    conditions = sorted({(f"{c}|{f}|{op}", signed(by[c, a][2 + i], op)) for c in names for i, f in enumerate(fields) for op in ("le", "ge")
                         for a in range(n)})

    def meets(cd, table, of, skip):
        c, f, op = cd[0].split("|")
        return {a for a in range(of) if signed(table[c, a][skip + fields.index(f)], op) <= cd[1]}

    held = {cd: (meets(cd, by, n, 2), meets(cd, aim, 4, 0)) for cd in conditions}
    best = None
    for size in range(1, k + 1):
        for some in itertools.combinations(conditions, size):
            areas = set.intersection(*(held[c][0] for c in some))
            aims = len(set.intersection(*(held[c][1] for c in some)))
            if not areas or len(areas) > 0.8 * n + 1e-9 or aims < (bounds[0] or 0) or (bounds[1] is not None and aims > bounds[1]):
                continue
            d, e = (sum(by["x", a][i] - by["base", a][i] for a in areas) / n for i in (0, 1))
            if d >= -1e-12 and e <= 1e-12:
                key = (-round(d, 12), round(e, 12), -len(areas), size, some, aims)
                best = min(best, key) if best else key
    if best is None:
        assert got == []
    else:
        (r,) = got
        assert (r["n_alternate"], r["target_count"], [tuple(c) for c in r["conditions"]]) == (-best[2], best[5], list(best[4]))
        assert (r["delta_fom"], r["delta_err"]) == pytest.approx((-best[0], best[1]))


def test_rule_search_tells_when_its_bitmaps_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(J, "BITMAP_BYTES", 10)
    df = spark.createDataFrame([("base", 1, 0.1, 0.2), ("x", 1, 0.3, 0.4)], "candidate string, area int, fom double, f double")
    with pytest.raises(ValueError, match="bytes"):
        J.best_conjunction(df, "base", ["f"], 1, ["fom"])


def test_restricted_greedy_in_slices_is_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(a, r, c, rng.randrange(3), [(k, rng.randrange(20) / 20) for k in range(3)]) for a in (0, 1) for r in range(9) for c in range(9)]
    cells = spark.createDataFrame(rows, "area int, row int, col int, start_cls int, suit array<struct<cls:int,score:double>>")
    demand = spark.createDataFrame([(a, k, 27) for a in (0, 1) for k in range(3)], "area int, cls int, n bigint")
    find = lambda: sorted(map(tuple, A.allocate(cells, ["area"], demand, allowed=((0, 1), (1, 2), (2, 0))).select(
        "area", "row", "col", "alloc_cls", "phase", "alloc_score").collect()), key=str)
    want = find()
    monkeypatch.setattr(FL, "WIDE_ROWS", 10)
    assert find() == want and len(want) == 162


def test_rule_search_takes_more_target_areas_than_a_task_holds(spark, monkeypatch):
    """Target areas are counted share by share, rules chunk by chunk; their number is no part of a task's memory."""
    rng = np.random.default_rng(5)
    rows = [(c, a, float(rng.integers(0, 9) / 8), float(rng.integers(0, 9))) for c in ("base", "x") for a in range(6)]
    df = spark.createDataFrame(rows, "candidate string, area int, fom double, f double")
    tf = spark.createDataFrame([(c, a, float(rng.integers(0, 9))) for c in ("base", "x") for a in range(2000)], "candidate string, area int, f double")
    find = lambda: J.best_conjunction(df, "base", ["f"], 2, ["fom"], target=tf, target_min=100).collect()
    want = find()
    for name, v in (("BITMAP_BYTES", 24 * 40 + 100), ("SHARE_ROWS", 300), ("CHUNK_RULES", 3), ("TARGET_BLOCK", 64)):
        monkeypatch.setattr(J, name, v)
    assert find() == want and want[0]["target_count"] >= 100
    one = {(r[0], r[1]): r[2] for r in tf.collect()}
    signed = lambda v, op: v if op == "le" else -v
    parts = [(*c["axis"].split("|"), c["s"]) for c in want[0]["conditions"]]
    assert want[0]["target_count"] == sum(all(signed(one[c, a], op) <= s for c, _, op, s in parts) for a in range(2000))


def test_blocks_are_connected_and_bounded(spark):
    """A U of two long arms, a path of equal steps, a grid and a star, as components of one table."""
    rng, most = np.random.default_rng(3), 10
    at, edges = [], []

    def add(points, links):
        edges.extend((len(at) + a, len(at) + b) for a, b in links)
        at.extend(points)

    add([(0.0, y) for y in range(20)] + [(1.0, y) for y in range(19, -1, -1)], [(i, i + 1) for i in range(39)])
    add([(float(i), 50.0) for i in range(50)], [(i, i + 1) for i in range(49)])
    add([(float(x), 99.0 + y) for x in range(8) for y in range(8)],
        [(8 * x + y, 8 * u + v) for x in range(8) for y in range(8) for u, v in ((x + 1, y), (x, y + 1)) if u < 8 and v < 8])
    add([tuple(200 + rng.random(2)) for _ in range(30)], [(0, i) for i in range(1, 30)])
    p = spark.createDataFrame([(i, "0110", float(x), float(y), 1000.0) for i, (x, y) in enumerate(at)],
                              "parcel_id bigint, dlbm string, x double, y double, area_m2 double")
    e = spark.createDataFrame([*edges, edges[0][::-1], edges[0]], "src bigint, dst bigint")
    got = P.define_blocks(p.repartition(5), e, ["x", "y"], most, 1, 0.0).collect()
    assert sorted(r["parcel_id"] for r in got) == list(range(len(at)))
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], set()).add(r["parcel_id"])
    for members in blocks.values():
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b in edges if x in (a, b) and {a, b} <= members]
        assert seen == members and len(members) <= most
    of = {x: b for b, members in blocks.items() for x in members}
    assert all(of[a] == of[b] or len(blocks[of[a]] | blocks[of[b]]) > most for a, b in edges)  # nothing more fits together


def test_joint_fit_of_folds_equals_separate_fits(spark):
    from cellshift.operators import learning as L

    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        cls = int(rng.integers(0, 3))
        rows.append((i, 2000 + i % 2, cls, (rng.normal(size=4) + 1.2 * np.eye(4)[cls] + (i % 2)).tolist()))
    df = spark.createDataFrame(rows, "i int, year int, cls int, z array<double>").repartition(3)
    data = L.with_folds(df, ["i"], 3, 5)
    theta = L.fit_folds(data, "year", "z", "cls", [0, 1, 2], [2000, 2001], 3, tol=1e-12)
    held = [(r.year, r.fold, r.cls, np.array(r.z)) for r in data.collect()]
    for (year, fold), t in theta.items():
        own = [(c, z) for y, f, c, z in held if y == year and f != fold]
        x, y = np.array([z for _, z in own]), np.eye(3)[[c for c, _ in own]]
        r = L._probabilities(x, t) - y
        residual = np.vstack([x.T @ r + t[:-1], r.sum(axis=0)])  # the gradient of the penalised loss
        assert np.abs(residual).max() < 1e-3
    train = data.filter("year = 2000 and fold <> 1")
    one = L.decode(L.fit_decoder(train, "z", "cls"), data.filter("year = 2000 and fold = 1"), "z").select("i", "decoded_cls").collect()
    mine = {r.i: np.array(r.z) for r in data.collect()}
    same = [int(L._probabilities(mine[r.i][None], theta[2000, 1]).argmax()) == r.decoded_cls for r in one]
    assert np.mean(same) > 0.97
    scores = L.fold_scores(df, "year", ["i"], "z", "cls", 3, 5).collect()
    assert len(scores) == 6 and sum(r.n_test for r in scores) == 240 and min(r.accuracy for r in scores) > 0.4


def test_groups_fitted_in_tasks_send_no_model_to_the_driver(spark, monkeypatch):
    """The same scores as the joint fit, which is left to groups beyond the bound."""
    from cellshift.operators import learning as L

    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        cls = int(rng.integers(0, 3))
        rows.append((i, i % 6, cls, (rng.normal(size=4) + 2.0 * np.eye(4)[cls]).tolist()))
    df = spark.createDataFrame(rows, "i int, year int, cls int, z array<double>")
    order = lambda d: sorted((r.year, r.fold, r.n_test, round(r.accuracy, 9), round(r.macro_f1, 9)) for r in d.collect())
    joint = order(L.fold_scores(df, "year", ["i"], "z", "cls", 3, 5, own_bytes=0))
    mixed = df.filter("year < 5 or i < 300")  # 150 rows of 32 bytes, and one group of 50
    some = order(L.fold_scores(mixed, "year", ["i"], "z", "cls", 3, 5, own_bytes=50 * 32))
    assert [r for r in some if r[0] < 5] == [r for r in joint if r[0] < 5] and sum(r[2] for r in some) == 800

    def never(*a, **kw):
        raise AssertionError("a joint fit")

    monkeypatch.setattr(L, "fit_folds", never)
    assert order(L.fold_scores(df, "year", ["i"], "z", "cls", 3, 5)) == joint


def test_class_names_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))
    classes = [(i, word()) for i in range(40)] + [(50, None), (51, "abcabc"), (52, "abcabc")]
    queries = [word() for _ in range(80)] + [None, "", "abcabc", "zzzz", "xabcabcx", "b"]
    for known in (classes, [c for c in classes if c[1]]):
        got = C.match_class_names(spark.createDataFrame([(q,) for q in queries], "query string"),
                                  spark.createDataFrame(known, "cls int, cls_name string"))
        expected = {}
        for q in set(queries):
            hits = [(n != q, i) for i, n in known if q is not None and n is not None and (n in q or q in n)]
            expected[q] = min(hits)[1] if hits else None
        assert {r["query"]: r["cls"] for r in got.collect()} == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_json_lines_and_the_bound_of_documents(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("A ", [1.0, 2.0, 3.0, 4.0], [2021, 2020]), ("b", [1.0, 2.0, 3.0, 4.0], [2020])], "area string, bbox array<double>, years array<int>")
    full = rows.selectExpr("*", *(f"'{v}' as {c}" for c, v in (
        ("stratum", "s"), ("data_source", "d"), ("selection_reason", "r"), ("development_contact_status", "none"),
        ("contact_evidence", "e"), ("expected_role", "x"), ("notes", "n")))).repartition(2)
    CAT.write_lines(full, str(tmp_path / "ok"))
    got = CAT.read_holdouts(spark, str(tmp_path / "ok"), lines=True).collect()
    assert sorted((r.area, tuple(r.years)) for r in got) == [("a", (2020, 2021)), ("b", (2020,))]
    CAT.write_lines(full.drop("notes"), str(tmp_path / "bad"))
    assert {r.reason for r in CAT.missing_fields(spark, str(tmp_path / "bad"), "areas", CAT.HOLDOUT_FIELDS, lines=True).collect()} == {"missing_field:notes"}
    with pytest.raises(CAT.CatalogError):
        CAT.read_holdouts(spark, str(tmp_path / "bad"), lines=True)
    CAT.write_document(full, str(tmp_path / "doc"), "areas")
    assert CAT.read_holdouts(spark, str(tmp_path / "doc")).count() == 2
    monkeypatch.setattr(CAT, "DOCUMENT_BYTES", 50)
    for act in (lambda: CAT.write_document(full, str(tmp_path / "no"), "areas"), lambda: CAT.read_holdouts(spark, str(tmp_path / "doc"))):
        with pytest.raises(CAT.CatalogError, match="JSON lines"):
            act()


def test_propensity_and_regions_and_decoder(spark):
    """Model fits that SQL can't state, held by what they must recover."""
    from cellshift.operators import learning as L

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        region = int(rng.integers(0, 3))
        z = 8.0 * np.eye(3)[region] + rng.normal(size=3) * 0.3
        treated = int(rng.random() < (0.9 if z[0] > 4 else 0.1))
        rows.append((i, region, z.tolist(), float(z[0]), treated))
    df = spark.createDataFrame(rows, "i int, cls int, z array<double>, x double, treated int").repartition(2)
    cells, centres = L.region_partition(df, "z", 3, seed=1)
    split = cells.groupBy("cls").agg(F.count_distinct("region").alias("n"), F.min("region").alias("r")).collect()
    assert {r.n for r in split} == {1} and len({r.r for r in split}) == 3  # each cluster is one region
    means = {tuple(np.round(c.centre, 6)) for c in centres.collect()}
    own = {k: np.mean([r[2] for r in rows if r[1] == k], axis=0) for k in range(3)}
    assert means == {tuple(np.round(v, 6)) for v in own.values()}
    model = L.fit_decoder(df, "z", "cls")
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    got = L.decode(model, df, "z").collect()
    for r in got:
        logits = w @ np.array(r.z) + b
        p = np.exp(logits - logits.max())
        assert r.decoded_cls == int(logits.argmax()) and np.allclose([c.p for c in r.probs], p / p.sum(), atol=1e-9)
    assert np.mean([r.decoded_cls == r.cls for r in got]) == 1.0
    prop = L.cross_fitted_propensity(df, ["i"], ["x"], "treated").select("i", "x", "propensity").collect()
    assert len(prop) == 300 and all(0 <= r.propensity <= 1 for r in prop)
    high, low = (np.mean([r.propensity for r in prop if (r.x > 4) == side]) for side in (True, False))
    assert high > 0.7 and low < 0.3


def test_vector_kernels_equal_the_expressions(spark):
    from cellshift.functions import vectors as V
    rows = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], None), ([1.0, None], [1.0, 2.0]),
            ([1.0], [1.0, 2.0]), ([], []), ([3.0, 0.5, 1.0], [1.0, 2.0, 3.0]), ([0.1] * 70, [0.3] * 70)]
    d = spark.createDataFrame(rows * 3, "a array<double>, b array<double>").coalesce(1)
    for part in (d, d.where("get(a, 1) = 2.0"), d.where("false"), d.selectExpr("cast(a as array<float>) a", "b")):
        for plain, batch in [(V.cosine("a", "b"), V.batch_cosine("a", "b"))] + [
                (V.distance("a", "b", m), V.batch_distance("a", "b", m)) for m in ("cosine", "euclidean", "manhattan")]:
            assert part.select((~plain.eqNullSafe(batch)).alias("x")).where("x").count() == 0
