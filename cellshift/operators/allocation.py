"""Demand-constrained allocation of classes to cells.

Cells carry their class scores as one array column ``suit`` of
struct(cls, score); nothing is exploded to one row per cell and class except
where a ranking needs it.

The change phase is a greedy over (score desc, row, col) with class capacities.
It is computed as deferred acceptance on thresholds: each class has an entry
threshold per area; every free cell proposes to its best class it still passes;
an over-full class tightens its threshold to its capacity-th best proposal.
Both sides rank by one strict order, so the fixed point equals the greedy
result.  State between rounds is one small table (area, class, threshold).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from ..session import cut_lineage
from . import flow
from .demand import DemandError, remaining_demand
from .ranking import group_rank, group_stats, join_small

POS = ("row", "col")
OWN_BONUS = 1e-6  # fixed value: what a cell's own class gains in the change phase


def change_pressure(cells: DataFrame, keys: Sequence[str], start_vec: str, forecast_vec: str) -> DataFrame:
    """Norm of the embedding change over the area maximum (0 when the maximum is 0)."""
    c = cells.withColumn("_p", V.norm(V.subtract(forecast_vec, start_vec)))
    top = c.groupBy(*keys).agg(F.max("_p").alias("_m"))
    j = join_small(c, top, keys, how="inner")
    return j.withColumn("pressure", F.when(F.col("_m") > 0, F.col("_p") / F.col("_m")).otherwise(0.0)).drop("_p", "_m")


def suitability(
    cells: DataFrame, classes: Sequence[int], forecast: str, start: str, prior: DataFrame | None = None,
    pressure: Column | None = None, allowed: Sequence[tuple[int, int]] | None = None,
    weights: tuple[float, float, float, float] = (1.0, 0.5, 0.25, 0.25), keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``suit``: w1 p + w2 max(p - p_start, 0) + w3 pressure + w4 prior per target class.

    ``forecast`` and ``start`` are MAP<class, probability> columns.  Stay
    (diagonal) and forbidden targets score 0.
    """
    w1, w2, w3, w4 = weights
    out, prior_of = cells, F.lit(0.0)
    if prior is not None:
        on = [k for k in keys if k in prior.columns]
        rows = prior.groupBy(*on, F.col("from_cls").alias("start_cls")).agg(
            F.map_from_entries(F.collect_list(F.struct("to_cls", "prior"))).alias("_prior")
        )
        out = join_small(cells, rows, [*on, "start_cls"])
    items = []
    for c in classes:
        c = int(c)
        p = F.coalesce(F.try_element_at(F.col(forecast), F.lit(c)), F.lit(0.0))
        s = F.coalesce(F.try_element_at(F.col(start), F.lit(c)), F.lit(0.0))
        if prior is not None:
            prior_of = F.coalesce(F.try_element_at(F.col("_prior"), F.lit(c)), F.lit(0.0))
        score = F.lit(w1) * p + F.lit(w2) * F.greatest(p - s, F.lit(0.0))
        if pressure is not None:
            score = score + F.lit(w3) * pressure
        score = score + F.lit(w4) * prior_of
        ok = F.col("start_cls") != c
        if allowed is not None:
            ok = ok & F.col("start_cls").isin([int(a) for a, b in allowed if int(b) == c])
        items.append(F.struct(
            F.lit(c).alias("cls"), F.when(ok, F.greatest(score, F.lit(0.0))).otherwise(0.0).alias("score")
        ))
    out = out.withColumn("suit", F.array(*items))
    return out.drop("_prior") if prior is not None else out


def add_affinity(cells: DataFrame, affinity: DataFrame, keys: Sequence[str], weight: float, value: str = "fraction") -> DataFrame:
    """suit += weight * affinity, from a long (cell, nb_cls, value) table."""
    if weight < 0.0:
        raise DemandError(f"weight must be non-negative: {weight}")
    on = [*keys, *POS]
    m = affinity.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("nb_cls", value))).alias("_a"))
    j = cells.join(m, on, "left")
    bumped = F.transform("suit", lambda x: F.struct(
        x["cls"].alias("cls"),
        (x["score"] + F.lit(weight) * F.coalesce(F.try_element_at(F.col("_a"), x["cls"]), F.lit(0.0))).alias("score"),
    ))
    return j.withColumn("suit", bumped).drop("_a")


def adaptive_weight(change_fraction: Column, base: float, adaptive: float, low: float, high: float) -> Column:
    """Neighbourhood weight by predicted change fraction."""
    return F.when((change_fraction <= low) | (change_fraction >= high), F.lit(adaptive)).otherwise(F.lit(base))


def _score_of(cls: Column) -> Column:
    hit = F.filter("suit", lambda x: x["cls"] == cls)
    return F.try_element_at(hit, F.lit(1))["score"]


def _allowed(frm: Column, to: Column, allowed: Sequence[tuple[int, int]] | None) -> Column:
    if allowed is None:
        return F.lit(True)
    out = frm == to
    for a, b in allowed:
        out = out | ((frm == int(a)) & (to == int(b)))
    return out


def stay_phase(
    cells: DataFrame, keys: Sequence[str], remaining: DataFrame,
    allowed: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Add ``stays``: the first ``remaining`` cells per class by (margin, stay, row, col).

    Margin is the stay score minus the best open change score (infinite if none).
    """
    opened = remaining.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("cls", "remaining"))).alias("_open")
    )
    c = join_small(cells, opened, keys)
    here = F.coalesce(F.try_element_at("_open", F.col("start_cls")), F.lit(0))
    others = F.filter("suit", lambda x: (
        (x["cls"] != F.col("start_cls"))
        & (F.coalesce(F.try_element_at(F.col("_open"), x["cls"]), F.lit(0)) > 0)
        & _allowed(F.col("start_cls"), x["cls"], allowed)
    ))
    best = F.array_max(F.transform(others, lambda x: x["score"]))
    stay = _score_of(F.col("start_cls"))
    margin = F.coalesce(stay - best, F.lit(float("inf")))
    c = c.withColumns({"_cap": here, "_m": -margin, "_s": -stay})
    c = c.withColumn("_in", (F.col("_cap") > 0) & F.col("_s").isNotNull())
    k = [*keys, "start_cls", "_in"]
    ranked = group_rank(c.fillna({"_s": 0.0}), k, ["_m", "_s", *POS], "_rk", bound=group_stats(cells, [*keys, "start_cls"]))
    return ranked.withColumn("stays", F.col("_in") & (F.col("_rk") <= F.col("_cap"))).drop(
        "_open", "_cap", "_m", "_s", "_in", "_rk"
    )


def capacity_greedy(
    free: DataFrame, keys: Sequence[str], capacity: DataFrame, allowed: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Assign free cells to classes greedily by (score desc, row, col, class).

    ``capacity`` is (keys, cls, cap).  Adds ``to_cls`` (NULL when every class the
    cell may enter filled up with better cells) and ``score``.
    """
    keys = list(keys)
    opened = capacity.filter("cap > 0")
    pref = F.array_sort(F.transform(
        F.filter("suit", lambda x: _allowed(F.col("start_cls"), x["cls"], allowed)),
        lambda x: F.struct((-x["score"]).alias("o"), x["cls"].alias("cls")),
    ))
    cells = cut_lineage(free.withColumn("_pref", pref))
    bound = group_stats(cells, keys)  # proposals of a class are fewer than the free cells
    last = F.struct(F.lit(float("inf")).alias("o"), F.lit(2147483647).alias("row"), F.lit(2147483647).alias("col"))
    limits = opened.select(*keys, "cls", "cap", last.alias("lim"))
    limits = cut_lineage(limits)
    while True:
        proposals = _propose(cells, keys, limits)
        over = (
            proposals.filter("to_cls is not null").groupBy(*keys, F.col("to_cls").alias("cls"))
            .agg(F.count(F.lit(1)).alias("_n")).join(limits.select(*keys, "cls", "cap"), [*keys, "cls"])
            .filter("_n > cap")
        )
        over = cut_lineage(over)
        n_over = over.count()
        if n_over == 0:
            return proposals.drop("_pref")
        ck = [*keys, "to_cls"]
        crowd = join_small(proposals, over.select(*keys, F.col("cls").alias("to_cls"), "cap"), ck, n_over, "inner")
        ranked = group_rank(crowd, ck, [-F.col("score"), *POS], "_rk", bound=bound)
        cut = ranked.filter("_rk = cap").select(
            *keys, F.col("to_cls").alias("cls"),
            F.struct((-F.col("score")).alias("o"), "row", "col").alias("_cut"),
        )
        limits = cut_lineage(limits.join(cut, [*keys, "cls"], "left").select(
            *keys, "cls", "cap", F.coalesce("_cut", "lim").alias("lim")
        ))


def _propose(cells: DataFrame, keys: list[str], limits: DataFrame) -> DataFrame:
    """Best class whose threshold the cell passes; the limits are one row per open class."""
    packed = limits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cls", "lim"))).alias("_lim"))
    c = join_small(cells, packed, keys)

    def passes(x: Column) -> Column:
        lim = F.try_element_at(F.col("_lim"), x["cls"])
        mine = F.struct(x["o"].alias("o"), F.col("row").alias("row"), F.col("col").alias("col"))
        return lim.isNotNull() & (mine <= lim)

    first = F.try_element_at(F.filter("_pref", passes), F.lit(1))
    return c.withColumns({"to_cls": first["cls"], "score": -first["o"]}).drop("_lim")


def allocate(
    cells: DataFrame, keys: Sequence[str], demand: DataFrame, can_edit: Column | None = None,
    allowed: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Stay phase, change phase, then leftovers; adds ``alloc_cls``, ``phase`` and ``alloc_score``.

    Equals the cell-by-cell greedy exactly. With restricted transitions a stay or a change is taken only while the rest
    of the demand can still be met by the cells left; a demand that cannot be met at all is filled in row-major order.
    """
    keys = list(keys)
    cells = cells.withColumn("_edit", F.lit(True) if can_edit is None else can_edit)
    rem = cut_lineage(remaining_demand(cells, keys, demand, F.col("_edit")))
    if not rem.filter("infeasible").isEmpty():
        raise DemandError("fixed cells exceed the demand of a class")
    edit = cells.filter("_edit")
    if allowed is None:
        staged = cut_lineage(stay_phase(edit, keys, rem.select(*keys, "cls", "remaining"), allowed))
        stays, movers = staged.filter("stays").drop("stays"), staged.filter("not stays").drop("stays")
        stayed = stays.groupBy(*keys, F.col("start_cls").alias("cls")).agg(F.count(F.lit(1)).alias("_n"))
        cap = rem.join(stayed, [*keys, "cls"], "left").select(
            *keys, "cls", (F.col("remaining") - F.coalesce("_n", F.lit(0))).alias("cap"))
        moved = capacity_greedy(movers, keys, cap, allowed)
        done = moved.filter("to_cls is not null")
        left = cut_lineage(moved.filter("to_cls is null").drop("to_cls", "score"))
        used = done.groupBy(*keys, F.col("to_cls").alias("cls")).agg(F.count(F.lit(1)).alias("_n"))
        cap2 = cap.join(used, [*keys, "cls"], "left").select(
            *keys, "cls", (F.col("cap") - F.coalesce("_n", F.lit(0))).alias("cap"))
    else:
        stays, done, left, cap2 = _restricted(edit, keys, rem, allowed)
    base = [c for c in cells.columns if c != "_edit"]
    parts = [
        cells.filter("not _edit").select(*base, F.col("start_cls").alias("alloc_cls"), F.lit("fixed").alias("phase"),
                                         F.lit(None).cast("double").alias("alloc_score")),
        stays.select(*base, F.col("start_cls").alias("alloc_cls"), F.lit("stay").alias("phase"),
                                      F.lit(None).cast("double").alias("alloc_score")),
        done.select(*base, F.col("to_cls").alias("alloc_cls"), F.lit("change").alias("phase"),
                    F.col("score").alias("alloc_score")),
    ]
    if not left.isEmpty():
        parts.append(_leftovers(left, keys, cap2, allowed, base))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _restricted(edit: DataFrame, keys: list[str], rem: DataFrame, allowed: Sequence[tuple[int, int]]):
    """(staying cells, changed cells, cells left, what is still wanted) under the flow test before every step."""
    wanted = rem.filter("remaining > 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cls", "remaining"))).alias("_open"))
    cells = cut_lineage(join_small(edit, wanted, keys))
    wants = lambda c: F.coalesce(F.try_element_at("_open", c), F.lit(0)) > 0
    state = flow.start_state(cells, keys, rem, allowed)
    stay = _score_of(F.col("start_cls"))
    others = F.filter("suit", lambda x: (x["cls"] != F.col("start_cls")) & wants(x["cls"]) & _allowed(F.col("start_cls"), x["cls"], allowed))
    margin = F.coalesce(stay - F.array_max(F.transform(others, lambda x: x["score"])), F.lit(float("inf")))
    one = F.when(wants(F.col("start_cls")) & stay.isNotNull(), F.array(F.struct(
        (-margin).alias("o1"), (-stay).alias("o2"), F.col("start_cls").alias("cls"), stay.alias("score"))))
    stays, free, state = flow.greedy_phase(cells, keys, state, one, allowed)
    own = F.col("start_cls")
    many = F.array_sort(F.transform(
        F.filter("suit", lambda x: _allowed(own, x["cls"], allowed)),
        lambda x: F.struct(
            (-(x["score"] + F.when(x["cls"] == own, OWN_BONUS).otherwise(0.0))).alias("o1"), F.lit(0.0).alias("o2"), x["cls"].alias("cls"),
            (x["score"] + F.when(x["cls"] == own, OWN_BONUS).otherwise(0.0)).alias("score"))))
    done, left, state = flow.greedy_phase(free, keys, state, many, allowed)
    cap = state.select(*keys, F.explode("want").alias("cls", "cap"))
    done = done.withColumns({"to_cls": F.col("_to"), "score": F.col("_won")}).drop("_open", "_to", "_won")
    return stays.drop("_open", "_to", "_won"), done, cut_lineage(left.drop("_open")), cap


def _leftovers(left: DataFrame, keys: list[str], cap: DataFrame, allowed, base: list[str]) -> DataFrame:
    """Cells in row-major order take the lowest open class; none open -> stay, a violation."""
    flat = left.withColumn("_suit", F.col("suit")).withColumn(
        "suit", F.transform("suit", lambda x: F.struct(x["cls"].alias("cls"), F.lit(0.0).alias("score")))
    )
    got = capacity_greedy(flat, keys, cap, allowed).withColumn("suit", F.col("_suit"))
    return got.select(
        *base, F.coalesce("to_cls", "start_cls").alias("alloc_cls"),
        F.when(F.col("to_cls").isNull(), "violation").otherwise("leftover").alias("phase"),
        _score_of(F.col("to_cls")).alias("alloc_score"),
    )


def allocate_to_change(
    cells: DataFrame, keys: Sequence[str], demand: DataFrame, target: DataFrame, can_edit: Column | None = None,
    allowed: Sequence[tuple[int, int]] | None = None, min_margin: float | None = None, min_base: float | None = None,
    **gates,
) -> DataFrame:
    """``allocate`` and then balanced swaps until (keys, target_change) cells have changed, phase ``swap``.

    A swap changes two cells and no class total, so the demand stays met; fixed cells never move. ``gates`` go to
    ``swap_sides``. A negative target raises.
    """
    keys = list(keys)
    if not target.filter("target_change < 0").isEmpty():
        raise DemandError("target_change must not be negative")
    done = cut_lineage(allocate(cells, keys, demand, can_edit, allowed))
    changed = done.groupBy(*keys).agg(F.sum((F.col("alloc_cls") != F.col("start_cls")).cast("long")).alias("_n"))
    budgets = target.join(changed, keys).select(
        *keys, F.greatest(F.lit(0), F.floor((F.col("target_change") - F.col("_n")) / 2)).cast("bigint").alias("n_swaps"))
    moved = balanced_swaps(swap_sides(done, keys, allowed=allowed, **gates), keys, budgets, min_margin, min_base)
    j = done.join(moved.select(*keys, *POS, F.col("to_cls").alias("_to")), [*keys, *POS], "left")
    return j.select(
        *[c for c in done.columns if c not in ("alloc_cls", "phase", "alloc_score")],
        F.coalesce("_to", "alloc_cls").alias("alloc_cls"), F.when(F.col("_to").isNotNull(), "swap").otherwise(F.col("phase")).alias("phase"),
        F.when(F.col("_to").isNotNull(), _score_of(F.col("_to"))).otherwise(F.col("alloc_score")).alias("alloc_score"))


def allocation_result(allocated: DataFrame, keys: Sequence[str], demand: DataFrame, cls: str = "alloc_cls") -> DataFrame:
    """Target, achieved and unmet cells per class."""
    a = allocated.groupBy(*keys, F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("_a"))
    j = demand.join(a, [*keys, "cls"], "full_outer")
    t, g = F.coalesce("n", F.lit(0)), F.coalesce("_a", F.lit(0))
    return j.select(
        *keys, "cls", t.alias("target"), g.alias("achieved"), F.greatest(F.lit(0), t - g).alias("unmet"),
        (t != g).alias("violated"),
    )


def selected_transitions(allocated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return allocated.filter("alloc_cls <> start_cls").select(
        *keys, *POS, F.col("start_cls").alias("from_cls"), F.col("alloc_cls").alias("to_cls"), "phase", "alloc_score"
    )


def feasibility(
    supply: DataFrame, need: DataFrame, keys: Sequence[str], allowed: Sequence[tuple[int, int]],
) -> DataFrame:
    """Can the needs (keys, cls, n) be met by the free cells (keys, cls, n) under allowed transitions? By maximum flow."""
    return flow.flow_shortfall(supply, need, keys, allowed)


# ---- balanced swaps ----------------------------------------------------------

def swap_sides(
    cells: DataFrame, keys: Sequence[str], cls: str = "alloc_cls", allowed: Sequence[tuple[int, int]] | None = None,
    bonus: str | None = None, min_side_base: float | None = None, min_target_nb: float | None = None,
    evidence: Sequence[tuple[int, int]] = (), min_pair_side: float | None = None, base: str = "suit", nb: str | None = None,
    can_edit: Column | None = None,
) -> DataFrame:
    """Long (cell, a, b, s, m, base): stable cells of class a and their worth as class b.

    Cells outside ``can_edit`` and cells in phase ``fixed`` stay out.

    Gates that look at one side only are row filters here; ``m`` is the gain over
    staying and ``base`` the score without neighbourhood terms, for pair gates.
    ``bonus``/``nb``/``base`` are columns: MAP, MAP and array of struct(cls, score).
    """
    def of(col: str, c: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(col), c), F.lit(0.0))

    base_of = F.map_from_entries(F.transform(base, lambda x: F.struct(x["cls"], x["score"])))
    free = F.lit(True) if can_edit is None else can_edit
    if "phase" in cells.columns:
        free = free & (F.col("phase") != "fixed")
    c = cells.filter((F.col(cls) == F.col("start_cls")) & free)
    own = base == "suit"  # then the score itself, with no map to carry along
    long = c.select(
        *keys, *POS, F.col("start_cls").alias("a"), *([] if own else [base_of.alias("_base")]), *[x for x in (bonus, nb) if x],
        _score_of(F.col("start_cls")).alias("_stay"), F.explode("suit").alias("_t"),
    ).select("*", F.col("_t.cls").alias("b"), F.col("_t.score").alias("_sc")).filter("a <> b and _stay is not null")
    if allowed is not None:
        long = long.filter(_allowed(F.col("a"), F.col("b"), allowed) & _allowed(F.col("b"), F.col("a"), allowed))
    raw = F.coalesce("_sc", F.lit(0.0)) if own else of("_base", F.col("b"))
    if min_side_base is not None:
        long = long.filter(raw >= min_side_base)
    if min_target_nb is not None and nb:
        long = long.filter(of(nb, F.col("b")) >= min_target_nb)
    if min_pair_side is not None:
        pairs = {tuple(sorted((int(x), int(y)))) for x, y in evidence}
        if not pairs:
            raise DemandError("evidence pairs are required with a pair-side floor")
        gated = F.lit(False)
        for x, y in pairs:
            gated = gated | ((F.least("a", "b") == x) & (F.greatest("a", "b") == y))
        long = long.filter(~gated | (F.col("_sc") >= min_pair_side))
    extra = of(bonus, F.col("b")) if bonus else F.lit(0.0)
    return long.select(
        *keys, *POS, "a", "b", (F.col("_sc") + extra).alias("s"), (F.col("_sc") - F.col("_stay")).alias("m"),
        raw.alias("base"),
    )


SLICE_ROWS = 400  # cells of one side that a swap task takes
THIN_ROWS = 1 << 18  # rows that a task holds while it drops those that never swap


def _undominated(live: DataFrame, keys: list[str], mm: float, mb: float, thin_rows: int = THIN_ROWS) -> DataFrame:
    """``live`` without cells that never swap, as far as each task sees for itself; nothing is shuffled.

    A swap uses up one cell of class a at most. So a cell with ``_want`` cells before it in its list (a, b) that meet
    any pair condition it meets is never taken: one of them is free, and goes first. Under both conditions only cells of
    equal ``base`` are compared.
    """
    value = "m" if mm > float("-inf") else "base" if mb > float("-inf") else None
    lists = [*keys, "a", "b", *(["base"] if mm > float("-inf") and mb > float("-inf") else [])]

    def thin(table: pa.Table) -> pa.Table:
        code = table.select(lists).to_pandas().groupby(lists, sort=False, dropna=False).ngroup().to_numpy()
        s, row, col, want = (table[c].to_numpy() for c in ("s", *POS, "_want"))
        worth = table[value].to_numpy() if value else np.zeros(len(s))
        order = np.lexsort((col, row, -s, code))
        real = ~(np.isnan(s) | np.isnan(worth))  # others stay and count for nothing
        kept, best, now = [], [], -1  # best: the largest _want values of the list so far
        for i, c, v, w, ok in zip(*(x.tolist() for x in (order, code[order], worth[order], want[order], real[order]))):
            if c != now:
                best, now = [], c
            if not ok:
                kept.append(i)
            elif len(best) < w:
                heapq.heappush(best, v)
                kept.append(i)
            elif v > best[0]:
                heapq.heapreplace(best, v)
                kept.append(i)
        return table.take(pa.array(kept, pa.int64()))

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= thin_rows:
                held = thin(pa.Table.from_batches(held)).combine_chunks().to_batches()
                rows = sum(x.num_rows for x in held)
                if 2 * rows > thin_rows:  # few can go: what a task holds stays bounded
                    yield from held
                    held, rows = [], 0
        if rows:
            yield from thin(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return live.mapInArrow(run, live.schema)


def _pair_off(left: pd.DataFrame, right: pd.DataFrame, budget: int, min_margin: float, min_base: float) -> list[tuple]:
    """Greedy swaps between two lists, both by (s desc, row, col), ignoring all other lists.

    Returns at most ``budget`` (score, left cell, right cell) by (score desc, earlier cell, later cell).
    """
    def plus(column: str) -> np.ndarray:
        return left[column].to_numpy(float)[:, None] + right[column].to_numpy(float)[None, :]

    score = plus("s")
    score[(plus("m") < min_margin) | (plus("base") < min_base)] = -np.inf
    rows, cols = (list(zip(x["row"].tolist(), x["col"].tolist())) for x in (left, right))
    taken: list = []
    if not score.size:
        return taken
    best = score.argmax(axis=1)  # the first of equal ones is the earliest cell
    value = score[np.arange(len(best)), best]
    while len(taken) < budget and value.max() > -np.inf:
        i = min(np.flatnonzero(value == value.max()).tolist(), key=lambda k: sorted((rows[k], cols[best[k]])))
        j = best[i]
        taken.append((float(value[i]), rows[i], cols[j]))
        score[i], score[:, j] = -np.inf, -np.inf
        again = np.flatnonzero(best == j)
        best[again] = score[again].argmax(axis=1)
        value[again] = score[again, best[again]]
    return taken


def _order(score: Column, x: Column, y: Column) -> Column:
    """Place of a pair among all pairs: score desc, earlier cell, later cell."""
    cells = F.array_sort(F.array(x, y))
    return F.struct((-score).alias("o"), cells[0].alias("lo"), cells[1].alias("hi"))


def _rank_pairs(live: DataFrame, keys: list[str], bound) -> DataFrame:
    """The k-th best cell of (a, b) with the k-th best of (b, a): what pairing off one class pair alone gives."""
    cell = F.struct("row", "col")
    ranked = group_rank(live, [*keys, "a", "b"], [-F.col("s"), *POS], "_rk", bound=bound)
    one = ranked.filter("a < b").select(*keys, "a", "b", "_rk", F.col("s").alias("_s"), cell.alias("_x"))
    two = ranked.filter("a > b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "_rk", F.col("s").alias("_t"), cell.alias("_y"))
    return one.join(two, [*keys, "a", "b", "_rk"]).select(
        *keys, "a", "b", "_x", "_y", _order(F.col("_s") + F.col("_t"), F.col("_x"), F.col("_y")).alias("_order"))


def _slice_pairs(live: DataFrame, keys: list[str], left: DataFrame, mm: float, mb: float) -> tuple[DataFrame, DataFrame]:
    """(pairs found, first pair that may be unseen by area): slices in view paired off, one task for each two slices.

    In view are the slices p and q of the two lists, counted among those with live cells, with p + q <= _depth.
    """
    lk = [*keys, "a", "b"]
    cell = F.struct("row", "col")
    slices = live.groupBy(*lk, "_slice").agg(F.min(F.struct((-F.col("s")).alias("o"), cell.alias("at"))).alias("_top"))
    nth = F.row_number().over(W.partitionBy(*lk).orderBy("_slice")) - 1
    by_list = slices.withColumn("_i", nth).join(left.select(*keys, "_depth", "_want"), keys).filter("_i <= _depth + 1")
    one = by_list.filter("a < b").select(*keys, "a", "b", "_depth", "_want", F.col("_i").alias("_p"), F.col("_slice").alias("_s1"), F.col("_top").alias("_t1"))
    two = by_list.filter("a > b").select(
        *keys, F.col("b").alias("a"), F.col("a").alias("b"), F.col("_i").alias("_q"), F.col("_slice").alias("_s2"), F.col("_top").alias("_t2"))
    blocks = cut_lineage(one.join(two, lk).filter("_p + _q <= _depth + 1"))
    unseen = blocks.filter("_p + _q > _depth").groupBy(*keys).agg(F.min(_order(
        -(F.col("_t1.o") + F.col("_t2.o")), F.col("_t1.at"), F.col("_t2.at"))).alias("_unseen"))
    seen = blocks.filter("_p + _q <= _depth")
    sent = [
        live.join(seen.select(
            *keys, F.col(x).alias("a"), F.col(y).alias("b"), F.col(n).alias("_slice"), F.col("a").alias("_u"), F.col("b").alias("_v"),
            "_s1", "_s2", "_want"), [*lk, "_slice"])
        for x, y, n in (("a", "b", "_s1"), ("b", "a", "_s2"))]
    kinds = {f.name: f.dataType.simpleString() for f in live.schema.fields}
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", a int, b int, score double, r1 int, c1 int, r2 int, c2 int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = (int(x) for x in key[len(keys) : len(keys) + 2])
        both = [pdf[pdf["a"] == k].sort_values(["s", "row", "col"], ascending=[False, True, True]) for k in (u, v)]
        got = _pair_off(*both, int(pdf["_want"].iloc[0]), mm, mb)
        recs = [(*key[: len(keys)], u, v, score, *x, *y) for score, x, y in got]
        return pd.DataFrame(recs, columns=[*keys, "a", "b", "score", "r1", "c1", "r2", "c2"])

    x, y = (F.struct(F.col(r).alias("row"), F.col(c).alias("col")) for r, c in (("r1", "c1"), ("r2", "c2")))
    found = sent[0].unionByName(sent[1]).groupBy(*keys, "_u", "_v", "_s1", "_s2").applyInPandas(run, shape)
    return found.select(*keys, "a", "b", x.alias("_x"), y.alias("_y"), _order(F.col("score"), x, y).alias("_order")), unseen


def balanced_swaps(
    sides: DataFrame, keys: Sequence[str], budgets: DataFrame, min_margin: float | None = None,
    min_base: float | None = None, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Swap stable cells of two classes by best pair score until the change budget is used.

    ``sides`` comes from ``swap_sides``; ``budgets`` is (keys, n_swaps). Pairs go by (score desc, earlier cell, later
    cell). Returns (keys, row, col, from_cls, to_cls), equal to taking one pair after the other.

    First each task drops the cells that enough better ones of its own make needless, so what is ranked, shuffled and kept
    from round to round hardly grows with the cells.

    Each round pairs off every class pair as if there were no others. Removing a cell from a list only lowers the pairs
    that come after, so all pairs that go before the area's limit are final: the first pair with a cell that an earlier
    pair has as well. Each round takes the pairs before the limit and removes their cells. Without pair conditions the
    pairs are those of equal rank. With conditions, lists are ranked once and cut into slices, two slices are paired off in
    a task of bounded size, and the limit is also the best pair that slices not yet in view could hold; a round that takes
    none brings more slices into view.
    """
    keys = list(keys)
    spark = sides.sparkSession
    mm = float("-inf") if min_margin is None else float(min_margin)
    mb = float("-inf") if min_base is None else float(min_base)
    plain = min_margin is None and min_base is None
    lk = [*keys, "a", "b"]
    left = cut_lineage(budgets.filter("n_swaps > 0").select(
        *keys, F.col("n_swaps").cast("bigint").alias("_want"), F.lit(0).cast("bigint").alias("_depth")))
    live = cut_lineage(_undominated(join_small(sides, left.select(*keys, "_want"), keys, how="inner"), keys, mm, mb))
    if not plain:  # cells that no cell of the other side can make up for never swap
        other = live.groupBy(*keys, F.col("b").alias("a"), F.col("a").alias("b")).agg(F.max("m").alias("_om"), F.max("base").alias("_ob"))
        live = live.join(other, lk).filter((F.col("m") + F.col("_om") >= mm) & (F.col("base") + F.col("_ob") >= mb)).drop("_om", "_ob")
    live = group_rank(live, lk, [-F.col("s"), *POS], "_rk")
    if plain:  # each swap uses up one cell of a list at most
        live = live.filter(F.col("_rk") <= F.col("_want"))
    live = cut_lineage(live.withColumn("_slice", F.floor((F.col("_rk") - 1) / slice_rows)).drop("_rk", "_want"))
    bound = group_stats(live, keys)
    done = None
    while not left.isEmpty():
        if plain:
            found, unseen = _rank_pairs(live, keys, bound), left.select(*keys, F.lit(None).alias("_unseen"))
        else:
            found, unseen = _slice_pairs(live, keys, left, mm, mb)
        found = cut_lineage(found)
        # orders of one cell: at most one for each task that has it
        second = F.get(F.array_sort(F.collect_list("_order")), F.lit(1))
        clash = found.select(*keys, F.explode(F.array("_x", "_y")).alias("_cell"), "_order").groupBy(*keys, "_cell").agg(
            second.alias("_clash")).groupBy(*keys).agg(F.min("_clash").alias("_clash"))
        state = cut_lineage(left.join(clash, keys, "left").join(unseen, keys, "left"))
        final = F.col("_clash").isNull() | (F.col("_order") < F.col("_clash"))
        if not plain:
            final = final & (F.col("_unseen").isNull() | (F.col("_order") < F.col("_unseen")))
        got = cut_lineage(group_rank(found.join(state, keys).filter(final), keys, ["_order"], "_rk", bound=bound).filter(
            "_rk <= _want").select(*keys, "a", "b", "_x", "_y"))
        swaps = got.select(*keys, F.inline(F.array(*(
            F.struct(F.col(x)["row"].alias("row"), F.col(x)["col"].alias("col"), F.col(f).alias("from_cls"), F.col(t).alias("to_cls"))
            for x, f, t in (("_x", "a", "b"), ("_y", "b", "a"))))))
        done = swaps if done is None else done.unionByName(swaps)
        taken = F.coalesce("_t", F.lit(0))
        # without more slices and without a clash everything found is final
        left = cut_lineage(state.join(got.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t")), keys, "left").filter(
            (taken < F.col("_want")) & (F.col("_clash").isNotNull() | F.col("_unseen").isNotNull())).select(
            *keys, (F.col("_want") - taken).alias("_want"), F.when(taken == 0, 2 * F.col("_depth") + 1).otherwise(F.col("_depth")).alias("_depth")))
        if not left.isEmpty():
            live = cut_lineage(live.join(left.select(*keys), keys, "left_semi").join(swaps.select(*keys, *POS), [*keys, *POS], "left_anti"))
    if done is None:
        kinds = {f.name: f.dataType.simpleString() for f in sides.schema.fields}
        return spark.createDataFrame([], ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", row int, col int, from_cls int, to_cls int")
    return done
