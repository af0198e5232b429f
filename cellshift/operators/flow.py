"""Greedy assignment under restricted transitions, with the test that what is left can still be met.

A state is, per key, how many cells of each start class are unassigned and how much of each class is still wanted.
Taking a cell never widens what can be met later, so a pair (from, to) that would make the rest infeasible is closed
for good, and along a fixed order of proposals the feasible steps are a prefix. Each round every cell proposes its best
open pair, the end of the feasible prefix is found from counts of proposals by slice of their order (slices a thousand
times narrower each pass), everything before it is taken, and the pairs that are now closed drop out. Rounds are
bounded by the number of pairs; only class-sized counts leave the executors' sorted cells.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import group_rank, group_row_limit, join_small

SLICES = 1_000
WIDE_ROWS = 1 << 18  # cells with all their choices that one task sorts
POS = ("row", "col")
Pair = tuple[int, int]


def max_flow(have: Mapping[int, int], want: Mapping[int, int], may: set[Pair]) -> int:
    """How much of ``want`` the classes of ``have`` can supply; a class may always supply itself."""
    sources = [c for c, n in have.items() if n > 0]
    sinks = [c for c, n in want.items() if n > 0]
    free, need = {c: have[c] for c in sources}, {c: want[c] for c in sinks}
    sent = {(a, b): 0 for a in sources for b in sinks if a == b or (a, b) in may}
    total = 0
    while True:
        came: dict[tuple[str, int], tuple[str, int] | None] = {("s", a): None for a in sources if free[a] > 0}
        queue, end = deque(came), None
        while queue and end is None:
            side, c = node = queue.popleft()
            if side == "s":
                nxt = [("t", b) for a, b in sent if a == c]
            elif need[c] > 0:
                end = node
                break
            else:
                nxt = [("s", a) for (a, b), n in sent.items() if b == c and n > 0]
            for x in nxt:
                if x not in came:
                    came[x] = node
                    queue.append(x)
        if end is None:
            return total
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        back = [sent[b[1], a[1]] for a, b in steps if a[0] == "t"]
        push = min([free[path[0][1]], need[end[1]], *back])
        for a, b in steps:
            if a[0] == "s":
                sent[a[1], b[1]] += push
            else:
                sent[b[1], a[1]] -= push
        free[path[0][1]] -= push
        need[end[1]] -= push
        total += push


def feasible(have: Mapping[int, int], want: Mapping[int, int], may: set[Pair]) -> bool:
    if min(want.values(), default=0) < 0 or min(have.values(), default=0) < 0:
        return False
    return max_flow(have, want, may) == sum(want.values())


def open_pairs(have: Mapping[int, int], want: Mapping[int, int], may: set[Pair]) -> list[Pair]:
    """Pairs that can be taken once more with the rest still feasible."""
    out = []
    for a, n in have.items():
        for b, m in want.items():
            if n > 0 and m > 0 and (a == b or (a, b) in may):
                if feasible({**have, a: n - 1}, {**want, b: m - 1}, may):
                    out.append((a, b))
    return out


def _state_schema(keys: Sequence[str], like: DataFrame) -> str:
    parts = [f"`{k}` {like.schema[k].dataType.simpleString()}" for k in keys]
    return ", ".join([*parts, "have map<int,bigint>", "want map<int,bigint>", "pairs array<struct<a:int,b:int>>",
                      "start bigint", "whole boolean"])


def _row(key: tuple, have: dict, want: dict, may: set[Pair], start: int, whole: bool) -> pd.DataFrame:
    pairs = [{"a": a, "b": b} for a, b in open_pairs(have, want, may)]
    return pd.DataFrame([[*key, dict(have), dict(want), pairs, start, whole]])


def _ints(m) -> dict[int, int]:
    return {int(k): int(v) for k, v in (m.items() if hasattr(m, "items") else m)}


def start_state(cells: DataFrame, keys: Sequence[str], remaining: DataFrame, may: Iterable[Pair]) -> DataFrame:
    """State of each key from its editable cells and (keys, cls, remaining), with its open pairs."""
    keys, may = list(keys), {(int(a), int(b)) for a, b in may}
    have = cells.groupBy(*keys, F.col("start_cls").alias("cls")).agg(F.count(F.lit(1)).alias("h"))
    both = have.join(remaining.select(*keys, "cls", F.col("remaining").alias("w")), [*keys, "cls"], "full_outer").fillna(0, ["h", "w"])

    def make(key, pdf):
        h = {int(c): int(n) for c, n in zip(pdf["cls"], pdf["h"])}
        w = {int(c): int(n) for c, n in zip(pdf["cls"], pdf["w"])}
        out = _row(key, h, w, may, 0, False)
        out.columns = [*keys, "have", "want", "pairs", "start", "whole"]
        return out

    return both.groupBy(*keys).applyInPandas(make, _state_schema(keys, cells))


def greedy_phase(
    cells: DataFrame, keys: Sequence[str], state: DataFrame, choices: Column, may: Iterable[Pair],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taken cells with _to and _won, the class and its score, cells left, state after) of one greedy phase.

    ``choices`` is each cell's ARRAY of struct(o1, o2, cls, score), best first; all choices of all cells are taken in the
    order (o1, o2, row, col, cls) as far as the cell is free and the pair open.
    """
    keys, may = list(keys), {(int(a), int(b)) for a, b in may}
    schema = _state_schema(keys, cells)
    base = cells.columns
    left = cut_lineage(cells.withColumn("_choices", choices))
    state = cut_lineage(state.withColumns({"start": F.lit(0).cast("bigint"), "whole": F.lit(False)}))
    taken, rest = None, None

    def step(width: int):
        def run(key, pdf):
            first = pdf.iloc[0]
            have, want = _ints(first["have"]), _ints(first["want"])
            counts: dict[int, dict[Pair, int]] = {}
            for s, a, b, n in zip(pdf["_s"], pdf["start_cls"], pdf["_b"], pdf["_n"]):
                counts.setdefault(int(s), {})[int(a), int(b)] = int(n)
            order = sorted(counts)

            def after(k: int) -> tuple[dict, dict]:
                h, w = dict(have), dict(want)
                for s in order[:k]:
                    for (a, b), n in counts[s].items():
                        h[a] -= n
                        w[b] -= n
                return h, w

            lo, hi = 0, len(order)
            while lo < hi:  # the longest run of whole slices that is feasible
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if feasible(*after(mid), may) else (lo, mid - 1)
            whole = lo == len(order)
            start = int(first["start"]) + ((order[-1] + 1 if whole else order[lo]) * width if order else 0)
            out = _row(key, *after(lo), may, start, whole)
            out.columns = [*keys, "have", "want", "pairs", "start", "whole"]
            return out

        return run

    while True:
        packed = state.select(*keys, F.col("pairs").alias("_pairs"))
        opened = F.filter("_choices", lambda x: F.exists(
            "_pairs", lambda p: (p["a"] == F.col("start_cls")) & (p["b"] == x["cls"])))
        now = join_small(left, packed, keys).withColumn("_pick", F.get(opened, 0)).drop("_pairs")
        now = cut_lineage(now)
        idle = now.filter("_pick is null").select(*base)
        rest = idle if rest is None else rest.unionByName(idle)
        live = now.filter("_pick is not null").withColumn("_b", F.col("_pick.cls"))
        if live.isEmpty():
            break
        order = [F.col("_pick.o1"), F.col("_pick.o2"), *POS, "_b"]
        live = cut_lineage(group_rank(live, keys, order, "_rk", limit=min(WIDE_ROWS, group_row_limit(live))))
        most = live.agg(F.max("_rk")).first()[0]
        width = 1
        while width * SLICES < most:
            width *= SLICES
        while width:
            j = join_small(live.select(*keys, "start_cls", "_b", "_rk"), state.filter("not whole"), keys, how="inner")
            at = F.col("_rk") - 1 - F.col("start")
            j = j.filter((at >= 0) & (at < width * SLICES)).withColumn("_s", F.floor(at / width).cast("bigint"))
            hist = j.groupBy(*keys, "_s", "start_cls", "_b").agg(F.count(F.lit(1)).alias("_n"))
            hist = join_small(hist, state, keys, how="inner")
            found = hist.groupBy(*keys).applyInPandas(step(width), schema)
            state = cut_lineage(found.unionByName(state.join(found.select(*keys), keys, "left_anti")))
            width //= SLICES
        j = join_small(live, state.select(*keys, F.col("start").alias("_start")), keys)
        got = j.filter("_rk <= _start").select(*base, F.col("_b").alias("_to"), F.col("_pick.score").alias("_won"))
        taken = got if taken is None else taken.unionByName(got)
        left = cut_lineage(j.filter("_rk > _start").select(*base, "_choices"))
        state = cut_lineage(state.withColumns({"start": F.lit(0).cast("bigint"), "whole": F.lit(False)}))
        if left.isEmpty():
            break
    if taken is None:
        taken = cells.limit(0).withColumns({"_to": F.lit(None).cast("int"), "_won": F.lit(None).cast("double")})
    return taken, rest, state


def flow_shortfall(supply: DataFrame, need: DataFrame, keys: Sequence[str], may: Iterable[Pair]) -> DataFrame:
    """(keys, shortfall, feasible): what of (keys, cls, n) needs the supplies cannot meet, by maximum flow."""
    keys, may = list(keys), {(int(a), int(b)) for a, b in may}
    parts = ", ".join(f"`{k}` {supply.schema[k].dataType.simpleString()}" for k in keys)
    both = supply.select(*keys, "cls", F.col("n").alias("h")).join(
        need.select(*keys, "cls", F.greatest("n", F.lit(0)).alias("w")), [*keys, "cls"], "full_outer").fillna(0, ["h", "w"])

    def run(key, pdf):
        h, w = ({int(c): int(n) for c, n in zip(pdf["cls"], pdf[x])} for x in ("h", "w"))
        short = sum(w.values()) - max_flow(h, w, may)
        return pd.DataFrame([[*key, short, short == 0]], columns=[*keys, "shortfall", "feasible"])

    return both.groupBy(*keys).applyInPandas(run, f"{parts}, shortfall bigint, feasible boolean")
