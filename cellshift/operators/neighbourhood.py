"""Neighbourhood operators on keyed cells.

A cell is copied to the rows above and below it (window height, not window
area), the copies are hashed once by raster row, summed per position, and a
range frame along the row does the rest.  Both steps share that one shuffle.
Partitions are single raster rows, so a huge area spreads over many tasks.
Missing cells are simply absent; no dense rectangle is assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from ..functions.columns import f1_score, ratio
from .ranking import join_small


def _along_row(keys: Sequence[str], r: int):
    return W.partitionBy(*keys, "row").orderBy("col").rangeBetween(-r, r)


def _spread(cells: DataFrame, keys: Sequence[str], rows: Column) -> DataFrame:
    """Copy cells to neighbouring rows: ``_dr`` = source row - position row."""
    out = cells.select("*", F.explode(rows).alias("_dr"))
    out = out.withColumn("_src", F.col("row")).withColumn("row", F.col("row") - F.col("_dr"))
    return out.repartition(*keys, "row")


def box_counts(
    cells: DataFrame, keys: Sequence[str], cls: str, classes: Sequence[int], radii: Sequence[int],
    prefix: str = "_b",
) -> DataFrame:
    """Add ``{prefix}{r}_{class}`` and ``{prefix}{r}_n``: cells in the (2r+1)^2 box."""
    top = max(radii)
    rest = [c for c in cells.columns if c not in (*keys, "row", "col")]
    spread = _spread(cells, keys, F.sequence(F.lit(-top), F.lit(top)))
    marks = {f"{c}": F.col(cls) == F.lit(int(c)) for c in classes}
    marks["n"] = F.lit(True)
    near = {r: F.abs("_dr") <= r for r in radii}
    sums = [
        F.sum((near[r] & m).cast("int")).alias(f"_v{r}_{k}") for r in radii for k, m in marks.items()
    ]
    here = F.col("_dr") == 0
    col_sums = spread.groupBy(*keys, "row", "col").agg(
        F.max(here).alias("_is"), *[_own(cells, c, here) for c in rest], *sums
    )
    boxes = [
        F.sum(f"_v{r}_{k}").over(_along_row(keys, r)).alias(f"{prefix}{r}_{k}")
        for r in radii
        for k in marks
    ]
    out = col_sums.select(*cells.columns, "_is", *boxes).filter("_is")
    return out.drop("_is")


def _own(cells: DataFrame, name: str, here: Column) -> Column:
    """The cell's own value among the copies; fixed-width types stay in hash aggregation."""
    value = F.when(here, F.col(name))
    fixed = isinstance(cells.schema[name].dataType, (NumericType, BooleanType, DatetimeType))
    return (F.max(value) if fixed else F.first(value, True)).alias(name)


def _pick(classes: Sequence[int], of: Column, make) -> Column:
    out = F.lit(0.0)
    for c in classes:
        out = F.when(of == F.lit(int(c)), make(int(c))).otherwise(out)
    return out


def _fraction(cls: Column, c: int, r: int, prefix: str) -> Column:
    own = (cls == F.lit(c)).cast("int")
    n = F.col(f"{prefix}{r}_n") - 1
    return ratio(F.col(f"{prefix}{r}_{c}") - own, n)


def class_fractions(
    cells: DataFrame, keys: Sequence[str], cls: str, classes: Sequence[int], window: int = 3
) -> DataFrame:
    """Long (cell, class, fraction of existing neighbours of that class), non-zero only."""
    r = _radius(window)
    b = box_counts(cells, keys, cls, classes, [r])
    arr = F.array(
        *[
            F.struct(F.lit(int(c)).alias("nb_cls"), _fraction(F.col(cls), c, r, "_b").alias("fraction"))
            for c in classes
        ]
    )
    return b.select(*keys, "row", "col", F.inline(arr)).filter(F.col("fraction") > 0)


def _radius(window: int) -> int:
    if window < 3 or window % 2 == 0:
        raise ValueError(f"window must be an odd integer >= 3: {window}")
    return window // 2


def class_support(
    cells: DataFrame, keys: Sequence[str], classes: Sequence[int], windows: Sequence[int] = (3,)
) -> DataFrame:
    """Add target/source support: share of start-map neighbours with the predicted / start
    class, averaged over the window sizes."""
    if not windows:
        raise ValueError("windows must not be empty")
    radii = [_radius(w) for w in windows]
    b = box_counts(cells, keys, "start_cls", classes, radii)
    s, p = F.col("start_cls"), F.col("pred_cls")
    target = sum((_pick(classes, p, lambda c, r=r: _fraction(s, c, r, "_b")) for r in radii), F.lit(0.0))
    source = sum((_pick(classes, s, lambda c, r=r: _fraction(s, c, r, "_b")) for r in radii), F.lit(0.0))
    n = float(len(radii))
    out = b.withColumns({"target_support": target / F.lit(n), "source_support": source / F.lit(n)})
    return out.select(*cells.columns, "target_support", "source_support")


def extents(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid size per key: height and width."""
    return cells.groupBy(*keys).agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")
    )


def reflect_pad(cells: DataFrame, keys: Sequence[str], r: int) -> DataFrame:
    """Repeat the border cells mirrored outwards (edge cell included), ``r`` deep."""
    c = join_small(cells, extents(cells, keys), keys, how="inner")

    def mirror(x: Column, size: Column) -> Column:
        spots = F.array(
            x,
            F.when(x < r, -x - 1),
            F.when(x >= size - r, 2 * size - 1 - x),
        )
        return F.filter(spots, lambda v: v.isNotNull())

    c = c.withColumn("_in_row", F.col("row")).withColumn("_in_col", F.col("col"))
    c = c.withColumn("row", F.explode(mirror(F.col("_in_row"), F.col("height"))))
    c = c.withColumn("col", F.explode(mirror(F.col("_in_col"), F.col("width"))))
    own = (F.col("row") == F.col("_in_row")) & (F.col("col") == F.col("_in_col"))
    return c.withColumn("is_own", own).drop("_in_row", "_in_col", "height", "width")


def uniform_class_support(
    cells: DataFrame, keys: Sequence[str], classes: Sequence[int], size: int = 5
) -> DataFrame:
    """Mean filter of the class masks, reflect-padded, centre included.

    Adds ``pred_box`` (share of the predicted class in the prediction) and
    ``start_box`` (share of the start class in the start map).
    """
    r = size // 2
    padded = reflect_pad(cells, keys, r)
    b = box_counts(padded, keys, "pred_cls", classes, [r], "_p")
    b = box_counts(b, keys, "start_cls", classes, [r], "_s").filter("is_own")
    area = F.lit(float(size * size))
    return b.select(
        *cells.columns,
        (_pick(classes, F.col("pred_cls"), lambda c: F.col(f"_p{r}_{c}")) / area).alias("pred_box"),
        (_pick(classes, F.col("start_cls"), lambda c: F.col(f"_s{r}_{c}")) / area).alias("start_box"),
    )


def distance_affinity(
    cells: DataFrame, keys: Sequence[str], cls: str, classes: Sequence[int], radius: int = 2
) -> DataFrame:
    """Long (cell, class, (R+1-d)/(R+1)) for the nearest cell of a class within R (Chebyshev)."""
    if radius < 1:
        raise ValueError(f"radius must be at least 1: {radius}")
    b = box_counts(cells, keys, cls, classes, range(radius + 1))
    items = []
    for c in classes:
        near = F.lit(None).cast("double")
        for d in range(radius, -1, -1):
            hit = F.col(f"_b{d}_{c}") > 0
            near = F.when(hit, F.lit((radius + 1 - d) / (radius + 1))).otherwise(near)
        items.append(F.struct(F.lit(int(c)).alias("nb_cls"), near.alias("affinity")))
    out = b.select(*keys, "row", "col", F.inline(F.array(*items)))
    return out.filter(F.col("affinity").isNotNull())


def latent_affinity(cells: DataFrame, keys: Sequence[str], cls: str, vec: str) -> DataFrame:
    """Long (cell, neighbour class, mean of max(0, cosine)) over the 8 neighbours."""
    # unit vectors first: a pair then costs one dot product; zero vectors stay zero
    units = cells.select(*keys, "row", "col", cls, V.unit(vec, 1e-12).alias(vec))
    spread = _spread(units, keys, F.sequence(F.lit(-1), F.lit(1)))
    src = F.struct(
        F.col("_src").alias("r"), F.col("col").alias("c"), F.col(cls).alias("k"), F.col(vec).alias("v")
    )
    near = spread.groupBy(*keys, "row", "col").agg(
        F.collect_list(src).alias("_h"),
        F.first(F.when(F.col("_dr") == 0, F.col(vec)), True).alias(vec),
    )
    near = near.withColumn("_h", F.flatten(F.collect_list("_h").over(_along_row(keys, 1))))
    near = near.filter(F.col(vec).isNotNull())
    others = F.filter("_h", lambda x: (x["r"] != F.col("row")) | (x["c"] != F.col("col")))
    sims = F.transform(
        others,
        lambda x: F.struct(
            x["k"].alias("k"),
            F.greatest(V.dot(F.col(vec), x["v"]), F.lit(0.0)).alias("s"),
        ),
    )
    near = near.select(*keys, "row", "col", sims.alias("_s"))
    near = near.select(
        *keys, "row", "col", "_s", F.explode(F.array_distinct(F.transform("_s", lambda x: x["k"]))).alias("nb_cls")
    )
    mine = F.filter("_s", lambda x: x["k"] == F.col("nb_cls"))
    total = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x["s"])
    return near.select(*keys, "row", "col", "nb_cls", (total / F.size(mine)).alias("affinity"))


def coherence(cells: DataFrame, keys: Sequence[str], cls: str, target: int, vec: str) -> DataFrame:
    """Mean cosine over 4-adjacent pairs of one class; 0 with fewer than two cells."""
    mine = cells.filter(F.col(cls) == target).select(*keys, "row", "col", vec)
    right = W.partitionBy(*keys, "row").orderBy("col").rangeBetween(1, 1)
    down = W.partitionBy(*keys, "col").orderBy("row").rangeBetween(1, 1)
    pair = mine.withColumn("_r", F.first(vec).over(right)).withColumn("_d", F.first(vec).over(down))

    def cos(other: str) -> Column:
        floor = F.lit(1e-8)
        return V.dot(vec, other) / (F.greatest(V.norm(vec), floor) * F.greatest(V.norm(other), floor))

    sims = pair.select(*keys, F.explode(F.array(cos("_r"), cos("_d"))).alias("_s"))
    agg = sims.groupBy(*keys).agg(F.avg("_s").alias("_avg"))
    base = cells.select(*keys).distinct()
    return base.join(agg, list(keys), "left").select(
        *keys, F.coalesce("_avg", F.lit(0.0)).alias("coherence")
    )


def shift_prediction(cells: DataFrame, keys: Sequence[str], dy: int, dx: int) -> DataFrame:
    """Move predicted changes by (dy, dx); off-grid ones vanish, vacated cells revert."""
    moved = cells.filter(F.col("pred_cls") != F.col("start_cls")).select(
        *keys, (F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"),
        F.col("pred_cls").alias("_m"),
    )
    j = cells.join(moved, [*keys, "row", "col"], "left")
    return j.withColumn("shifted_cls", F.coalesce("_m", "start_cls")).drop("_m")


def shift_scores(cells: DataFrame, keys: Sequence[str], max_shift: int = 4) -> DataFrame:
    """F1 of predicted change against true change for every shift in [-m, m]^2.

    True-change positions around a cell come from one spread over rows and one
    range frame, so only per-shift counts are shuffled, not a copy per shift.
    """
    m = max_shift
    true = F.col("end_cls") != F.col("start_cls")
    pred = F.col("pred_cls") != F.col("start_cls")
    flags = cells.select(*keys, "row", "col", true.alias("_t"), pred.alias("_p")).filter("_t or _p")
    span = F.sequence(F.lit(-m), F.lit(m))
    near = _spread(flags, keys, F.when(F.col("_t"), span).otherwise(F.array(F.lit(0))))
    near = near.groupBy(*keys, "row", "col").agg(
        F.collect_list(F.when(F.col("_t"), F.col("_dr"))).alias("_d"),
        F.max((F.col("_dr") == 0) & F.col("_p")).alias("_p"),
    )
    frame = F.collect_list(F.struct(F.col("col").alias("c"), F.col("_d").alias("d")))
    near = near.withColumn("_n", frame.over(_along_row(keys, m))).filter("_p")
    near = join_small(near, extents(cells, keys), keys, how="inner")
    hits = F.flatten(
        F.transform("_n", lambda x: F.transform(
            x["d"], lambda d: F.struct(d.alias("dy"), (x["c"] - F.col("col")).alias("dx"))
        ))
    )
    shifts = F.flatten(F.transform(span, lambda y: F.transform(
        span, lambda x: F.struct(y.cast("int").alias("dy"), x.cast("int").alias("dx")))))
    inside = F.filter(shifts, lambda s: (
        (F.col("row") + s["dy"]).between(0, F.col("height") - 1)
        & (F.col("col") + s["dx"]).between(0, F.col("width") - 1)
    ))
    tp = near.select(*keys, F.inline(hits)).groupBy(*keys, "dy", "dx").agg(F.count(F.lit(1)).alias("tp"))
    np_ = near.select(*keys, F.inline(inside)).groupBy(*keys, "dy", "dx").agg(F.count(F.lit(1)).alias("np"))
    nt = cells.groupBy(*keys).agg(F.coalesce(F.sum(true.cast("int")), F.lit(0)).alias("nt"))
    grid = nt.select(*keys, "nt", F.inline(shifts))
    on = [*keys, "dy", "dx"]
    j = grid.join(np_, on, "left").join(tp, on, "left")
    t, p, n = F.coalesce("tp", F.lit(0)), F.coalesce("np", F.lit(0)), F.col("nt")
    return j.select(*on, f1_score(ratio(t, p), ratio(t, n)).alias("f1"))


def best_shift(cells: DataFrame, keys: Sequence[str], max_shift: int = 4) -> DataFrame:
    """Best shift per key; unshifted wins ties, then scan order."""
    s = shift_scores(cells, keys, max_shift)
    raw = (F.col("dy") == 0) & (F.col("dx") == 0)
    best = F.min(F.struct((-F.col("f1")).alias("f"), (~raw).alias("moved"), "dy", "dx"))
    out = s.groupBy(*keys).agg(F.max(F.when(raw, F.col("f1"))).alias("raw_f1"), best.alias("_b"))
    return out.select(
        *keys, "raw_f1", (-F.col("_b.f")).alias("best_f1"),
        F.col("_b.dy").alias("best_dy"), F.col("_b.dx").alias("best_dx"),
    )


def tile_counts(cells: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Cells per tile of size x size, edge tiles completed by reflection."""
    c = join_small(cells, extents(cells, keys), keys, how="inner")

    def spots(x: Column, extent: Column) -> Column:
        full = F.ceil(extent / F.lit(size)).cast("int") * size
        mirrored = 2 * extent - 2 - x
        return F.filter(
            F.array(x, F.when((mirrored >= extent) & (mirrored < full), mirrored)),
            lambda v: v.isNotNull(),
        )

    c = c.withColumn("_r", F.explode(spots(F.col("row"), F.col("height"))))
    c = c.withColumn("_c", F.explode(spots(F.col("col"), F.col("width"))))
    return c.select(
        *cells.columns,
        F.floor(F.col("_r") / size).cast("int").alias("tile_row"),
        F.floor(F.col("_c") / size).cast("int").alias("tile_col"),
        (F.col("_r") % size).alias("in_row"), (F.col("_c") % size).alias("in_col"),
    )


def untile(cells: DataFrame, tokens: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Give every cell the value of its block (token grid keyed by block_row, block_col)."""
    k = cells.withColumns({
        "block_row": F.floor(F.col("row") / block).cast("int"),
        "block_col": F.floor(F.col("col") / block).cast("int"),
    })
    return k.join(tokens, [*keys, "block_row", "block_col"])
