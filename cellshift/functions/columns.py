"""Scalar column expressions: guarded arithmetic, rounding, classes, hashing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num/den, or ``empty`` where the denominator is zero."""
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def half_even(x: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(x).cast("bigint")


def clamp(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(hi, F.greatest(lo, x))


def n_if(cond: Column, weight: Column | None = None) -> Column:
    """How many rows (or how much weight) satisfy ``cond``; 0 rather than NULL."""
    w = F.lit(1) if weight is None else weight
    return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")


def f1_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def finite(x: Column) -> Column:
    """The value as DOUBLE, or NULL when missing, unparsable, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def steady_sum(x: Column) -> Column:
    """Sum as DOUBLE that is the same in any order of the rows: equal rows give equal sums, however they are spread.

    Added up as decimals of 18 digits after the point; NaN, infinite and larger values (from 1e20) by the plain sum.
    """
    d = x.cast("double").try_cast("decimal(38,18)")
    exact = F.when(F.count(d) == F.count(x), F.try_sum(d).cast("double"))
    return F.coalesce(exact, F.sum(x))


def steady_mean(x: Column) -> Column:
    """``steady_sum`` over the number of values; NULL without values."""
    return F.when(F.count(x) > 0, steady_sum(x) / F.count(x))


def lookup(mapping: Mapping, key: Column, default) -> Column:
    """Literal map lookup with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    if not pairs:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def valid_cell(*classes: Column | str) -> Column:
    """True where none of the class columns is the nodata class 0."""
    out = F.lit(True)
    for c in classes:
        out = out & (col(c) != 0)
    return out


def transition_label(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit("->"), b.cast("string"))


def stable_hash(seed, *cols: Column | str) -> Column:
    """Reproducible pseudo-random order key (md5 of the joined fields)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def hash_unit(seed, *cols: Column | str) -> Column:
    """Reproducible number in [0, 1): the first 8 hex digits of ``stable_hash``."""
    head = F.conv(F.substring(stable_hash(seed, *cols), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def change_code(start: Column, end: Column, pred: Column) -> Column:
    """hit / miss / false_alarm / correct_rejection of predicted change."""
    t, p = end != start, pred != start
    return (
        F.when(t & p, "hit").when(t, "miss").when(p, "false_alarm").otherwise("correct_rejection")
    )
