"""A reproducible shuffle into shards: a keyed permutation of global row numbers.

Rows are numbered by a hash of their whole content, so the number depends on the data and on nothing else. A Feistel
network over a x b >= rows, with cycle walking back into the range, permutes the numbers; shard and slot are the
remainder and the quotient of the permuted number, so both can be computed for any row number without the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import fresh, without

ROUNDS = 8
BUCKET_ROWS = 65_536  # rows that one task puts in order
CHUNK = 1 << 16


def _quotient(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def _sides(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, -(-max(rows, 1) // a)


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of row ``number`` (0..rows-1) in the shuffle, as one expression.

    a*b exceeds ``rows`` by less than a, so a walk is short; one over 64 steps raises rather than give a wrong place.
    """
    a, b = _sides(rows)

    def once(x: Column) -> Column:
        start = F.struct(_quotient(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
            lambda s, i: F.struct(
                F.when(i % 2 == 0, (s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), F.lit(a))) % a).otherwise(s["l"]).alias("l"),
                F.when(i % 2 == 1, (s["r"] + F.pmod(F.xxhash64(F.lit(seed), i, s["l"]), F.lit(b))) % b).otherwise(s["r"]).alias("r")),
            lambda s: s["l"] * b + s["r"])

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), once(number), lambda x, _: F.when(x < rows, x).otherwise(once(x)),
        lambda x: F.when(x < rows, x).otherwise(F.raise_error(F.lit("cycle walk over 64 steps")).cast("long")))


def feistel_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard); counts differ by one at most.

    Rows equal in all columns are interchangeable and counted before they are numbered, so a row repeated any number
    of times doesn't gather in one task. NULLs are values like others. Columns that cannot be grouped (maps) must be
    taken out first. Existing columns named shard or slot are replaced.
    """
    df = without(df, "shard", "slot")
    h, many, bucket, chunk, at, base, no, p = (
        fresh(df, x) for x in ("_hash", "_many", "_bucket", "_chunk", "_at", "_base", "_no", "_p"))
    kinds = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(many)).withColumn(h, F.xxhash64(F.lit(seed), *df.columns))
    total = df.count()
    bits = min(16, max(0, math.ceil(math.log2(max(total, 1) / BUCKET_ROWS)))) if total else 0
    kinds = kinds.withColumn(bucket, F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = kinds.groupBy(bucket).agg(F.sum(many).alias(no)).select(  # at most 2**16 rows
        bucket, F.coalesce(F.sum(no).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(bucket).orderBy(h, *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = kinds.withColumn(at, F.coalesce(F.sum(many).over(inside), F.lit(0)))
    if bits:
        numbered = numbered.join(bases, bucket).withColumn(at, F.col(at) + F.col(base))
    each = numbered.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(CHUNK).cast("long"))))
    each = each.withColumn(no, F.explode(F.sequence(
        F.col(at) + F.col(chunk), F.col(at) + F.least(F.col(many), F.col(chunk) + CHUNK) - 1)))
    placed = each.withColumn(p, permuted(F.col(no), total, seed))
    return placed.select(
        *df.columns, (F.col(p) % shards).cast("int").alias("shard"),
        _quotient(F.col(p), shards).alias("slot"))
