"""URL rules looked up in a cascade of Bloom filters.

A rule is a host and the start of a path; it fits that host and its subdomains. The keys under which a URL may be
listed are its host's suffixes with the path starts of the lengths that rules have. For each verdict the first Bloom
filter holds the listed keys, the second the keys of the corpus that pass the first by mistake, the third the listed
keys that pass the second, and so on until a level has none left. Over all keys of the corpus membership is then exact,
and looking it up is one expression without a join. Everything on rows is built-in functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh, without
from .store import stored

#: A-Z, the letters that are lower-cased in hosts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BITS = 1 << 24  # a filter up to this size is a literal of the plan (2 MB); longer lists are joined


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for NULL."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for NULL."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def keys_of(host: str, path: str, labels: int, lengths: list[int]) -> Column:
    """The keys of a URL: suffixes of up to ``labels`` labels, each with path starts of ``lengths`` characters."""
    parts = F.split(host, "\\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    starts = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    return F.flatten(F.transform(ends, lambda e: F.transform(
        F.filter(starts, lambda p: p.isNotNull()), lambda p: F.concat(e, p))))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, size in bits, hash functions, and the salt of its hashes."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    salt: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(str(list(self.words))), "array<bigint>")  # folded to one literal
        out = F.lit(True)
        for p in self.places(key):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        return out


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """The filter of ``keys`` (n of them) for a share ``rate`` of false positives; its words are built on the executors."""
    bits = max(64, -(-math.ceil(n * math.log(1 / rate) / math.log(2) ** 2) // 64) * 64)
    level = Level((), bits, max(1, round(math.log2(1 / rate))), salt)
    place = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    rows = place.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).collect()  # at most bits / 64 rows
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.b
    return Level(tuple(words), bits, level.hashes, salt)


def cascade(listed: DataFrame, universe: DataFrame, salt: int = 0) -> list[Level]:
    """Filters that decide membership of every key of ``universe`` in ``listed`` (both: key, distinct in listed).

    The first level's rate makes its false positives about as many as the listed keys, so later levels are of the
    list's size whatever the corpus.
    """
    n = listed.count()
    if not n:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [_level(listed, n, min(0.5, max(1e-9, n / (1.5 * max(size, 1)))), salt)]
    inside, outside = listed, stored(
        universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade")
    n_out = outside.count()
    while n_out:
        levels.append(_level(outside, n_out, 0.5, salt + len(levels)))
        inside, outside = outside, stored(inside.where(levels[-1].passes(F.col("key"))), "cascade")
        n_out = outside.count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether ``key`` is listed: the parity of the first level that it doesn't pass."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(level.passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def url_verdicts(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_bits: int = MAX_BITS,
) -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, else NULL) and verdict (its verdict, else ``default``).

    ``rules``: (rule, verdict), the rule being host and path start in one string, without a scheme; a rule without a
    slash fits any path. Of equally long rules the one with the longer host holds, of contradicting rows ``block``.
    NULL or malformed urls have an empty host and path. Rows stay; columns of the added names are
    replaced. Lists whose first filter would be over ``max_bits`` are joined on the distinct (host, path) instead.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    rules = stored(rules.where(F.col("rule").isNotNull()).groupBy(F.col("rule").alias("key")).agg(
        F.max("verdict").alias("verdict")), "rules")
    cut = F.instr("key", "/")
    shape = rules.select(
        F.when(cut > 0, F.length("key") - cut + 1).otherwise(0).alias("n"),
        F.size(F.split(F.substring_index("key", "/", 1), "\\.")).alias("labels"))
    lengths = sorted((r.n for r in shape.select("n").distinct().collect()), reverse=True) or [0]  # few: lengths of paths
    labels = shape.agg(F.max("labels")).first()[0] or 1
    d = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    keys = keys_of("host", "path", labels, lengths)
    rank = lambda k: F.struct(F.length(k), F.length(F.substring_index(k, "/", 1)), k.alias("key"))
    if rules.count() * 45 > max_bits:
        each = d.select("host", "path").distinct().withColumn("key", F.explode(keys)).join(rules, "key")
        best = each.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), rank(F.col("key"))).alias("_hit"))
        best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "_hit")
        return d.alias("d").join(best.alias("b"), F.expr("d.host = b._h AND d.path = b._p"), "left").select(
            "d.*", F.col("b._hit.key").alias("rule"), F.coalesce(F.col("b._hit.verdict"), F.lit(default)).alias("verdict"))
    every = d.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    kinds = [r.verdict for r in rules.select("verdict").distinct().collect()]
    filters = {v: cascade(rules.where(F.col("verdict") == v).select("key"), every, 1000 * i) for i, v in enumerate(sorted(kinds))}
    at, hits = fresh(d, "_keys"), fresh(d, "_hits")
    d = d.withColumn(at, keys)
    for i, levels in enumerate(filters.values()):
        d = d.withColumn(f"{hits}{i}", F.array_max(F.transform(F.filter(at, partial(member, levels)), rank)))
    best = F.greatest(*(F.col(f"{hits}{i}") for i in range(len(filters)))) if len(filters) > 1 else F.col(f"{hits}0") \
        if filters else F.lit(None).cast("struct<a:int,b:int,key:string>")
    verdict = F.lit(default)
    for i, v in enumerate(filters):
        verdict = F.when(F.col(f"{hits}{i}") == best, F.lit(v)).otherwise(verdict)
    return d.select(*pages.columns, "host", "path", best["key"].alias("rule"), verdict.alias("verdict"))
