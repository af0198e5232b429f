"""Exact Jaccard self-join of documents on word shingles, as connected components, by T-occurrence search.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one candidate from here on.
2. A set of n shingles shares at least ceil(percent * n / 100) of them with any partner, so a set with more shingles
   that occur nowhere else than that leaves room for has no partner. Occurrences are counted for the shingles in a
   fixed share of the hash range, once each per set; most documents end here.
3. Over the sets left, shingles are ordered from short inverted lists to long ones. Partners must share a shingle among
   the first n - T + 1 of that order, the short lists; pairs from those lists that pass the length bound, and chains
   through lists too long to pair, tie sets into blocks of candidates. No pair of partners lies in two blocks.
4. In each block, DivideSkip answers every set's query for T occurrences: the short lists are heap-merged, the long ones
   are probed by binary search, and the sets with enough occurrences are decided by the exact overlap. Blocks over a
   fixed size are cut into tiles and each pair of tiles is a task of its own, so no group is collected whole.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .store import drop, join_narrow, stored
from .wordarrays import Words, as_long, lists, mix, slices, windows

SHARE = 0.25  # of the hash range in which occurrences are counted; decides speed only
PAIR_LIST = 32  # inverted lists up to this length are paired out, longer ones chained; decides speed only
TILE = 256  # sets of a block that one side of a task holds


def _shingle_sets(column: pa.Array, size: int):
    """Distinct shingle hashes by row, ascending: (rows, hashes). A row with fewer words has them all as one shingle."""
    words = Words(column)
    h = words.hashes(fold=True)
    g, inside = windows(h, words.row, size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    one = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short):
        a, b = words.first[r], words.first[r + 1]
        one[i] = mix(windows(h[a:b], words.row[a:b], b - a)[0], 9)[0]
    rows = np.concatenate([words.row[: len(g)][inside], short])
    codes = np.concatenate([g[inside], one])
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])) if len(rows) else np.zeros(0, bool)
    return rows[new], codes[new]


def _set_keys(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit keys of each row's set."""
    count = np.bincount(rows, minlength=n)
    keys = []
    for salt in (1, 2):
        key = np.zeros(n, np.uint64)
        if len(rows):
            start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            key[rows[start]] = np.add.reduceat(mix(codes, salt), start)
        keys.append(key)
    return count, keys[0], keys[1]


def _at_least(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def links_in_block(
    left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, percent: int,
) -> list[tuple[int, int]]:
    """Links that span what is linked among ``left``, or between ``left`` and ``right``, by DivideSkip.

    Each set is (id, size, those of its hashes that other sets have too). A partner already reached through found links is skipped.
    """
    sides = [left] if right is None else [left, right]
    sets = sorted(((n, i, side, s) for side, group in enumerate(sides) for i, n, s in group), key=lambda x: x[:3])
    parent = {i: i for _, i, _, _ in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: list[dict[int, list[int]]] = [{} for _ in sides]
    found = []
    for place, (n, i, side, codes) in enumerate(sets):
        other = index[0 if right is None else 1 - side]
        need = _at_least(n, percent)  # partners so far are no larger, so they share this many of these
        inverted = sorted((x for x in (other.get(c) for c in codes.tolist()) if x), key=len)
        if len(inverted) >= need:
            longest = len(inverted[-1])
            skip = min(need - 1, int(need / (0.01 * math.log(longest + 1) + 1)))
            short, long = inverted[: len(inverted) - skip], inverted[len(inverted) - skip :]
            for q, times in _runs(heapq.merge(*short)):
                if times < need - skip:
                    continue
                m, j, _, _ = sets[q]
                if m * 100 < n * percent or root(j) == root(i):
                    continue
                for rest, x in zip(range(len(long), 0, -1), long):
                    at = bisect_left(x, q)
                    times += at < len(x) and x[at] == q
                    if times + rest - 1 < need:
                        break
                if times * 100 >= percent * (n + m - times):
                    found.append((i, j))
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        for c in codes.tolist():
            index[side].setdefault(c, []).append(place)
    return found


def _runs(merged):
    """(value, how often) of an ascending iterable."""
    last, n = None, 0
    for x in merged:
        if x == last:
            n += 1
        else:
            if n:
                yield last, n
            last, n = x, 1
    if n:
        yield last, n


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85,
    pair_list: int = PAIR_LIST, tile: int = TILE, leader: bool = False,
) -> DataFrame:
    """(key, n_shingles, component_id, text_hash) for every row: the least key reachable by links, its own included.

    Rows link when their sets of distinct ``size``-word shingles (A-Z lower-cased; a text of fewer words is one
    shingle) have a Jaccard similarity of ``percent``/100 or more. NULL texts and texts without words have no shingle
    and link with nothing. Repeated rows are rows of their own with the same result; a NULL key is never the least
    unless no other is there. ``text_hash`` is xxhash64 of the text, to tell rows of one key apart. Shingles are compared by 64-bit hashes.
    With ``leader``, (leader_key, leader_hash) too: the first row of those that are linked, by key (NULL last) and text_hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    edge = np.uint64(int(SHARE * 2**64))

    def sets(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows, codes = _shingle_sets(b.column(1), size)
                n, a, c = _set_keys(rows, codes, b.num_rows)
                low = codes < edge
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(n.astype(np.int64)), as_long(a), as_long(c),
                     lists(codes[low].view(np.int64), np.bincount(rows[low], minlength=b.num_rows))],
                    names=["key", "hash", "n", "ka", "kb", "low"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = plain.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    sampled = stored(hashed.mapInArrow(sets, f"key {kind}, hash long, n long, ka long, kb long, low array<long>"), "shingle-sets")
    base = stored(sampled.drop("low"), "set-keys")
    head = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    reps = base.where("n > 0").groupBy("ka", "kb").agg(F.min(head).alias("first"), F.min("n").alias("n")).withColumn(
        "rep", F.col("first.key"))
    once = sampled.select("ka", F.explode("low").alias("h")).groupBy("h").agg(F.min("ka").alias("ka"), F.max("ka").alias("k2"))
    lone = once.where("ka = k2").groupBy("ka").agg(F.count(F.lit(1)).alias("lone"))
    room = F.expr(f"n - (({percent} * n + 99) div 100)")
    left = reps.join(lone, "ka", "left").where(F.coalesce("lone", F.lit(0)) <= room).select(
        "rep", F.col("first.hash").alias("code"), "ka", "kb")

    def full(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows, codes = _shingle_sets(b.column(1), size)
                n, a, c = _set_keys(rows, codes, b.num_rows)
                same = (a.view(np.int64) == np.array(b.column(2), np.int64)) & (c.view(np.int64) == np.array(b.column(3), np.int64))
                mine = same[rows]
                yield pa.RecordBatch.from_arrays(
                    [as_long(a[same]), as_long(c[same]), lists(codes[mine].view(np.int64), n[same])], names=["ka", "kb", "codes"])

    same_row = F.col("key").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("code"))
    again = join_narrow(hashed, left, same_row, "inner", "partnered").select("key", "text", "ka", "kb")
    drop(sampled)
    texts = stored(again.mapInArrow(full, "ka long, kb long, codes array<long>").withColumn(
        "id", F.monotonically_increasing_id()), "candidates")
    named = stored(texts.select("id", "ka", "kb"), "candidate-ids")
    chosen = named.groupBy("ka", "kb").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many"))
    sets_left = texts.drop("ka", "kb")
    if not chosen.where("many > 1").isEmpty():  # repeated rows of one key and text
        named = stored(chosen.select("id", "ka", "kb"), "candidate-ids")
        sets_left = sets_left.join(named.select("id"), "id")

    # shingles of the sets left, from short lists to long; those that occur once cannot be shared
    each = sets_left.select("id", F.size("codes").alias("n"), F.explode("codes").alias("h"))
    counted = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(counted, "h").groupBy("id").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("df", "h"))), lambda x: x["h"]).alias("codes"))
    # n - T + 1 shingles make the prefix; those that occur once come first in it
    shared = shared.withColumn("short", F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - size(codes))")).where("short > 0")
    ordered = stored(shared, "ordered")
    drop(texts)
    lists_ = ordered.select("id", "n", F.posexplode(F.slice("codes", 1, F.col("short").cast("int"))).alias("at", "h"))
    sizes = lists_.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("least")).where("many > 1")
    posted = lists_.join(sizes, "h")
    short = posted.where(F.col("many") <= pair_list).select("h", "id", "n")
    pairs = short.alias("a").join(short.alias("b"), "h").where(
        (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
    ).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    chains = posted.where((F.col("many") > pair_list) & (F.col("id") > F.col("least"))).select(
        F.col("least").alias("src"), F.col("id").alias("dst"))
    blocks = connected_components(pairs.union(chains).distinct()).select(F.col("node").alias("id"), F.col("component").alias("block"))

    held = ordered.join(blocks, "id").select("id", "n", "codes", "block")
    tiles = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    cut = held.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "block", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "id", "n", "codes")

    def search(group: pa.Table) -> pa.Table:
        sides: dict[int, list] = {}
        for i, n, tile_, codes in zip(*(group[c].to_pylist() for c in ("id", "n", "tile")), group["codes"]):
            sides.setdefault(tile_, []).append((i, n, np.array(codes.values, np.int64)))
        found = links_in_block(*[*sides.values(), None][:2], percent)
        if group["p"][0].as_py() != group["q"][0].as_py() and len(sides) == 1:
            found = []  # one tile of the two has no sets
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(("src", "dst"))})

    links = tasks.groupBy("block", "p", "q").applyInArrow(search, "src long, dst long")
    classes = connected_components(links).select(F.col("node").alias("id"), "component")
    drop(ordered)
    lead = ["first"] if leader else []
    named = named.join(classes, "id").join(reps.select("ka", "kb", "rep", *lead), ["ka", "kb"])
    least = named.groupBy("component").agg(F.min("rep").alias("least"), *(F.min(c).alias("lead") for c in lead))
    by_set = reps.select("ka", "kb", "rep", *lead).join(
        named.join(least, "component").select("ka", "kb", "least", *(["lead"] if leader else [])), ["ka", "kb"], "left").select(
        "ka", "kb", F.coalesce("least", "rep").alias("least"), *(F.coalesce("lead", c).alias("lead") for c in lead))
    own = F.coalesce(F.col("lead"), head) if leader else None
    return base.join(by_set, ["ka", "kb"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "key")).otherwise(F.col("key")).alias("component_id"),
        F.col("hash").alias("text_hash"),
        *([own["key"].alias("leader_key"), own["hash"].alias("leader_hash")] if leader else []))
