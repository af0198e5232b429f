"""Removal of word runs that occur earlier in the corpus, by level-wise doubling.

A window of ``size`` words can only repeat if every shorter window inside it does. The levels go from a short length to
``size``, each twice as long as the last (5, 10, 20 words). At each level every full window still in question is stood
for by the least hash among the windows of the level's length inside it, which equal windows share, so a fraction of
the windows is counted. Full windows whose representative occurs once in the corpus are done; those left go on to twice
the length, and at ``size`` they are counted by the least document that holds them. The levels end there: what goes is
decided at ``size``, and windows repeated at 2 * size, 4 * size and so on would only say that a repeat is longer.

Exact copies of a text are set aside first by a 128-bit hash: of equal texts only the first one is looked at, all later
ones of at least ``size`` words lose every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, ShortType, StructType

from .columns import fresh, without
from .store import stored
from .wordarrays import Words, as_long, slices, windows

SIZE = 20
SHORTEST = 5  # words of the first level at least; decides speed only


def _least_in(g: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every run of ``span`` values, by doubling."""
    out, have = g, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def levels(size: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths below ``size``, ascending, each about half of the next: the first is ``shortest`` words or more, one is there always."""
    out = [size // 2]
    while out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


def _level(h: np.ndarray, row: np.ndarray, size: int, length: int):
    """Hashes of the windows of ``length`` words, and for each full window inside a row its start and the least of them in it."""
    g, _ = windows(h, row, length)
    n = len(h) - size + 1
    if n <= 0:
        return g, np.zeros(0, int), np.zeros(0, np.uint64)
    least = _least_in(g, size - length + 1)[:n]
    start = np.flatnonzero(row[size - 1 :] == row[:n])
    return g, start, least[start]


def _representatives(words: Words, size: int, lengths: list[int], alone: pa.Array | None):
    """(row, representative of the last of ``lengths``, found at two places of the row), each hash once a row.

    Only full windows that no earlier level found ``alone`` are stood for.
    """
    h, length = words.hashes(), lengths[-1]
    g, start, least = _level(h, words.row, size, length)
    if len(lengths) > 1:
        open_ = _open(words, h, size, lengths[:-1], alone)
        start, least = start[open_], least[open_]
    if not len(start):
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, bool)
    order = np.lexsort((least, words.row[start]))
    r, v = words.row[start][order], least[order]
    first = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))
    r, v = r[first], v[first]
    # places of those hashes among all windows of the length inside the row
    inside = np.flatnonzero(words.row[length - 1 :] == words.row[: len(g)])
    gi, ri = g[inside], words.row[inside]
    candidate = np.isin(gi, v)
    gi, ri = gi[candidate], ri[candidate]
    order = np.lexsort((gi, ri))
    gi, ri = gi[order], ri[order]
    again = np.flatnonzero((gi[1:] == gi[:-1]) & (ri[1:] == ri[:-1]))
    twice = set(zip(ri[again].tolist(), gi[again].tolist()))
    multi = np.array([(a, b) in twice for a, b in zip(r.tolist(), v.tolist())], bool) if twice else np.zeros(len(r), bool)
    return r, v, multi


def _taken(starts: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which words are covered by windows that begin at ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:-1] > 0


def _pairs_in(row: np.ndarray, value: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which (row, value) pairs are among (rows, values)."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(value + row.astype(np.uint64) * step, values + rows.astype(np.uint64) * step)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a list column of 64-bit hashes."""
    begin = np.array(column.offsets, np.int64)
    count = np.where(np.array(column.is_valid()), np.diff(begin), 0)
    rows = np.repeat(np.arange(len(column)), count)
    keep = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[:-1], count)
    return rows, np.array(column.values, np.int64).view(np.uint64)[keep]


def _open(words: Words, h: np.ndarray, size: int, lengths: list[int], alone: pa.Array) -> np.ndarray:
    """Which full windows have no representative of these levels in ``alone``."""
    rows, values = _listed(alone)
    left = None
    for length in lengths:
        _, start, least = _level(h, words.row, size, length)
        fine = ~_pairs_in(words.row[start], least, rows, values)
        left = fine if left is None else left & fine
    return left


def _alive(words: Words, size: int, lengths: list[int], alone: pa.Array):
    """Start, hash and row of the full windows that every level left in question."""
    h = words.hashes()
    g, inside = windows(h, words.row, size)
    start = np.flatnonzero(inside)[_open(words, h, size, lengths, alone)]
    return start, g[start], words.row[start]


def _each_first(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which entries are the first of their (row, code); entries come in order of place."""
    order = np.lexsort((np.arange(len(row)), code, row))
    r, c = row[order], code[order]
    first = np.ones(len(row), bool)
    first[order[1:]] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    return first


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Kept words of each row, joined by one blank."""
    start, size, row = words.start[keep], (words.end - words.start)[keep], words.row[keep]
    n = len(words.count)
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    at = np.cumsum(size + 1) - (size + 1)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + within] = words.data[np.repeat(start, size) + within]
    count = np.bincount(row, minlength=n)
    total = np.concatenate([[0], np.cumsum(np.bincount(row, size + 1, n))]).astype(np.int64)
    last = total[1:][count > 0] - 1  # the blank after a row's last word goes
    body = np.delete(out, last) if len(last) else out
    offsets = total - np.concatenate([[0], np.cumsum(count > 0)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())


def _cut_out(words: Words, gone: np.ndarray) -> pa.Array:
    """Each row's text without the removed words and the separators after them."""
    n = len(words.data)
    edge = np.zeros(n + 1, np.int64)
    after = np.append(words.start[1:], n)  # where the next word, or the row, begins
    row_end = words.offsets[words.row + 1]
    np.add.at(edge, words.start[gone], 1)
    np.add.at(edge, np.minimum(after, row_end)[gone], -1)
    keep = np.cumsum(edge)[:-1] == 0
    total = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    return pa.LargeStringArray.from_buffers(
        len(words.count), pa.py_buffer(total.astype(np.int64)), pa.py_buffer(words.data[keep])).cast(pa.string())


def _numbered(docs: DataFrame, key: str, name: str) -> tuple[DataFrame, Column]:
    """``docs`` with numbers in the order of their keys, for keys that are no integers; NULL has none."""
    at = fresh(docs, "_at")
    order = stored(docs.select(F.col(key).alias(at)).where(F.col(at).isNotNull()).distinct().sort(at).withColumn(
        name, F.monotonically_increasing_id()), "keys")
    return docs.join(order, F.col(key) == F.col(at), "left"), F.col(name)


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, joined: bool = False,
    names: tuple[str, str, str, str] = ("n_words", "n_removed", "removed", "kept"), shortest: int = SHORTEST,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (word ranges [from, to)) and ``kept``, the text that stays.

    ``names`` are the names of these four; columns that have them are replaced.

    A word goes when it is covered by a window of ``size`` words whose sequence also starts earlier: in a smaller key,
    or earlier in the same document. Words are runs of bytes other than space and \\x09-\\x0D, compared as they are.
    ``kept`` is the text without the removed words, or its kept words joined by one blank if ``joined``. NULL text has
    no words and an empty ``kept``. NULL keys come after all others, in the order of a hash of the text. Rows of one
    key and text count as one document and get the same result; of different texts under one key none is earlier.
    Keys may be of any type that sorts; they are expected to tell documents apart but for a few repeats. ``shortest`` is
    the least length of the first level and has no bearing on the result.
    """
    docs = without(docs, *names)
    if size < 2:
        raise ValueError("a window has two words at least")
    own, ka, kb, o, fa, fb, la, lb, le = (
        fresh(docs, x) for x in ("_own", "_ka", "_kb", "own", "_fa", "_fb", "_alone", "_also", "_earliest"))
    body = F.coalesce(F.col(text), F.lit(""))
    tagged = docs.withColumn(ka, F.xxhash64(body)).withColumn(kb, F.xxhash64(F.lit(7), body))
    number = F.col(key).cast("long")
    if not isinstance(docs.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        tagged, number = _numbered(tagged, key, fresh(tagged, "_number"))
    tagged = tagged.select(*docs.columns, ka, kb, F.coalesce(
        number, F.lit(2**62) + F.col(ka).bitwiseAND(F.lit(2**61 - 1))).alias(own))
    columns, at = tagged.columns, docs.columns.index(text)
    width = len(columns)
    lengths = levels(size, shortest)
    mine = (F.col(own) == F.col(o)) & (F.col(ka).bitwiseXOR(F.col(fa)) == 0) & (F.col(kb).bitwiseXOR(F.col(fb)) == 0)

    def represent(upto):
        def run(batches):
            for whole in batches:
                for b in slices(whole, text):
                    listed = b.column(width + 3) if len(upto) > 1 else None
                    r, v, multi = _representatives(Words(b.column(at)), size, upto, listed)
                    take = pa.array(r, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [as_long(v), b.column(width - 3).take(take), b.column(width - 1).take(take), pa.array(multi)],
                        names=["h", "k", "own", "multi"])
        return run

    known = None
    for i in range(len(lengths)):
        rows = tagged if known is None else tagged.join(known, mine).select(*columns, o, fa, fb, la)
        seen = rows.mapInArrow(represent(lengths[: i + 1]), "h long, k long, own long, multi boolean").groupBy("h").agg(
            F.min("k").alias("k"), F.max("k").alias("k2"), F.min("own").alias("own"), F.max("multi").alias("multi"))
        alone = seen.where("k = k2 AND NOT multi").groupBy(F.col("own").alias(o)).agg(F.collect_list("h").alias(la))
        if known is None:
            firsts = tagged.groupBy(F.col(ka).alias(fa), F.col(kb).alias(fb)).agg(F.min(own).alias(o))
            known = stored(firsts.join(alone, o, "left"), "level")
        else:
            known = known.join(alone.withColumnRenamed(la, lb), o, "left").select(o, fa, fb, F.when(F.col(lb).isNull(), F.col(la)).when(
                F.col(la).isNull(), F.col(lb)).otherwise(F.concat(la, lb)).alias(la))

    def extend(batches):
        for whole in batches:
            for b in slices(whole, text):
                start, code, row = _alive(Words(b.column(at)), size, lengths, b.column(width + 3))
                new = _each_first(row, code)
                yield pa.RecordBatch.from_arrays(
                    [as_long(code[new]), b.column(width - 1).take(pa.array(row[new], pa.int64()))], names=["h", "own"])

    least = tagged.join(known, mine).select(*columns, o, fa, fb, la).mapInArrow(
        extend, "h long, own long").groupBy("h").agg(F.min("own").alias("own"))
    told = known.join(least.groupBy(F.col("own").alias(o)).agg(F.collect_list("h").alias(le)), o, "left")
    shape = StructType(list(docs.schema)).add(names[0], "long").add(names[1], "long").add(
        names[2], ArrayType(StructType().add("from", "integer").add("to", "integer"))).add(names[3], "string")

    def finish(batches):
        for whole in batches:
            for b in slices(whole, text):
                words = Words(b.column(at))
                start, code, row = _alive(words, size, lengths, b.column(width + 1))
                held = _pairs_in(row, code, *_listed(b.column(width + 2))) & _each_first(row, code)
                gone = _taken(start[~held], len(words.start), size)
                copy = ~np.array(b.column(width).is_valid()) & (words.count >= size)
                gone |= copy[words.row]
                step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                ends = np.concatenate([[False], words.row[1:] != words.row[:-1], [False]]) if len(gone) else np.zeros(1, bool)
                begin = np.flatnonzero((step == 1) | (ends & np.append(gone, False) & np.append(False, gone)))
                to = np.flatnonzero((step == -1) | (ends & np.append(gone, False) & np.append(False, gone)))
                of = words.row[begin]
                spans = pa.StructArray.from_arrays(
                    [pa.array((begin - words.first[of]).astype(np.int32)), pa.array((to - words.first[of]).astype(np.int32))],
                    names=["from", "to"])
                ranges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: width - 3], pa.array(words.count.astype(np.int64)),
                     pa.array(np.bincount(words.row[gone], minlength=b.num_rows).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ranges), spans),
                     _joined(words, ~gone) if joined else _cut_out(words, gone)], names=shape.names)

    return tagged.join(told, mine, "left").select(*columns, o, la, le).mapInArrow(finish, shape)
