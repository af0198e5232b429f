"""Phrase collocations from weighted acyclic automata.

Each task sorts the n-grams of its shard and builds minimal count transducers from them, one for each prefix range; the
transducers of a range are united and their weights summed; counts of a phrase's parts come from composing an acceptor
of the parts with the transducers of the ranges in which they lie.

Words are 63-bit labels of (language, lower-cased word). Words are counted first, then word pairs, then longer
phrases: a phrase can reach the least count only if all its words and pairs do, and a Bloom filter of fixed size tells
the tasks which may. What it lets through in error is counted and dropped, so it costs time at most. A prefix range is
an interval of first labels; a first word (or first pair) with more occurrences than a range should hold is split by
the label that follows it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .automata import Transducer, build, compose, merged, prefix_counts, sort_phrases, tally, union
from .columns import fresh
from .store import stored
from .wordarrays import FOLD, Words, mix, slices, trimmed

LONGEST = 5
RANGE_ROWS = 1 << 22  # occurrences that one prefix range should hold
FILTER_BITS = 26  # a filter has 2**26 bits (8 MB), whatever the corpus
HELD_ROWS = 1 << 18  # phrases a task holds before it counts them together
SENT_ROWS = 1 << 20  # counted words or longest phrases a task holds before it merges them; sent on if over half are distinct
SENT_BYTES = 1 << 26  # the same for words, by their bytes
PART_ROWS = 1 << 15  # counted phrases merged, and made a transducer, at once
SALTS = 64
UNKNOWN = "und"


def _bytes(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in text]] = True
    return out


ENDS = _bytes(".,;:!?\n\x0b\x0c\r")  # what separates pieces; phrases don't reach over them
BLANKS = _bytes(" \t")


Counted = tuple[np.ndarray, np.ndarray]  # ascending distinct phrases and their counts


class Ranges(NamedTuple):
    """Prefix ranges: 2**bits intervals of first labels, and extra ones for first words and first pairs that are hot."""

    bits: int
    words: np.ndarray  # hot first labels, ascending
    word_base: np.ndarray  # first range of each, and its number of ranges
    word_split: np.ndarray
    pairs: np.ndarray  # the same for hot first pairs
    pair_base: np.ndarray
    pair_split: np.ndarray

    def of(self, paths: np.ndarray) -> np.ndarray:
        out = (paths[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(paths), np.int64)
        for d, keys, base, split in (
            (1, self.words, self.word_base, self.word_split), (2, self.pairs, self.pair_base, self.pair_split),
        ):
            if len(keys) and paths.shape[1] >= d:
                key = paths[:, 0] if d == 1 else np.where(paths[:, 1] != 0, pair_key(paths[:, 0], paths[:, 1]), np.uint64(0))
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hot = keys[at] == key
                following = paths[hot, d] >> np.uint64(32) if paths.shape[1] > d else np.zeros(int(hot.sum()), np.uint64)
                out[hot] = base[at[hot]] + (following.astype(np.int64) * split[at[hot]] >> 32)
        return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a, 5) ^ b, 6) | np.uint64(1)


def _labels(words: Words, langs: np.ndarray) -> np.ndarray:
    """Label of each word: never 0, and different by language."""
    return mix(words.hashes(fold=True) ^ langs[words.row], 7) | np.uint64(1)


def _pieces(words: Words) -> np.ndarray:
    """Number of the piece of each word, ascending; rows and piece ends separate."""
    ends = np.concatenate([[0], np.cumsum(ENDS[words.data])])
    return ends[words.start] + words.row


def _lang_code() -> Column:
    return F.xxhash64("lang")


def _prepared(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(text, lang, code): NULL languages are UNKNOWN."""
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang")).select(
        "text", "lang", _lang_code().alias("code"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(label, lang, word, n) for each distinct word of each task; not yet summed over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column(0), ENDS | BLANKS)
                label, at, n = np.unique(
                    _labels(w, np.array(b.column(2), np.int64).view(np.uint64)), return_index=True, return_counts=True)
                if not len(label):
                    continue
                held.append(pa.RecordBatch.from_arrays(
                    [pa.array(label.view(np.int64)), b.column(1).take(pa.array(w.row[at])), _spelled(w, at), pa.array(n, pa.int64())],
                    names=["label", "lang", "word", "n"]))
                if sum(x.num_rows for x in held) > SENT_ROWS or sum(x.nbytes for x in held) > SENT_BYTES:
                    held = [_summed(held)]
                    if held[0].num_rows > SENT_ROWS // 2 or held[0].nbytes > SENT_BYTES // 2:
                        yield held.pop()
        if held:
            yield _summed(held)

    return docs.mapInArrow(lambda batches: trimmed(count(batches)), "label long, lang string, word string, n long")


def _spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The lower-cased words at the given places."""
    start, size = words.start[at], words.end[at] - words.start[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = FOLD[words.data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _summed(counts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each label, with the sum of its counts."""
    rows = pa.Table.from_batches(counts)
    label = rows["label"].to_numpy()
    order = np.argsort(label)
    first = np.concatenate([[0], np.flatnonzero(np.diff(label[order])) + 1])
    n = np.add.reduceat(rows["n"].to_numpy()[order], first)
    rows = rows.take(pa.array(order[first])).set_column(3, "n", pa.array(n, pa.int64()))
    return rows.combine_chunks().to_batches()[0]


class Filter(NamedTuple):
    """Bloom filter of two positions per key, of fixed size; ``None`` words let everything through."""

    bits: int
    words: np.ndarray

    def may(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in (keys >> np.uint64(64 - self.bits), (keys >> np.uint64(1)) & np.uint64((1 << self.bits) - 1)):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> Filter:
    """Filter of all keys, made in Spark: at most 2**(bits - 6) numbers reach the driver."""
    k = F.col(key)
    at = F.explode(F.array(F.shiftrightunsigned(k, 64 - bits), F.shiftrightunsigned(k, 1).bitwiseAND(F.lit((1 << bits) - 1))))
    set_bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    if set_bits.num_rows:
        words[np.array(set_bits["w"], np.int64)] = np.array(set_bits["b"], np.int64).view(np.uint64)
    return Filter(bits, words)


def _contexts(label: np.ndarray, linked: np.ndarray, low: int, high: int) -> np.ndarray:
    """The longest run of up to ``high`` linked words from each place, padded with 0; runs under ``low`` words are left out."""
    n = len(label)
    reach = np.ones(n, np.int64)
    going = np.ones(n, bool)
    for d in range(1, min(high, n)):
        step = np.zeros(n, bool)
        step[: n - d] = linked[d - 1 :]
        going = going & step
        reach += going
    at = np.flatnonzero(reach >= low)
    out = np.zeros((len(at), high), np.uint64)
    for d in range(high):
        held = reach[at] > d
        out[held, d] = label[at[held] + d]
    return out


def shard_transducers(docs: DataFrame, low: int, high: int, ranges: Ranges, allowed: Filter) -> DataFrame:
    """(range, automaton): transducers of the n-grams of ``low`` to ``high`` words of each task.

    ``allowed`` tells by word label (high = 2) or by pair (longer) which neighbours may belong to a frequent phrase.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranges, allowed))  # fixed size, and one entry for each range at most

    def send(parts: Iterable[Counted]) -> Iterator[pa.RecordBatch]:
        for part in parts:  # a prefix that reaches over two parts is counted in both
            paths, counts = prefix_counts(*part, low)
            place = shared.value[0].of(paths)
            order = np.lexsort((*paths.T[::-1], place))
            paths, counts, place = paths[order], counts[order], place[order]
            for a, b in _runs(place):
                yield _row(int(place[a]), build(paths[a:b], counts[a:b]))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Counted] = []
        held: list[np.ndarray] = []
        size = 0
        limit = SENT_ROWS * LONGEST // high
        may = shared.value[1].may
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column(0), ENDS | BLANKS)
                if len(w.start) < 2:
                    continue
                label, piece = _labels(w, np.array(b.column(1), np.int64).view(np.uint64)), _pieces(w)
                linked = piece[1:] == piece[:-1]
                if high == 2:
                    good = may(label)
                    linked &= good[1:] & good[:-1]
                else:
                    linked[linked] = may(pair_key(label[:-1][linked], label[1:][linked]))
                held.append(_contexts(label, linked, low, high))
                size += len(held[-1])
                if size > HELD_ROWS:
                    blocks.append(_block(held))
                    held, size = [], 0
                    if _rows(blocks) > limit:
                        blocks = list(merged(blocks, PART_ROWS))
                        if _rows(blocks) > limit // 2:
                            yield from send(blocks)
                            blocks = []
        if held:
            blocks.append(_block(held))
        yield from send(merged(blocks, PART_ROWS))

    return docs.select("text", "code").mapInArrow(lambda batches: trimmed(shard(batches)), "range long, automaton binary")


def _block(held: list[np.ndarray]) -> Counted:
    paths = np.concatenate(held)
    return tally(paths, np.ones(len(paths), np.int64))


def _rows(blocks: list[Counted]) -> int:
    return sum(len(paths) for paths, _ in blocks)


def _runs(place: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    return list(zip(cuts[:-1], cuts[1:])) if len(place) else []


def _row(place: int, automaton: Transducer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int64()), pa.array([automaton.pack()], pa.binary())], names=["range", "automaton"])


def united(automata: DataFrame, depth: int, least: int) -> DataFrame:
    """(range, automaton): one transducer for each prefix range, weights summed, sums below ``least`` dropped."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Counted] = []
        held: list[Counted] = []
        limit = SENT_ROWS
        for b in batches:
            for raw in b.column(b.schema.get_field_index("automaton")):
                held.append(Transducer.unpack(raw.as_buffer()).phrases(depth))
                if _rows(held) > HELD_ROWS:
                    blocks.append(tally(*map(np.concatenate, zip(*held))))
                    held = []
                    if _rows(blocks) > limit:  # a range's distinct phrases and as many again are held at most
                        blocks = list(merged(blocks, PART_ROWS))
                        limit = max(SENT_ROWS, 2 * _rows(blocks))
        if held:
            blocks.append(tally(*map(np.concatenate, zip(*held))))
        kept = [(paths[n >= least], n[n >= least]) for paths, n in merged(blocks, PART_ROWS)]
        if _rows(kept):
            yield _row(key[0].as_py(), build(*map(np.concatenate, zip(*kept))))

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(merge(key, batches))

    return automata.groupBy("range").applyInArrow(unite, "range long, automaton binary")


def _pairs(automata: DataFrame) -> DataFrame:
    """(key, n) of the word pairs of transducers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                paths, n = Transducer.unpack(raw.as_buffer()).phrases(2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair_key(paths[:, 0], paths[:, 1]).view(np.int64)), pa.array(n)], names=["key", "n"])

    return automata.select("automaton").mapInArrow(read, "key long, n long")


def _hot(counts: DataFrame, key: str, limit: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys with more than ``limit`` occurrences (at most all occurrences / ``limit`` of them), split evenly."""
    rows = counts.where(F.col("n") > limit).select(key, "n").toArrow()
    keys, n = np.array(rows[key], np.int64).view(np.uint64), np.array(rows["n"], np.int64)
    order = np.argsort(keys)
    split = -(-n[order] // limit)
    return keys[order], base + np.cumsum(split) - split, split


def _ranged(pairs: DataFrame, words: DataFrame, ranges: Ranges) -> DataFrame:
    """Pairs' transducers of any ranges and words (label, n) as transducers of the final ranges."""
    shared = words.sparkSession.sparkContext.broadcast(ranges)

    def place(paths: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = shared.value.of(paths)
        order = np.lexsort((*paths.T[::-1], at))
        paths, counts, at = paths[order], counts[order], at[order]
        for a, b in _runs(at):
            yield _row(int(at[a]), build(paths[a:b], counts[a:b]))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                yield from place(*Transducer.unpack(raw.as_buffer()).phrases(LONGEST))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = np.zeros((b.num_rows, LONGEST), np.uint64)
            paths[:, 0] = np.array(b.column(0), np.int64).view(np.uint64)
            yield from place(paths, np.array(b.column(1), np.int64))

    shape = "range long, automaton binary"
    return pairs.select("automaton").mapInArrow(lambda batches: trimmed(again(batches)), shape).union(words.select("label", "n").mapInArrow(single, shape))


def part_counts(counts: DataFrame, ranges: Ranges) -> DataFrame:
    """(labels, a, l, r) of all phrases of two words and more: l[k - 1] and r[k - 1] are the counts of the first k words
    and of the rest.

    ``counts`` are the transducers of all ranges. Each range sends acceptors of the parts it needs to the ranges in which
    they lie; there they are composed with the counts, and what comes back is united and composed with the phrases.
    """
    shared = counts.sparkSession.sparkContext.broadcast(ranges)

    def wanted(raw: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        paths, n = Transducer.unpack(raw.as_buffer()).phrases(LONGEST)
        size = (paths != 0).sum(axis=1)
        return paths[size > 1], n[size > 1], size[size > 1]

    def parts(paths: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of more than k words, their first k words and their rest."""
        row = np.flatnonzero(size > k)
        first, rest = np.zeros((2, len(row), LONGEST), np.uint64)
        first[:, :k] = paths[row, :k]
        rest[:, : LONGEST - k] = paths[row, k:]
        return row, first, rest

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, raw in zip(b.column(0).to_pylist(), b.column(1)):
                paths, _, size = wanted(raw)
                asked = np.concatenate([x for k in range(1, LONGEST) for x in parts(paths, size, k)[1:]])
                asked, _ = tally(asked, np.ones(len(asked), np.int64))
                at = shared.value.of(asked)
                order = np.lexsort((*asked.T[::-1], at))
                asked, at = asked[order], at[order]
                for x, y in _runs(at):
                    row = _row(int(at[x]), build(asked[x:y], np.ones(y - x, np.int64)))
                    yield row.append_column("source", pa.array([source], pa.int64()))

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        known = [Transducer.unpack(x.as_buffer()) for x in held["automaton"]]
        source, out = [], []
        for s, raw in zip(asked["source"].to_pylist(), asked["automaton"]):
            acceptor = Transducer.unpack(raw.as_buffer())
            for t in known:
                paths, n = compose(acceptor, t, LONGEST)
                order = sort_phrases(paths)
                source.append(s)
                out.append(build(paths[order], n[order]).pack())
        return pa.table({"range": pa.array(source, pa.int64()), "automaton": pa.array(out, pa.binary())})

    def collect(held: pa.Table, answers: pa.Table) -> pa.Table:
        labels, a, left, right = [], [], [], []
        for raw in held["automaton"]:
            paths, n, size = wanted(raw)
            if not len(paths):
                continue
            known, found = union([Transducer.unpack(x.as_buffer()) for x in answers["automaton"]], LONGEST).phrases(LONGEST)
            order = sort_phrases(known)
            known, found = np.ascontiguousarray(known[order]), found[order]
            l, r = np.zeros((2, len(paths), LONGEST - 1), np.int64)  # noqa: E741
            for k in range(1, LONGEST):
                row, first, rest = parts(paths, size, k)
                l[row, k - 1], r[row, k - 1] = _find(known, found, first), _find(known, found, rest)
            labels += [p[:m] for p, m in zip(paths.view(np.int64), size)]
            left += [x[: m - 1] for x, m in zip(l, size)]
            right += [x[: m - 1] for x, m in zip(r, size)]
            a.append(n)
        many = pa.list_(pa.int64())
        return pa.table({
            "labels": pa.array(labels, many), "a": pa.array(np.concatenate(a) if a else [], pa.int64()),
            "l": pa.array(left, many), "r": pa.array(right, many)})

    shape = "range long, automaton binary"
    asked = counts.mapInArrow(ask, shape + ", source long")
    answers = asked.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(answer, shape)
    return counts.groupBy("range").cogroup(answers.groupBy("range")).applyInArrow(
        collect, "labels array<long>, a long, l array<long>, r array<long>")


def _find(known: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of phrases that are among the ascending ``known`` ones."""
    if not len(asked):
        return np.zeros(0, np.int64)
    both, place = np.unique(np.concatenate([known, asked]), axis=0, return_inverse=True)
    out = np.zeros(len(both), np.int64)
    out[place.ravel()[: len(known)]] = counts
    return out[place.ravel()[len(known) :]]


def phrase_counts(
    docs: DataFrame, least: int, range_rows: int = RANGE_ROWS, filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame, DataFrame, Ranges]:
    """(transducers of all phrases with ``least`` occurrences, frequent words, words per language, ranges)."""
    shards = stored(word_counts(docs), "word-counts")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stored(shards.groupBy("label", "lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    total = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(total / range_rows))) if total else 0
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot_words = _hot(words, "label", range_rows, 1 << bits)
    ranges = Ranges(bits, *hot_words, *none)
    pairs = stored(united(shard_transducers(docs, 2, 2, ranges, key_filter(words, "label", filter_bits)), 2, least), "pairs")
    keys = stored(_pairs(pairs), "pair-keys")
    ranges = Ranges(bits, *hot_words, *_hot(keys, "key", range_rows, int((1 << bits) + hot_words[2].sum())))
    longer = united(shard_transducers(docs, 3, LONGEST, ranges, key_filter(keys, "key", filter_bits)), LONGEST, least)
    counted = longer.union(_ranged(pairs, words, ranges))  # longer phrases lie in the final ranges already
    return stored(united(counted, LONGEST, least), "phrases"), words, totals, ranges


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang",
    range_rows: int = RANGE_ROWS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The ``top`` phrases of two to five words of each language by their worst cut: (lang, rank, phrase, a, l, r, n, score).

    A phrase with a >= ``least`` occurrences, cut after its first k words whose parts occur l and r times, scores
    floor(1000 a n / (l r)) in a language of n words; the lowest cut counts. Phrases inside a longer one that occurs as
    often are left out. NULL texts are empty, NULL languages count as ``und``; repeated rows and NULL keys are texts of
    their own; an empty table gives no rows. Other columns don't matter.
    """
    docs = _prepared(docs, text, lang)
    counts, words, totals, ranges = phrase_counts(docs, least, range_rows, filter_bits)
    found = stored(part_counts(counts, ranges), "candidates")
    # a longer phrase that occurs as often as a part of it has also one of one word more that does
    m = F.size("labels")
    inner = found.where(m > 2).select(F.explode(F.filter(F.array(
        F.when(F.get("l", m - 2) == F.col("a"), F.slice("labels", F.lit(1), m - 1)),
        F.when(F.get("r", F.lit(0)) == F.col("a"), F.slice("labels", F.lit(2), m - 1))), lambda x: x.isNotNull())).alias("labels"))
    kept = found.join(inner.distinct(), "labels", "left_anti")
    named = kept.join(words.select(F.col("label"), "lang"), F.get("labels", F.lit(0)) == F.col("label")).drop("label")
    big = "decimal(38,0)"
    cut = F.expr(f"""array_min(transform(sequence(0, size(l) - 1), k -> struct(
        (cast(1000 as {big}) * a * n) div (cast(l[k] as {big}) * r[k]) as score, k as k, l[k] as l, r[k] as r)))""")
    scored = named.join(totals, "lang").select("lang", "labels", "a", "n", cut.alias("c")).select(
        "lang", "labels", "a", "n", "c.score", "c.l", "c.r")
    best = [F.desc("score"), F.desc("a")]
    # first within slices of a language, ties included, so that no task ranks a whole language
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("labels"), F.lit(SALTS)))
    salted = salted.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("at") <= top)
    place = salted.select("*", F.posexplode("labels").alias("i", "label"))
    spelled = place.join(words.select("label", "word"), "label").groupBy("lang", "labels", "a", "n", "score", "l", "r").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))
    return spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
