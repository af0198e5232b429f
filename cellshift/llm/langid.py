"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3 with counts gathered from all training text. A byte is coded in
its longest known context; if it wasn't seen there, an escape (method C: distinct followers over all followers plus
distinct ones) is coded and the context is shortened, down to a uniform byte. Counts are frozen, so a text's exact code
length in each language is a sum over its words; the shortest code names the language. Words (A-Z lower-cased) are coded
one by one, each with its closing blank, in contexts that begin at the blank before the word, so equal words cost the
same and each distinct word of a slice is scored once.

A model of up to MAX_CELLS cells is held in memory. A larger one stays a table that is joined with the contexts and bytes
of the texts' distinct words. Code lengths are whole multiples of 1 / UNIT bit and their sums are exact, so both forms
give the same results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import fresh, without
from .store import stored
from .wordarrays import FOLD, Words, buffers, slices

ORDER = 3
MAX_CELLS = 1 << 24  # contexts with followers times languages of a model that is held in memory; decides speed only
FLUSH = 1 << 22
UNIT = 1 << 23  # of a bit; the longest possible code of a byte, four escapes and 8 bits, stays below 2**31 units
WORD_BYTES = 1 << 24  # of distinct words in a batch


def _distinct(column: pa.Array, group: np.ndarray | None = None):
    """Flat bytes of the distinct words (a blank, the folded word, a blank), each word's place, and the inverse.

    Returns (flat, first place of each distinct word, its length with the closing blank, number, inverse, words).
    With ``group``, words of different groups of rows are distinct, and the group of each is returned for the words.
    """
    w = Words(column)
    h = w.hashes(fold=True)
    if group is not None:
        h = h ^ (group[w.row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, inverse, number = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    size = w.end[at] - w.start[at]
    first = np.cumsum(size + 2) - (size + 2)
    flat = np.full(int(first[-1] + size[-1] + 2) if len(at) else 0, 0x20, np.uint8)
    if len(at):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(first + 1, size) + within] = FOLD[w.data[np.repeat(w.start[at], size) + within]]
    return flat, first + 1, size + 1, number, inverse, w, at


def _coded(flat: np.ndarray, first: np.ndarray, size: np.ndarray):
    """For every byte to be coded: its word, the order of its longest context, and context and byte as one integer."""
    word = np.repeat(np.arange(len(first)), size)
    within = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(first, size) + within
    key = flat[at].astype(np.uint32) | (flat[at - 1].astype(np.uint32) << np.uint32(8))
    order = np.minimum(within + 1, ORDER)
    for k in range(2, ORDER + 1):
        deep = order >= k
        key[deep] |= flat[at[deep] - k].astype(np.uint32) << np.uint32(8 * k)
    return word, order, key


def _units(ratio: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(ratio) * UNIT).astype(np.int32)


@dataclass(frozen=True)
class PpmModel:
    """Code lengths in units: dense for order 1, and for deeper orders by known (context, byte), with escapes by context."""

    langs: tuple[str, ...]
    order1: np.ndarray
    deep: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def bits(self, order: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language, in units."""
        out = np.zeros((len(key), len(self.langs)), np.int32)
        todo = np.arange(len(key))
        for k in range(ORDER, 1, -1):
            at = todo[order[todo] >= k]
            keys, cost, contexts, escape = self.deep[k]
            if not len(keys) or not len(at):
                continue
            q = key[at] & np.uint32((1 << (8 * (k + 1))) - 1) if k < 3 else key[at]
            i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = keys[i] == q
            out[at[hit]] += cost[i[hit]]
            miss = at[~hit]
            j = np.minimum(np.searchsorted(contexts, q[~hit] >> np.uint32(8)), len(contexts) - 1)
            known = contexts[j] == q[~hit] >> np.uint32(8)
            out[miss[known]] += escape[j[known]]
            done = np.zeros(len(key), bool)
            done[at[hit]] = True
            todo = todo[~done[todo]]
        out[todo] += self.order1[key[todo] & np.uint32(0xFFFF)]
        return out

    def units(self, column: pa.Array) -> np.ndarray:
        """Code length in units of each whole row in each language."""
        flat, first, size, _, inverse, w, _ = _distinct(column)
        if not len(first):
            return np.zeros((len(column), len(self.langs)), np.int64)
        _, order, key = _coded(flat, first, size)
        by_word = np.add.reduceat(self.bits(order, key).astype(np.int64), np.cumsum(size) - size, axis=0)
        total = np.zeros((len(inverse) + 1, len(self.langs)), np.int64)
        np.cumsum(by_word[inverse], axis=0, out=total[1:])
        return total[w.first[1:]] - total[w.first[:-1]]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each whole row in each language."""
        return self.units(column) / UNIT


@dataclass(frozen=True)
class PpmTable:
    """A model that stays distributed.

    ``known`` has (level, key, {language: units of the byte where it was seen}), ``contexts`` has (level, context,
    {language: units of the escape}); languages are places in ``langs``.
    """

    langs: tuple[str, ...]
    known: DataFrame
    contexts: DataFrame


def compile_model(langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray) -> PpmModel:
    """The model of counted (language, order, context and byte); counts of an order feed those of the shorter ones."""
    size = len(langs)
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    carry_key, carry_n = np.zeros(0, np.uint32), np.zeros((0, size))
    for k in range(ORDER, -1, -1):
        mine = order == k
        width = np.uint32((1 << (8 * (k + 1))) - 1)
        keys, inv = np.unique(np.concatenate([key[mine], carry_key]) & width, return_inverse=True)
        counts = np.zeros((len(keys), size))
        np.add.at(counts, (inv[: mine.sum()], lang[mine]), n[mine])
        np.add.at(counts, inv[mine.sum() :], carry_n)
        level[k] = keys, counts
        carry_key, carry_n = keys, counts

    def costs(k: int, shorter: np.ndarray):
        """Cost of each known key of order k given the cost of its byte in the shorter context; contexts, escapes."""
        keys, counts = level[k]
        contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        escape = _units(np.where(total > 0, (total + kinds) / np.maximum(kinds, 1), 1.0))
        seen = _units(np.where(counts > 0, (total + kinds)[of] / np.maximum(counts, 1), 1.0))
        return keys, np.where(counts > 0, seen, escape[of] + shorter), contexts, escape

    flat = np.full((256, size), 8 * UNIT, np.int32)
    keys, cost, _, escape = costs(0, flat[level[0][0]])
    order0 = flat + (escape[0] if len(escape) else 0)
    order0[keys] = cost
    keys, cost, contexts, escape = costs(1, order0[level[1][0] & np.uint32(0xFF)])
    order1 = np.tile(order0, (256, 1))
    for c, e in zip(contexts, escape):
        order1[int(c) << 8 : (int(c) + 1) << 8] += e
    order1[keys] = cost
    model = PpmModel(tuple(langs), order1, {})
    for k in range(2, ORDER + 1):
        at = level[k][0]
        model.deep[k] = costs(k, PpmModel(model.langs, model.order1, model.deep | {
            d: (np.zeros(0, np.uint32),) * 4 for d in range(k, ORDER + 1)}).bits(np.full(len(at), k - 1), at))
    return model


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", max_cells: int = MAX_CELLS) -> PpmModel | PpmTable:
    """Model of all ``rows`` with a language; NULL texts and languages teach nothing.

    Contexts are counted within each task and summed by Spark. All counts reach the driver if they make up to
    ``max_cells`` cells; otherwise none does, and the model is a table.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged():
            for name, parts in held.items():
                code, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[name] = [(code, np.bincount(inv, np.concatenate([p[1] for p in parts])))]
            return sum(len(p[0][0]) for p in held.values())

        def emit():
            for name, [(code, n)] in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(code)), pa.array((code >> np.uint64(32)).astype(np.int32)),
                     pa.array((code & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "order", "key", "n"])
            held.clear()

        for whole in batches:
            for b in slices(whole, "text"):
                names = b.column(1).to_pylist()
                known = sorted(set(names))
                group = np.array([known.index(x) for x in names])
                flat, first, length, number, _, w, at = _distinct(b.column(0), group)
                word, order, key = _coded(flat, first, length)
                of = group[w.row[at]] if len(at) else np.zeros(0, int)
                code = (order.astype(np.uint64) << np.uint64(32)) | key
                for g, name in enumerate(known):
                    mine = of[word] == g
                    u, inv = np.unique(code[mine], return_inverse=True)
                    held.setdefault(name, []).append((u, np.bincount(inv, number[word[mine]], len(u))))
                    size += len(u)
                if size > FLUSH:
                    size = merged()
                    if size > FLUSH // 2:
                        yield from emit()
                        size = 0
        merged()
        yield from emit()

    counts = stored(rows.mapInArrow(count, "lang string, order int, key long, n long").groupBy("lang", "order", "key").agg(
        F.sum("n").alias("n")), "langid-counts")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # one row per language
    if counts.count() * len(langs) > max_cells:
        return _table(langs, counts)
    table = counts.toArrow()
    code = {x: i for i, x in enumerate(langs)}
    return compile_model(
        langs, np.array([code[x] for x in table["lang"].to_pylist()], int), np.array(table["order"], np.int32),
        np.array(table["key"], np.int64).astype(np.uint32), np.array(table["n"], np.float64))


def _table(langs: list[str], counts: DataFrame) -> PpmTable:
    """What ``compile_model`` makes, by Spark."""
    code = {x: i for i, x in enumerate(langs)}
    levels = stored(
        counts.select("lang", F.explode(F.expr("sequence(0, order)")).alias("level"), "key", "n")
        .withColumn("key", F.expr("key & (shiftleft(1L, 8 * (level + 1)) - 1)"))
        .groupBy("level", "key", "lang").agg(F.sum("n").alias("n"))
        .withColumn("context", F.expr("shiftright(key, 8)")), "langid-levels")
    totals = stored(levels.groupBy("level", "context", "lang").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds")), "langid-contexts")

    def costs(batches):
        for b in batches:
            total, kinds, n = (np.array(b[c], np.float64) for c in ("total", "kinds", "n"))
            yield pa.RecordBatch.from_arrays(
                [b["level"], b["place"], pa.array([code[x] for x in b["lang"].to_pylist()], pa.int32()),
                 pa.array(_units((total + kinds) / n))], names=["level", "place", "lang", "units"])

    def by_place(rows: DataFrame, place: str, n: str, out: str, name: str) -> DataFrame:
        cost = rows.select("level", F.col(place).alias("place"), "lang", "total", "kinds", F.col(n).alias("n")).mapInArrow(
            costs, "level int, place long, lang int, units int")
        return stored(cost.groupBy("level", F.col("place").alias(place)).agg(
            F.map_from_entries(F.collect_list(F.struct("lang", "units"))).alias(out)), name)  # a row for each language

    return PpmTable(
        tuple(langs), by_place(levels.join(totals, ["level", "context", "lang"]), "key", "n", "seen", "langid-known"),
        by_place(totals, "context", "kinds", "escape", "langid-escapes"))


def _has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    low = data | 0x20
    ascii_ = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in column[i].as_py() or "")
    return out


def _verdict(langs: tuple[str, ...], units: np.ndarray, lettered: np.ndarray) -> list[pa.Array]:
    """Language and score of rows with these code lengths."""
    if langs:
        best = units.argmin(1)
        share = 1 / np.exp2(np.maximum((units.min(1)[:, None] - units) / UNIT, -1000)).sum(1)
    else:
        n = len(lettered)
        best, share, lettered = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
    names = [langs[i] if ok else "und" for i, ok in zip(best, lettered)]
    return [pa.array(names, pa.string()), pa.array(np.where(lettered, share, 0.0))]


def _text_units(docs: DataFrame, model: PpmTable, text: str) -> DataFrame:
    """(h, g, units): code lengths in each language of every distinct text with a letter, by its 128-bit hash.

    A text is coded by its distinct words, and those by their contexts and bytes, for which the costs are looked up.
    """
    texts = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull()).select(
        *_hash("text", "h", "g"), "text").dropDuplicates(["h", "g"])

    def words(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                b = b.filter(pa.array(_has_letter(b["text"])))
                flat, first, size, number, _, w, at = _distinct(b["text"], np.arange(b.num_rows))
                row = w.row[at]
                begin = np.append(first - 1, len(flat))  # each word with the blanks around it
                i = 0
                while i < len(first):
                    j = max(i + 1, int(np.searchsorted(begin, begin[i] + WORD_BYTES, "right")) - 1)
                    word = pa.BinaryArray.from_buffers(
                        pa.binary(), j - i, [None, pa.py_buffer((begin[i : j + 1] - begin[i]).astype(np.int32)),
                                             pa.py_buffer(np.ascontiguousarray(flat[begin[i] : begin[j]]))])
                    yield pa.RecordBatch.from_arrays(
                        [b["h"].take(pa.array(row[i:j])), b["g"].take(pa.array(row[i:j])), word,
                         pa.array(number[i:j].astype(np.int64))], names=["h", "g", "word", "n"])
                    i = j

    counted = stored(texts.mapInArrow(words, "h long, g long, word binary, n long").select(
        "h", "g", *_hash("word", "v", "w"), "word", "n"), "langid-words")

    def steps(batches):
        for b in batches:
            for word in range(0, b.num_rows, 1 << 14):
                part = b.slice(word, 1 << 14)
                flat, begin = buffers(part["word"])
                of, order, key = _coded(flat, begin[:-1] + 1, np.diff(begin) - 1)
                for i in range(0, len(of), FLUSH):
                    at = pa.array(of[i : i + FLUSH])
                    yield pa.RecordBatch.from_arrays(
                        [part["v"].take(at), part["w"].take(at), pa.array(order[i : i + FLUSH].astype(np.int32)),
                         pa.array(key[i : i + FLUSH].astype(np.int64))], names=["v", "w", "order", "key"])

    coded = stored(counted.select("v", "w", "word").dropDuplicates(["v", "w"]).mapInArrow(
        steps, "v long, w long, order int, key long"), "langid-steps")
    needed = stored(coded.select("order", "key").distinct(), "langid-needed")
    places = f"sequence(0, {len(model.langs) - 1})"
    shorter, costs = None, None
    for k in range(ORDER + 1):
        at = (
            needed.where(F.col("order") >= k).select(F.expr(f"key & {(1 << 8 * (k + 1)) - 1}L").alias("key")).distinct()
            .withColumn("context", F.expr("shiftright(key, 8)"))
            .join(model.known.where(F.col("level") == k).select("key", "seen"), "key", "left")
            .join(model.contexts.where(F.col("level") == k).select("context", "escape"), "context", "left"))
        if shorter is None:
            at = at.withColumn("rest", F.expr(f"transform({places}, i -> {8 * UNIT})"))
        else:
            at = at.withColumn("short", F.expr(f"key & {(1 << 8 * k) - 1}L")).join(shorter, "short")
        cost = stored(at.select("key", F.expr(
            f"transform({places}, i -> coalesce(try_element_at(seen, i), coalesce(try_element_at(escape, i), 0) + rest[i]))"
        ).alias("cost")), f"langid-costs{k}")
        shorter = cost.select(F.col("key").alias("short"), F.col("cost").alias("rest"))
        cost = cost.withColumn("order", F.lit(k))
        costs = cost if costs is None else costs.unionByName(cost)

    def summed(units: str) -> list:
        return [F.array(*(F.sum(F.expr(f"{units}[{i}]")) for i in range(len(model.langs)))).alias("units")]

    by_word = coded.join(costs, ["order", "key"]).groupBy("v", "w").agg(*summed("cost"))
    return counted.join(by_word, ["v", "w"]).groupBy("h", "g").agg(*summed("n * units"))


def _hash(column: str, one: str, two: str) -> list:
    return [F.xxhash64(column).alias(one), F.xxhash64(F.lit(1), column).alias(two)]


def predict(
    docs: DataFrame, model: PpmModel | PpmTable, text: str = "text", out: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``docs`` with the language of the shortest code and its share of 2**-bits over all languages.

    ``und`` with score 0 for a NULL text, one without a letter, or a model without languages. Ties go to the first
    language by name. Columns named as ``out`` or ``score`` are replaced.
    """
    docs = without(docs, out, score)
    shape = StructType(list(docs.schema)).add(out, "string").add(score, "double")
    at = docs.columns.index(text)
    if isinstance(model, PpmTable):
        return _predict_joined(docs, model, text, shape)

    def judge(batches):
        for whole in batches:
            for b in slices(whole, text):
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *_verdict(model.langs, model.units(b.column(at)), _has_letter(b.column(at)))],
                    names=shape.names)

    return docs.mapInArrow(judge, shape)


def _predict_joined(docs: DataFrame, model: PpmTable, text: str, shape: StructType) -> DataFrame:
    langs, n = model.langs, len(docs.columns)
    h, g, units = (fresh(docs, x) for x in ("_h", "_g", "_units"))
    by_text = _text_units(docs, model, text).toDF(h, g, units)
    hashed = docs.select("*", *_hash(f"`{text}`", h, g)).join(by_text, [h, g], "left")

    def judge(batches):
        for b in batches:
            lettered = np.array(b.column(n).is_valid())
            known = np.zeros((b.num_rows, len(langs)), np.int64)
            known[lettered] = np.array(b.column(n).flatten(), np.int64).reshape(-1, len(langs))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *_verdict(langs, known, lettered)], names=shape.names)

    return hashed.select(*(f"`{c}`" for c in docs.columns), units).mapInArrow(judge, shape)
