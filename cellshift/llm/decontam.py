"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves.

A short test item inside a long document has a tiny Jaccard similarity with it, so documents are not compared whole.
Items are partitioned by shingle count into classes (2**(c-1), 2**c]; for each class a document is cut into windows of
2**(c+1) shingles every 2**c, so any 2**c consecutive shingles lie whole in one window. Window and item signatures are
minima under the same hash functions; a document is a candidate for an item when one minimum agrees anywhere. With 64
functions, a document that holds 80 % of an item's shingles, in one place or scattered, is missed with a chance of
about exp(-64 * 0.8 / 4.2), five in a million. Candidates are decided on the whole document by exact shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .wordarrays import FOLD, NOT_ALNUM, Words, mix, slices, windows

SHINGLE = 5
FUNCTIONS = 64
BLOCK_BYTES = 4 << 20  # item text held by each task at once; larger benchmarks take a pass over the documents per block


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, n + 1, dtype=np.uint64)
    return mix(seeds, 3), mix(seeds, 5) | np.uint64(1)


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, in order, and each one's row; a row of fewer words has all of them as one shingle."""
    h = words.hashes(fold=True)
    g, inside = windows(h, words.row, SHINGLE)
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    rows = np.concatenate([words.row[: len(g)][inside], short])
    extra = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short):
        a, b = words.first[r], words.first[r + 1]
        extra[i] = windows(h[a:b], words.row[a:b], b - a)[0][0]
    values = np.concatenate([g[inside], extra])
    order = np.argsort(rows, kind="stable")
    return values[order], rows[order]


def shingle_set(text: bytes) -> set[bytes]:
    """The shingles themselves: A-Z lower-cased, words of letters, digits and non-ASCII characters, joined by spaces."""
    table = bytes(32 if NOT_ALNUM[b] else int(FOLD[b]) for b in range(256))
    w = text.translate(table).split(b" ")
    w = [x for x in w if x]
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


class ItemIndex:
    """Signatures and shingle sets of one block of items."""

    def __init__(self, texts: pa.Array):
        self.sets = [shingle_set((t or "").encode()) for t in texts.to_pylist()]
        values, rows = shingle_hashes(Words(texts, NOT_ALNUM))
        xor, times = _functions(FUNCTIONS)
        self.classes: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        present, start = np.unique(rows, return_index=True)
        minima = [np.minimum.reduceat((values ^ x) * t, start) if len(start) else values for x, t in zip(xor, times)]
        size = np.array([max(1, (len(self.sets[r]) - 1).bit_length()) if len(self.sets[r]) > 1 else 1 for r in present], int)
        for c in np.unique(size):
            of = np.flatnonzero(size == c)
            tables = []
            for m in minima:
                order = of[np.argsort(m[of], kind="stable")]
                tables.append((m[order], present[order]))
            self.classes[int(c)] = tables

    def candidates(self, values: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs with an agreeing minimum; rows come in order."""
        if not len(values) or not self.classes:
            return set()
        out: set[tuple[int, int]] = set()
        xor, times = _functions(FUNCTIONS)
        present, first = np.unique(rows, return_index=True)
        count = np.diff(np.append(first, len(rows)))
        low, high = min(self.classes), max(self.classes)
        layout = []  # by class: starts of blocks in the level below, document of each block, whether the next block is its own
        below, n = first, count
        for c in range(low, high + 1):
            step = 1 << low if c == low else 2
            blocks = -(-n // step)
            doc = np.repeat(np.arange(len(n)), blocks)
            within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            layout.append((below[doc] + within * step, doc, np.append(doc[1:] == doc[:-1], False)))
            below, n = np.cumsum(blocks) - blocks, blocks
        for i in range(FUNCTIONS):
            level = (values ^ xor[i]) * times[i]
            for c, (starts, doc, more) in zip(range(low, high + 1), layout):
                level = np.minimum.reduceat(level, starts)
                if c not in self.classes:
                    continue
                both = level.copy()
                both[:-1] = np.where(more[:-1], np.minimum(level[:-1], level[1:]), level[:-1])
                known, items = self.classes[c][i]
                left = np.searchsorted(known, both)
                hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == both)
                for w in hit:
                    j = left[w]
                    while j < len(known) and known[j] == both[w]:
                        out.add((int(present[doc[w]]), int(items[j])))
                        j += 1
        return out

    def matches(self, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) where a row holds at least ``percent`` of an item's shingles."""
        words = Words(texts, NOT_ALNUM)
        by_row: dict[int, list[int]] = {}
        for r, item in self.candidates(*shingle_hashes(words)):
            by_row.setdefault(r, []).append(item)
        for r in sorted(by_row):
            own = shingle_set(words.data[words.offsets[r] : words.offsets[r + 1]].tobytes())
            for item in sorted(by_row[r]):
                shared = len(self.sets[item] & own)
                if shared * 100 >= len(self.sets[item]) * percent:
                    yield r, item, shared


def item_blocks(items: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The items in blocks of about ``block_bytes`` of text, each collected on its own."""
    total = items.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = total // block_bytes + 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(*items.columns), F.lit(n)) == b)
        yield part.toArrow()


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", percent: int = 80,
) -> DataFrame:
    """(key, item_key, n_shared, n_shingles): every document that holds ``percent`` of an item's shingles.

    One row per document row and item row. Shingles are five words, case and ASCII punctuation aside; a text of fewer
    words is one shingle, one without words or NULL has none and matches nothing. An empty table on either side gives
    an empty result. If both keys have one name, the item's gets ``item_`` in front.
    """
    named = f"item_{item_key}" if key.lower() == item_key.lower() else item_key
    shape = StructType([
        StructField(key, docs.schema[key].dataType), StructField(named, items.schema[item_key].dataType),
        *StructType().add("n_shared", "long").add("n_shingles", "long")])
    out = docs.sparkSession.createDataFrame([], shape)
    for table in item_blocks(items.select(item_key, item_text), item_text):
        ids, texts = table.column(0).combine_chunks(), table.column(1).combine_chunks()

        def search(batches, ids=ids, texts=texts):
            index = ItemIndex(texts)
            for whole in batches:
                for b in slices(whole, text):
                    found = list(index.matches(b.column(1), percent))
                    rows, which, shared = (pa.array([f[i] for f in found], pa.int64()) for i in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), ids.take(which), shared,
                         pa.array([len(index.sets[f[1]]) for f in found], pa.int64())], names=shape.names)

        if len(ids):
            out = out.union(docs.select(key, text).mapInArrow(search, shape))
    return out


def decontaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", percent: int = 80,
) -> DataFrame:
    """``docs`` without the rows that hold ``percent`` of an item's shingles; no shuffle, all columns stay."""
    at, shape = docs.columns.index(text), docs.schema
    for table in item_blocks(items.select(item_text), item_text):
        texts = table.column(0).combine_chunks()

        def keep(batches, texts=texts):
            index = ItemIndex(texts)
            for whole in batches:
                for b in slices(whole, text):
                    clean = np.ones(b.num_rows, bool)
                    clean[[r for r, _, _ in index.matches(b.column(at), percent)]] = False
                    yield b.filter(pa.array(clean))

        if len(texts):
            docs = docs.mapInArrow(keep, shape)
    return docs
