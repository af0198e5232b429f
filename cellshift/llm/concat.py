"""Concatenate-and-cut packing: all documents' ids in one stream, cut into windows of a fixed size.

Pass one writes each document's ids once, with its place inside its partition. The partitions' token totals give by
prefix sums where each begins in the stream, so pass two knows every document's global place without a sort or a
shuffle of ids: it cuts at the window ends and writes a boundary record for each piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import join_narrow
from .tokens import tokenizer
from .wordarrays import slices

RUN = 1 << 20  # ids of one text that are written in one row at most


def token_runs(
    docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", run: int = RUN,
) -> DataFrame:
    """Each text's ids and ``end_id``: (key, start, ids, doc_tokens, part, part_start); store it before it is packed.

    ``ids`` are little-endian unsigned 32-bit integers. A text of more than ``run`` ids takes several rows, whose
    ``start`` counts its ids before them. ``part_start`` counts the ids of the partition before the row. A NULL or empty
    text is the end id alone; repeated rows and NULL keys are documents of their own; an empty table gives no rows.
    Only ``key`` and ``text`` are read, so other columns of any name don't matter.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, text):
                row, start, ids, total = [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    raw = own.ids(t or "") + end
                    for at in range(0, len(raw), 4 * run):
                        row.append(i)
                        start.append(at // 4)
                        ids.append(raw[at : at + 4 * run])
                        total.append(len(raw) // 4)
                n = np.array([len(r) // 4 for r in ids], np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(total, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
                    names=[key, "start", "ids", "doc_tokens", "part", "part_start"])
                before = int(ends[-1])

    return docs.select(key, text).mapInArrow(
        encode, f"`{key}` {kind}, start long, ids binary, doc_tokens long, part int, part_start long")


def partition_starts(runs: DataFrame) -> DataFrame:
    """(part, part_from): the ids of all partitions before each one; one row per partition of ``token_runs``."""
    sizes = runs.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_from"))


def cut(runs: DataFrame, capacity: int, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Boundary records of the stream's windows of ``capacity`` ids, from a stored table of ``token_runs``.

    (key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids). ``sequence_id`` is the window's
    number from 0, ``offset`` the piece's place in it. All windows but the last are full; a document is cut only where a
    window ends (and at the rows of a text longer than a run).
    """
    if capacity < 1:
        raise ValueError("a window holds at least one id")
    kind = runs.schema[key].dataType.simpleString()
    placed = join_narrow(
        runs, partition_starts(runs), F.col("part") == F.col("_part"), "inner", "parts",
    ).select(key, "start", "ids", "doc_tokens", (F.col("part_start") + F.col("part_from")).alias("_at"))
    shape = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(2)
            n = np.array([len(r) // 4 for r in raws.to_pylist()], np.int64) if b.num_rows else np.zeros(0, np.int64)
            at = np.array(b.column(4), np.int64)
            first, last = at // capacity, (at + n - 1) // capacity
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            window = first[row] + nth
            begin = np.maximum(at[row], window * capacity)
            end = np.minimum(at[row] + n[row], (window + 1) * capacity)
            inside = begin - at[row]
            length = end - begin
            view = [memoryview(r.as_buffer()) for r in raws]
            chunks = [view[i][4 * a : 4 * (a + m)] for i, a, m in zip(row.tolist(), inside.tolist(), length.tolist())]
            take = pa.array(row)
            out = [b.column(0).take(take), pa.array(np.array(b.column(1), np.int64)[row] + inside), pa.array(length),
                   pa.array([zlib.crc32(c) for c in chunks], pa.int64()), b.column(3).take(take), pa.array(window),
                   pa.array(begin - window * capacity)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array([bytes(c) for c in chunks], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return placed.mapInArrow(pieces, shape + ", ids binary" * with_ids)


def windows(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The training sequences: (sequence_id, ids, boundaries) of ``cut(with_ids=True)``.

    ``ids`` are the window's ids as little-endian 32-bit integers without padding; ``boundaries`` lists its documents in
    order as (offset, length, key, start). A group is one window, so it holds at most ``capacity`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", key, "start", "ids")))
    joined = F.aggregate("_p", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", joined.alias("ids"), F.transform("_p", lambda p: p.dropFields("ids")).alias("boundaries"))
