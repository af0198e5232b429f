"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Pieces of one length are interchangeable, so the whole best-fit-decreasing run depends only on how many pieces there
are of each length: at most ``capacity`` numbers, whatever the corpus. The plan is made from that histogram with a
segment tree over remaining capacities; every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .columns import fresh, without
from .tokens import tokenizer
from .wordarrays import slices

BUCKET_ROWS = 65_536  # pieces of one length that are ranked in one task


class OpenCapacities:
    """Segment tree over remaining capacities 0..size-1: the least one at or above a need, in logarithmic time."""

    def __init__(self, size: int):
        self.leaf = 1 << (size - 1).bit_length()
        self.any = np.zeros(2 * self.leaf, bool)

    def mark(self, value: int, there: bool) -> None:
        i = self.leaf + value
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, need: int) -> int | None:
        i = self.leaf + need
        if i >= 2 * self.leaf:
            return None
        if self.any[i]:
            return need
        while i > 1:  # up to the first right sibling with an open bin, then down to its least leaf
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaf:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaf
            i //= 2
        return None


def best_fit_plan(histogram: Iterable[tuple[int, int]], capacity: int) -> dict[str, np.ndarray]:
    """Places for all pieces: (length, first rank, first sequence, offset), each row holding until the next rank.

    Equal to placing the pieces one by one, longest first, each into the tightest open sequence: a sequence takes
    pieces of one length until the next doesn't fit, before the next sequence of that room is touched.
    """
    rows: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> runs (first sequence, how many)
    tree, opened = OpenCapacities(capacity + 1), 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if not rooms[room]:
                tree.mark(room, True)
            rooms[room].append((first, many))

    for length, n in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens for sequences of {capacity}")
        rank = 0
        while rank < n:
            room = tree.least(length)
            if room is None:
                room, first, many = capacity, opened, -(-(n - rank) // (capacity // length))
                opened += many
            else:
                first, many = rooms[room].pop()
                if not rooms[room]:
                    tree.mark(room, False)
            each, used = room // length, capacity - room
            full = min(many, (n - rank) // each)
            for layer in range(each if full else 0):
                rows.append((length, rank, first, used + layer * length))
                rank += full
            rest = min(n - rank, each) if full < many else 0
            for layer in range(rest):
                rows.append((length, rank, first + full, used + layer * length))
                rank += 1
            put(room - each * length, first, full)
            if full < many:
                put(room - rest * length, first + full, 1)
                put(room, first + full + 1, many - full - 1)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(
    pieces: DataFrame, capacity: int, order: Sequence[str], length: str = "length", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit decreasing over all rows.

    Columns named sequence_id or offset are replaced. ``order`` are columns that tell rows apart; rows equal in all of them and in length are interchangeable. A NULL
    or non-positive length gets NULL place. A length over ``capacity`` raises. An empty table stays empty.
    """
    pieces = without(pieces, "sequence_id", "offset")
    held, first, many, place_ = (fresh(pieces, x) for x in ("_bucket", "_base", "_n", "_rank"))
    fits = F.col(length) > 0
    counts = {int(r[0]): r[1] for r in pieces.where(fits).groupBy(length).count().collect()}  # one row per length
    plan = best_fit_plan(counts.items(), capacity)
    buckets = [max(1, -(-counts.get(i, 0) // bucket_rows)) for i in range(capacity + 1)]
    if max(buckets) == 1:
        bucket = F.lit(0).cast("long")
    else:
        sizes = F.expr("array(" + ",".join(map(str, buckets)) + ")")
        bucket = F.pmod(F.xxhash64(*order), F.coalesce(F.get(sizes, F.col(length).cast("int")), F.lit(1)))
    part = pieces.withColumn(held, bucket)
    before = Window.partitionBy(length).orderBy(held).rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy(length, held).agg(F.count(F.lit(1)).alias(many)).select(
        length, held, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(length, held).orderBy(*order)
    ranked = part.withColumn(place_, F.row_number().over(within).cast("long"))
    if max(buckets) > 1:
        ranked = ranked.join(base, [length, held], "left").withColumn(place_, F.col(place_) + F.col(first))
    ranked = ranked.select(*pieces.columns, place_)
    shape = StructType(list(pieces.schema)).add("sequence_id", "long").add("offset", "long")
    names = pieces.columns
    keys = plan["length"] * (1 << 44) + plan["rank"]

    def place(batches):
        for b in batches:
            size = b.column(names.index(length)).cast(pa.int64())
            fit = np.array(size.fill_null(0)) > 0
            rank = np.array(b.column(len(names)), np.int64) - 1
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            at = np.searchsorted(keys, np.array(size.fill_null(0))[fit] * (1 << 44) + rank[fit], "right") - 1
            sequence[fit] = plan["sequence"][at] + rank[fit] - plan["rank"][at]
            offset[fit] = plan["offset"][at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(sequence, mask=~fit), pa.array(offset, mask=~fit)],
                names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, shape)


def token_pieces(
    docs: DataFrame, capacity: int, path: str, end_id: int, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each text's ids and ``end_id``, cut after every ``capacity`` ids.

    (key, piece, start, length, ids_crc32 and, with_ids, ids). A NULL or empty text is the end id alone; repeated rows
    and NULL keys give pieces of their own.
    """
    kind = docs.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        own = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in slices(whole, text):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    raw = own.ids(t or "") + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        chunk = raw[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(chunk) // 4)
                        crc.append(zlib.crc32(chunk))
                        if with_ids:
                            ids.append(np.frombuffer(chunk, "<i4"))
                out = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(key, text).mapInArrow(cut, shape)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences (sequence_id, ids) of packed pieces with ids; each holds at most the capacity."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
