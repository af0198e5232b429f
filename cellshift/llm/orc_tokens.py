"""Token ids in ORC files: run-length coded integers, row indexes, and a Bloom filter on the document id.

Rows are in ascending order of document id over all files, so stripes and row groups have narrow id ranges; a
reader prunes stripes by range and Bloom filter, and reads stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .tokens import tokenizer
from .wordarrays import slices

TEXT_BYTES = 4 << 20  # text whose distinct pieces are looked up at once; one longer text is handled alone, whole


def write_tokens(
    docs: DataFrame, out: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text",
    stripe_bytes: int = 64 << 20, index_rows: int = 1_000,
) -> None:
    """Write (key, ids, n_tokens, part, part_start), one row per document, ascending by key over the files.

    NULL text counts as empty (the end id alone); NULL keys come first; repeated keys lie next to each other by a
    hash of the text. ``part_start`` counts the ids before the row within its file.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches):
        own, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, text, TEXT_BYTES):
                raw = [ids + end for ids in own.ids_of(b.column(1))]
                n = np.array([len(r) // 4 for r in raw], np.int64)
                ends = before + np.cumsum(n)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), ids, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
                    names=[key, "ids", "n_tokens", "part", "part_start"])
                before = int(ends[-1])

    tie = F.xxhash64(text)
    (docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first(), tie)
     .sortWithinPartitions(F.col(key).asc_nulls_first(), tie)
     .mapInArrow(encode, f"`{key}` {kind}, ids array<int>, n_tokens long, part int, part_start long")
     .write.option("compression", "zstd").option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(index_rows)).orc(out))


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", keys: Sequence[int] | None = None) -> DataFrame:
    """Documents of the files (key, ids, n_tokens, part, part_start); only ``keys`` if given, by pruned stripes."""
    rows = spark.read.orc(path)
    return rows if keys is None else rows.where(F.col(key).isin(list(keys)))


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of the files at ``path`` with ``start``, the ids of all documents before; two narrow columns are read."""
    sizes = rows.sparkSession.read.orc(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, "part").withColumn("start", F.col("part_start") + F.col("_before")).drop(
        "part", "part_start", "_before")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_crc32`` in place of ``ids``: crc32 of the ids as little-endian 32-bit integers."""
    at = rows.columns.index("ids")
    shape = StructType([f for f in rows.schema if f.name != "ids"]).add("ids_crc32", "long")

    def crc(batches):
        for b in batches:
            ids = b.column(at)
            raw = memoryview(np.array(ids.values, dtype="<i4").tobytes())
            ends = np.array(ids.offsets, np.int64)
            sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(b.columns) if i != at), pa.array(sums, pa.int64())], names=shape.names)

    return rows.mapInArrow(crc, shape)
