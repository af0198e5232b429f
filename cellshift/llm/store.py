"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SMALL_BYTES = 64 << 20  # of a broadcast side's values at most


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there, lost executors reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values: the lengths of strings and binaries, 8 for each of the others."""
    wide = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    row = sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(8 * len(df.columns)).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def join_narrow(df: DataFrame, narrow: DataFrame, on: Column, how: str, name: str) -> DataFrame:
    """Join with a side of narrow rows, written and measured first: broadcast up to SMALL_BYTES, else shuffled."""
    side = stored(narrow, name)
    return df.join(F.broadcast(side) if value_bytes(side) <= SMALL_BYTES else side, on, how)
