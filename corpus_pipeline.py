"""Corpus pipeline: documents through the operators of cellshift.llm, stage by stage.

Quality rules drop texts that fail, near duplicates leave one document of each group, repeated passages stay once,
documents with benchmark items go, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm import decontam, ngram_join, packing, quality, substring, tokens
from cellshift.llm.columns import fresh
from cellshift.llm.store import join_narrow, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are good with a posterior probability of at least one half."""
    q, p, kept = (fresh(docs, x) for x in ("_measures", "_probability", "_kept"))
    measured = stored(quality.measures(docs, "text", q), "measured")  # read twice, measured once
    model = quality.fit(measured, q)
    return quality.judge(measured, q, model, p, kept).where(kept).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles: the least by doc_id and hash of the text.

    Repeated rows of one doc_id and text leave one row; documents without shingles all stay.
    """
    group = stored(ngram_join.jaccard_components(docs, size=5, percent=80, leader=True), "groups")
    key, code = fresh(docs, "_key"), fresh(docs, "_code")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(code))
    rows = group.select(F.col("doc_id").alias(key), F.col("text_hash").alias(code), "n_shingles", "leader_key", "leader_hash")
    first = F.col(key).eqNullSafe(F.col("leader_key")) & (F.col(code) == F.col("leader_hash"))
    gone = rows.where(~first).select(key, code).distinct()
    left = join_narrow(docs, gone, same, "left_anti", "gone")
    again = rows.where("n_shingles > 0").groupBy(key, code).count().where("count > 1").select(key, code)
    if again.isEmpty():
        return left
    return join_narrow(left, again, same, "left_anti", "repeated").unionByName(
        join_narrow(left, again, same, "left_semi", "repeated").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word runs of 50 or more that occur earlier; n_chars is counted anew where words went.

    A document that loses all its words goes.
    """
    n, lost, spans, kept = names = tuple(fresh(docs, x) for x in ("_n", "_lost", "_spans", "_kept"))
    done = substring.deduplicated(docs, size=50, names=names)
    changed = F.col(lost) > 0
    columns = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length(kept).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return done.where((F.col(lost) == 0) | (F.col(lost) < F.col(n))).select(
        *(columns.get(c, F.col(c)) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of the five-word shingles of every benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of every kept document into sequences of 2048 tokens, one row per piece."""
    pieces = packing.token_pieces(docs, 2048, tokens.default_path(), end_id=0)
    return packing.pack(stored(pieces, "pieces"), 2048, ["doc_id", "piece", "start", "ids_crc32"])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # a fitted model and a tokenizer; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
