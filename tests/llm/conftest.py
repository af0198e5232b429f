import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"

#: Columns whose names clash with what the operators add or use inside.
CLASHES = ("n_words", "KEPT", "shard", "_own", "sequence_id", "lang_pred", "_rank", "_measures", "host")


def odd_rows():
    """NULLs, empty and blank texts, a very long one, ties, repeated rows, near copies, a passage in two documents."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(200)]
    near = base[:40] + ["other"] + base[41:]
    passage = [word() for _ in range(70)]
    long = [word() for _ in range(30_000)]
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, " ".join(long)), (5, " ".join(base)), (5, " ".join(base)), (6, " ".join(base)),
        (7, " ".join(near)), (8, "Lone. " + " ".join(passage) + " end"), (9, " ".join(passage[:65])), (None, " ".join(base)),
        (None, None), (10, "the The THE"), (11, "a b"), (12, "a b"), (13, "x" * 50_000), (14, "é\u00a0ß\u2028 中文 \x1c end's"),
        (15, "same " * 100), (16, "A b c d e f\nA b c d e f\n"), (17, " ".join(long[:20] * 3)),
    ]
    return [(k, t, None if k == 4 else "en", "s", len(t) if t else None) for k, t in texts]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(odd_rows(), SCHEMA)
    return d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
