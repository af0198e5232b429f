"""The stages, each against what it promises, on a small table and on odd rows."""

import brute
import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_work_on_odd_rows(spark, odd, none):
    assert 4 <= len(cp.STAGES) <= 5
    for start in (odd, none):
        docs = start
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            if stage is not cp.pack_sequences:
                assert out.columns == docs.columns, name
            out.collect()
            if start is none:
                assert out.count() == 0
        for name, stage in cp.STAGES:  # each stage on the odd rows themselves
            stage(spark, start, SF).collect()


def test_near_duplicates_leave_one(spark, docs, odd):
    for t in (docs.where("doc_id < 400"), odd):
        rows = [(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()]
        kept = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, t, SF).select("doc_id", "text").collect()]
        want = {(k, x) for (k, n, c), (_, x) in zip(brute.components(rows, 5, 80), rows) if k == c or not n}
        assert set(kept) == want and len([x for x in kept if brute.words(x[1])]) == len({x for x in kept if brute.words(x[1])})


def test_near_duplicates_of_one_id_or_none_leave_one(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    copies = lambda w: [" ".join(w), " ".join([*w[:59], "new"]), " ".join(w).upper()]
    rows = [(7, x) for x in copies(base)] + [(None, x) for x in copies(other)] * 2 + [(None, None), (None, "")]
    rows += [(7, "a text of its own " + " ".join(f"u{i}" for i in range(40)))]  # another group under the same id
    kept = [tuple(r) for r in cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert [sum(k == (i, x) for k in kept for x in set(t)) for i, t in ((7, copies(base)), (None, copies(other)))] == [1, 1]
    assert (7, rows[-1][1]) in kept and (None, None) in kept and (None, "") in kept and len(kept) == 5


def test_passages_stay_once(spark, docs):
    t = docs.where("doc_id < 300")
    rows = [(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()]
    gone = brute.removed(rows, 50)
    out = {r.doc_id: r for r in cp.substring_dedup(spark, t, SF).collect()}
    for (k, x), g in gone.items():
        if g and all(g):
            assert k not in out
        elif any(g):
            assert brute.words(out[k].text) == [w for w, d in zip(brute.words(x), g) if not d] and out[k].n_chars == len(out[k].text)
        else:
            assert out[k].text == x


def test_benchmark_documents_go(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r[0] for r in brute.contained(
        [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 80)}
    kept = {r.doc_id for r in cp.benchmark_decontamination(spark, docs, SF).collect()}
    assert bad and kept == {r.doc_id for r in docs.collect()} - bad


def test_quality_keeps_clean(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id").where(F.size(F.split("text", " ")) >= 20)
    kept = cp.quality_rules(spark, docs, SF)
    assert kept.join(clean.select("doc_id"), "doc_id").count() >= 0.97 * clean.count()


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
