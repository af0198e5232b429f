"""Collocations, whitening and concatenate-and-cut packing against brute force, on odd rows and on whole small tables."""

import collections
import random
import tracemalloc
import types
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellshift.llm import automata, collocations, concat, tokens, whitening
from cellshift.llm.queries import QUERIES
from cellshift.llm.store import stored

SF = "/root/testdata/sf0.01"


# 11 automata and collocations

def random_phrases(r, many=60, alphabet=4, depth=4):
    c = collections.Counter(tuple(r.randint(1, alphabet) for _ in range(r.randint(1, depth))) for _ in range(many))
    rows = sorted(c.items())
    paths = np.array([[*p, *[0] * (depth - len(p))] for p, _ in rows], np.uint64).reshape(-1, depth)
    return paths, np.array([n for _, n in rows], np.int64), c


def accepted(t, depth=4):
    paths, n = t.phrases(depth)
    return {tuple(int(x) for x in p if x): int(k) for p, k in zip(paths, n)}


def test_transducers_are_minimal_and_whole():
    r = random.Random(1)
    for _ in range(50):
        paths, n, c = random_phrases(r)
        t = automata.Transducer.unpack(automata.build(paths, n).pack())
        assert accepted(t) == c
        rights = {}  # no two states accept the same continuations with the same counts
        for s in range(len(t.first) - 1):
            arcs = slice(t.first[s], t.first[s + 1])
            key = (t.label[arcs].tobytes(), t.weight[arcs].tobytes(), t.target[arcs].tobytes())
            assert rights.setdefault(key, s) == s


def test_blocks_union_and_composition():
    r = random.Random(2)
    for _ in range(50):
        (p, n, c), (q, m, e) = random_phrases(r), random_phrases(r, many=30)
        b = automata.Builder()
        for label in range(1, 5):
            b.add(p[p[:, 0] == label], n[p[:, 0] == label])
        assert accepted(b.finish()) == c
        assert accepted(automata.union([automata.build(p, n), automata.build(q, m)], 4)) == c + e
        assert accepted(automata.union([automata.build(p, n), automata.build(q, m)], 4, 3)) == {k: v for k, v in (c + e).items() if v > 2}
        paths, found = automata.compose(automata.build(q, m), automata.build(p, n), 4)
        assert {tuple(int(x) for x in k if x): v for k, v in zip(paths, found)} == {k: c[k] for k in e if k in c}


def test_automata_of_nothing():
    nothing = automata.build(np.zeros((0, 3), np.uint64), np.zeros(0, np.int64))
    assert accepted(nothing, 3) == {}
    paths, n, _ = random_phrases(random.Random(3), depth=3)
    assert len(automata.compose(nothing, automata.build(paths, n), 3)[0]) == 0
    assert len(automata.compose(automata.build(paths, n), nothing, 3)[0]) == 0


@pytest.mark.parametrize("range_rows,filter_bits", [(1 << 20, 20), (40, 6)])
def test_collocations_equal_brute_force(spark, range_rows, filter_bits, monkeypatch):
    r = random.Random(4)
    word = ["the", "The", "of", "a", "bb", "ccc", "dé", "e", "x y", "\x00z"]
    weights = [30, 5, 20, 10, 5, 5, 3, 3, 2, 2]
    texts = []
    for _ in range(150):
        w = r.choices(word, weights, k=r.randint(0, 60))
        texts.append((r.choice(["en", None, "und", "fr"]), "".join(x + r.choice([" ", " ", " ", "\t", ", ", ".\n", " ;"]) for x in w)))
    texts += [("en", None), (None, ""), ("fr", " ,. "), ("en", "of the " * 300), ("de", "one"), texts[0], texts[0]]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    got = collocations.collocations(docs, least=8, top=40, range_rows=range_rows, filter_bits=filter_bits)
    assert sorted(tuple(x) for x in got.collect()) == brute.collocations(texts, 8, 40)


def test_collocations_of_odd_rows(odd, none):
    texts = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    got = collocations.collocations(odd, least=3, top=500)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == brute.collocations(texts, 3, 500)
    assert collocations.collocations(none, least=1).count() == 0


def test_collocation_tasks_send_early(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_ROWS", 20)
    monkeypatch.setattr(collocations, "SENT_ROWS", 30)
    r = random.Random(6)
    texts = [("en", " ".join(r.choice("abcdefg") for _ in range(40))) for _ in range(30)]
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(2)
    got = collocations.collocations(docs, least=4, top=100)
    assert sorted(tuple(x) for x in got.collect()) == brute.collocations(texts, 4, 100)


def test_blocks_merge_in_small_parts():
    r = random.Random(7)
    for rows in (1, 5, 40, 1000):
        blocks = [random_phrases(r, many=r.choice([0, 1, 60, 200])) for _ in range(r.randint(1, 6))]
        parts = list(automata.merged([b[:2] for b in blocks], rows))
        paths, n = [x for p, _ in parts for x in p.tolist()], [int(x) for _, c in parts for x in c]
        assert paths == sorted(paths) and all(len(p) <= rows + 2 * len(blocks) + 1 for p, _ in parts)
        total = sum((c for *_, c in blocks), collections.Counter())
        assert {tuple(x for x in p if x): k for p, k in zip(paths, n)} == total and len(paths) == len(total)
    assert list(automata.merged([], 5)) == []


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_collocations_of_phrases_cut_between_parts(spark, monkeypatch, parts):
    for name, rows in (("HELD_ROWS", 20), ("SENT_ROWS", 60), ("PART_ROWS", parts), ("SENT_BYTES", 500)):
        monkeypatch.setattr(collocations, name, rows)
    r = random.Random(8)
    texts = [(r.choice(["en", None]), " ".join(r.choice(["a", "B", "b", "cé", "d,", "e"]) for _ in range(60))) for _ in range(30)]
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(2)
    got = collocations.collocations(docs, least=4, top=100, range_rows=100)
    assert sorted(tuple(x) for x in got.collect()) == brute.collocations(texts, 4, 100)


class Tasks:
    """A table whose ``mapInArrow`` gives the task's function, to run it here."""

    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)

    def broadcast(self, value):
        return types.SimpleNamespace(value=value)

    def select(self, *_):
        return self

    def mapInArrow(self, task, schema):
        return task


@pytest.mark.parametrize("step", ["words", "pairs", "longer"])
def test_collocation_tasks_hold_little(step):
    """A task of many different words in two languages; labels, transducers and all merging included."""
    many, each = 300_000 if step == "longer" else 700_000, 1000
    code, lang = pa.array([1, 2] * 5), pa.array(["en", "de"] * 5)

    def batches():
        for i in range(0, many, 10 * each):
            text = pa.array([" ".join(f"w{(k * 7919) % many}" for k in range(j, j + each)) for j in range(i, i + 10 * each, each)])
            columns = {"text": text, "lang": lang, "code": code} if step == "words" else {"text": text, "code": code}
            yield pa.RecordBatch.from_pydict(columns)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = collocations.Filter(20, np.full(1 << 14, 2**64 - 1, np.uint64))
    ranges = collocations.Ranges(2, *none, *none)
    low, high = (2, 2) if step == "pairs" else (3, 5)
    task = collocations.word_counts(Tasks()) if step == "words" else collocations.shard_transducers(Tasks(), low, high, ranges, every)
    seen = 0
    tracemalloc.start()
    try:
        for b in task(batches()):
            if step == "words":
                seen += int(b.column(3).to_numpy().sum())
            else:
                paths, n = automata.Transducer.unpack(b.column(1)[0].as_buffer()).phrases(high)
                seen += int(n[(paths != 0).sum(axis=1) == low].sum())
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert seen == (many if step == "words" else many - many // each * (low - 1))
    assert peak < {"words": 80, "pairs": 110, "longer": 160}[step]


def test_collocation_stages_run_one_python_task(spark, monkeypatch, capsys):
    """Two Python steps in a row without a shuffle would need two workers a core, which Spark keeps."""
    plans = []

    def stored_with_plan(df, name):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return stored(df, name)

    monkeypatch.setattr(collocations, "stored", stored_with_plan)
    docs = spark.createDataFrame([("en", "a b c d e f a b c d e")] * 9, "lang string, text string")
    collocations.collocations(docs, least=4, top=100)
    assert len(plans) == 6 and "InArrow" in plans[-1]
    for plan in plans:
        above = []  # (depth, Python steps since the last exchange) from the root
        for line in plan.splitlines():
            node = line.lstrip(" :+-")
            depth = len(line) - len(node)
            above = [x for x in above if x[0] < depth]
            now = 0 if "Exchange" in node.split("(")[0] else (above[-1][1] if above else 0) + ("InArrow" in node.split("(")[0].split(" ")[0])
            above.append((depth, now))
            assert now <= 1, plan


# 12 whitening

def dense(x, components):
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return c @ q / np.sqrt(e), e / np.trace(v), ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)


def check_whitened(got, vectors, components):
    """Rows of ``whitened_components`` against a dense eigendecomposition; ``vectors`` by key."""
    keys = sorted(vectors)
    x = np.floor(64 * np.array([vectors[k] for k in keys], float)).astype(np.int64) + 1_000_000
    w, explained, deviation = dense(x, components)
    found = np.full(w.shape, np.nan)
    for r in got:
        i = keys.index(r.vec_id)
        found[i, r.component - 1] = r.whitened
        assert r.n == len(x) and int(r.deviation) == deviation[i] and r.identity_error < 1e-10
        assert abs(r.explained - explained[r.component - 1]) < 1e-10
    found *= np.sign((found * w).sum(axis=0))
    assert np.abs(found - w).max() < 1e-7


def test_whitening_equals_a_dense_decomposition(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert len(got) == 32 * e.count()
    check_whitened(got, {r.vec_id: r.embedding for r in e.collect()}, 32)


def test_whitening_leaves_out_broken_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "DIRECT_TASKS", 3)
    r = np.random.default_rng(1)
    good = {i: [float(v) for v in r.standard_normal(4) * [9, 3, 1, 0.5]] for i in range(50)}
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 0.0, 1.0]), (102, [nan, 0.0, 0.0, 0.0]), (103, [0.0, -inf, 0.0, 0.0]), (104, []), (105, [1.0])]
    d = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>")
    clash = d.select("*", F.lit(1).alias("whitened"), F.lit(2).alias("component"), F.lit(3).alias("_i"), F.lit(4).alias("n"))
    check_whitened(whitening.whitened_components(clash, components=4).collect(), good, 4)
    assert "_i" in whitening.whitened(clash.where("vec_id < 50"), whitening.fit(clash.where("vec_id < 50"), "embedding", 2)[0], "embedding").columns


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_spread_is_empty(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whitened_components(d)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_whitening_of_repeated_rows_and_flat_dimensions(spark):
    rows = [(i % 5, [float(i % 3), 2.0 * (i % 3), 7.0, float(i % 4)]) for i in range(24)] + [(None, [9.0, 18.0, 7.0, 1.0])]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 25 * 2 and max(r.component for r in got) == 2 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("values,wanted", [
    ([5, 5, 5, 3, 3, 1, 0, 0], 8), ([1] * 6, 6), (list(range(1, 13)), 5), ([50, 50, 40] + [1 + i / 100 for i in range(157)], 3)])
def test_bidiagonalisation_finds_equal_values(values, wanted):
    r = np.random.default_rng(2)
    d = len(values)
    a = np.linalg.qr(r.standard_normal((d + 30, d)))[0] * values @ np.linalg.qr(r.standard_normal((d, d)))[0]
    steps = []

    def product(t, left):
        p = a @ t
        steps.append(1)
        return (a @ left).T @ p, float(p @ p), a.T @ p

    sigma, right = whitening.bidiagonalise(product, d, wanted, 3)
    assert np.allclose(sigma, sorted(values, reverse=True)[:wanted], atol=1e-9)
    assert np.allclose(right @ right.T, np.eye(wanted), atol=1e-10)
    assert np.allclose(np.linalg.norm(a @ right.T, axis=0), sigma, atol=1e-9)
    assert d < 100 or len(steps) < d


def test_large_entries_raise():
    with pytest.raises(ValueError):
        whitening.integers(np.array([1e300]))


# 13 concatenate and cut

def check_cut(got, texts, capacity, end_id=2):
    """Rows against the texts' ids: all windows full but the last, each id in one piece."""
    lib = tokens.tokenizer(tokens.default_path()).lib
    all_ids = collections.defaultdict(list)
    for k, t in texts:
        all_ids[k].append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4"))
    total = sum(len(x) for v in all_ids.values() for x in v)
    by = collections.defaultdict(list)
    held = collections.Counter()
    for r in got:
        assert any(
            len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in all_ids[r.doc_id])
        by[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id] += r.length
    assert held == {k: sum(map(len, v)) for k, v in all_ids.items()}
    assert sorted(by) == list(range(-(-total // capacity)))
    for s, parts in by.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == (capacity if s < len(by) - 1 else total - capacity * s)


@pytest.mark.parametrize("run,capacity", [(1 << 20, 64), (50, 64), (7, 5)])
def test_cut_windows(odd, run, capacity):
    runs = stored(concat.token_runs(odd.repartition(3), tokens.default_path(), 2, run=run), "runs")
    check_cut(concat.cut(runs, capacity).collect(), [(r.doc_id, r.text) for r in odd.collect()], capacity)


def test_cut_whole_table(spark, docs):
    check_cut(QUERIES["op13_concat_cut_packing"](spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_cut_of_nothing(none):
    assert concat.cut(stored(concat.token_runs(none, tokens.default_path(), 2), "runs"), 8).count() == 0
    with pytest.raises(ValueError):
        concat.cut(none, 0)


def test_windows_hold_the_ids(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "five"), (3, None)], "doc_id long, text string").coalesce(1)
    p = concat.cut(stored(concat.token_runs(d, tokens.default_path(), 2), "runs"), 3, with_ids=True)
    got = concat.windows(p).orderBy("sequence_id").collect()
    lib = tokens.tokenizer(tokens.default_path()).lib
    ids = [i for t in ("one two three four", "five", "") for i in [*lib.encode(t, add_special_tokens=False).ids, 2]]
    assert np.frombuffer(b"".join(r.ids for r in got), "<u4").tolist() == ids
    assert sum(b.length for r in got for b in r.boundaries) == len(ids)
