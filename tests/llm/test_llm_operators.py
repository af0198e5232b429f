"""The operators against brute force, on a table of odd rows, on an empty one and on whole small tables."""

import collections
import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellshift.llm import (
    chat, decontam, langid, ngram_join, orc_tokens, packing, quality, sharding, substring, tokens, url_filter,
)
from cellshift.llm.queries import ORACLES, QUERIES
from cellshift.llm.store import shared_path

SF = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def raw(t):
    return rows(t, "doc_id", "text")


# 1 packing

def check_packed(got, capacity):
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_packing_is_best_fit_decreasing(odd, bucket_rows):
    path = tokens.default_path()
    pieces = packing.token_pieces(odd, 128, path, 0)
    got = packing.pack(pieces.withColumn("_rank", F.lit(0)), 128, ["doc_id", "piece", "ids_crc32"], bucket_rows=bucket_rows).collect()
    lib = tokens.tokenizer(path).lib
    expected = collections.Counter()
    for k, t in raw(odd):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 128)):
            expected[k, p, a, len(ids[a : a + 128]), zlib.crc32(np.array(ids[a : a + 128], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert check_packed(got, 128) == brute.best_fit_bins([r.length for r in got], 128)


def test_plan_equals_one_by_one():
    r = random.Random(1)
    for _ in range(100):
        capacity = r.randint(1, 40)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        plan = packing.best_fit_plan(collections.Counter(lengths).items(), capacity)
        assert len(set(plan["sequence"])) <= brute.best_fit_bins(lengths, capacity)
        used, last = collections.Counter(), {}
        ends = [*zip(plan["length"], plan["rank"])]
        for i, (n, k) in enumerate(ends):
            to = ends[i + 1][1] if i + 1 < len(ends) and ends[i + 1][0] == n else lengths.count(n)
            for x in range(to - k):
                used[plan["sequence"][i] + x] += n
        assert sum(used.values()) == sum(lengths) and max(used.values(), default=0) <= capacity
        assert len(used) == brute.best_fit_bins(lengths, capacity)


def test_packing_odd_lengths_and_empty(spark, none):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 3)], "k long, length long")
    got = {r.k: r for r in packing.pack(t, 8, ["k"]).collect()}
    assert got[2].sequence_id is None and got[3].offset is None and got[1].sequence_id == got[4].sequence_id
    assert packing.pack(packing.token_pieces(none, 8, tokens.default_path(), 0), 8, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(t, 4, ["k"])


def test_sequences_hold_the_ids(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    p = packing.pack(packing.token_pieces(d, 16, tokens.default_path(), 0, with_ids=True), 16, ["doc_id", "piece"])
    assert sum(len(r.ids) for r in packing.sequences(p).collect()) == sum(r.length for r in p.collect())


def test_tokens_equal_the_library():
    t = tokens.tokenizer(tokens.default_path())
    r = random.Random(2)
    chars = list("abXYZ éÉßÀ×’'\u0085\x1c\t\n 09.,!_-µªΣσİı\u212a\u0130中ـ́😀<|>") + ["<|endoftext|>"]
    for _ in range(5000):
        x = "".join(r.choice(chars) for _ in range(r.randint(0, 14)))
        assert t.ids(x) == np.array(t.lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_columns_of_texts_give_the_library_s_ids():
    t = tokens.WordTokenizer(tokens.default_path())
    r = random.Random(3)
    chars = list("abXYZ éÉßÀ×’'\u0085\x1c\t\n 09.,!_-|<>ªİ\u212a\u0130中\u030c😀J") + ["<|endoftext|>"]
    plain = list("abXYZ éÉß÷ÀÞ\t\n\x0b 09.,!_-|<>J")
    for some in (chars, plain):
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None, "", " "]
        r.shuffle(texts)
        want = [np.array(t.lib.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert t.ids_of(pa.array(texts)) == want
        assert t.ids_of(pa.array(texts).slice(5, 70)) == want[5:75]
    assert t.ids_of(pa.array([], pa.string())) == [] and t.ids_of(pa.array([None], pa.string())) == [b""]


def test_columns_of_texts_look_a_piece_up_once():
    t = tokens.WordTokenizer(tokens.default_path())
    looked_up = []

    class Seen(type(t.pieces)):
        def __getitem__(self, piece):
            looked_up.append(piece)
            return super().__getitem__(piece)

    t.pieces = Seen()
    t.ids_of(pa.array(["The cat, the dog.", "the end, 11"] * 500))
    assert sorted(filter(None, looked_up)) == sorted(["the", "cat", "dog", "end", ",", ".", "1"])


# 2 Jaccard join

@pytest.mark.parametrize("pair_list,tile", [(32, 256), (2, 2)])
def test_components_on_odd_rows(odd, pair_list, tile):
    got = ngram_join.jaccard_components(odd, size=4, percent=60, pair_list=pair_list, tile=tile)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(raw(odd), 4, 60), key=str)


@pytest.mark.parametrize("percent", [50, 85])
def test_components_of_random_near_copies(spark, percent):
    r = random.Random(percent)
    bases = [[r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(r.randint(5, 60))] for _ in range(12)]
    texts = []
    for i in range(150):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice("xyz") + str(r.randint(0, 9))
        texts.append((i, " ".join(w)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngram_join.jaccard_components(d, size=4, percent=percent, pair_list=4, tile=8)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(texts, 4, percent), key=str)


def test_components_of_empty(none):
    assert ngram_join.jaccard_components(none).count() == 0


# 3 languages

def test_language_held_out(docs):
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = langid.predict(docs.where(fold == 2), langid.fit(docs.where(fold != 2))).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_code_lengths_equal_a_plain_tree():
    """Scores of the table form against counts kept in dictionaries and walked byte by byte."""
    import math

    import pyarrow as pa

    train = {"a": ["the cat sat on the mat", "the dog"], "b": ["le chat est sur le tapis"]}
    counts = {x: collections.defaultdict(collections.Counter) for x in train}

    def steps(word):
        s = b" " + word + b" "
        for i in range(1, len(s)):
            for k in range(min(3, i), -1, -1):
                yield i, s[i - k : i], s[i]

    for x, texts in train.items():
        for t in texts:
            for w in t.encode().split():
                for _, c, y in steps(w):
                    counts[x][c][y] += 1

    def bits(x, text):
        total = 0.0
        for w in text.encode().split():
            by = collections.defaultdict(list)
            for i, c, y in steps(w):
                by[i].append((c, y))
            for chain in by.values():
                for c, y in chain:
                    n, u = sum(counts[x][c].values()), len(counts[x][c])
                    if n and counts[x][c][y]:
                        total += math.log2((n + u) / counts[x][c][y])
                        break
                    if n:
                        total += math.log2((n + u) / u)
                else:
                    total += 8
        return total

    flat = [(x, t) for x, ts in train.items() for t in ts]
    names = sorted(train)
    group = np.array([names.index(x) for x, _ in flat])
    f, first, size, number, _, w, at = langid._distinct(pa.array([t for _, t in flat]), group)
    word, order, key = langid._coded(f, first, size)
    model = langid.compile_model(names, group[w.row[at]][word], order, key, number[word].astype(float))
    texts = ["the cat", "le tapis", "zzz é", "chat chat dog", ""]
    got = model.lengths(pa.array(texts))
    assert np.allclose(got, [[bits(x, t) for x in names] for t in texts], atol=1e-3)


def test_language_odd_and_empty(odd, none):
    out = {(r.doc_id, r.text): r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert out[1, None].lang_pred == "und" and out[2, ""].score == 0 and out[5, dict(raw(odd))[5]].lang_pred == "en"
    assert langid.predict(none, langid.fit(odd)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


@pytest.mark.parametrize("max_cells", [0, 200])
def test_language_model_too_large_for_memory(docs, odd, max_cells):
    """A small bound must not lose counts: predictions and scores are those of the model in memory."""
    few = docs.where("doc_id % 40 = 0")
    for train, text in ((few, few), (docs.where("doc_id % 40 = 1"), odd)):
        full, bound = langid.fit(train), langid.fit(train, max_cells=max_cells)
        cols = ("doc_id", "text", "lang_pred", "score")
        assert rows(langid.predict(text, bound), *cols) == rows(langid.predict(text, full), *cols)
        assert langid.predict(text, bound).columns == langid.predict(text, full).columns


# 4 urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("org", "block")]


def judged(url):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = brute.lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    fit = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]):])]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("max_bits", [1 << 24, 1])
def test_url_rules(spark, max_bits):
    urls = [None, "", "no scheme", "http://", "http://COM/", "https://a.b.example.com/en/x?q#f", "http://www.example.com/en/",
            "http://xwww.example.com/en/1", "http://example.com", "ftp://x.net/es/", "http://x.net/es", "http://x.net?/es/",
            "http://a.org", "http://a.org/b", "http://org.", "http://İ.com/é", "x://y://z.com/", "http://com/en/\n/x"] * 2
    r = random.Random(3)
    urls += ["http://" + ".".join(r.choice(["a", "example", "com", "net", "www", "org"]) for _ in range(r.randint(1, 4)))
             + r.choice(["", "/", "/en/", "/es/x", "/en"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "block"), ("com/", "allow")], "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules, max_bits=max_bits).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in url_filter.url_verdicts(pages, none).collect()} == {"allow"}
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


def test_cascade_is_exact(spark):
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    every = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.cascade(listed, every)
    assert len(levels) > 2
    got = every.where(url_filter.member(levels, F.col("key"))).count()
    assert got == listed.count() and listed.where(url_filter.member(levels, F.col("key"))).count() == got


# 5 quality

def test_measures(odd, docs):
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for t in (odd, docs.limit(300)):
        got = rows(quality.measures(t, "text", "_measures"), "doc_id", *(f"_measures.{c}" for c in base))
        assert got == sorted(((k, *brute.measures(x)) for k, x in raw(t)), key=str)


def test_quality_separates_labels(spark, docs):
    m = quality.measures(docs, "text", "q")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge(m, "q", quality.fit(m, "q"), "p", "kept").where(~quality.base_failed("q")).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_estimate_finds_accuracies():
    r = random.Random(4)
    counts = collections.Counter()
    for _ in range(20_000):
        good = r.random() < 0.8
        counts[tuple((-1 if r.random() < (0.001 if good else f) else 0) for f in (0.7, 0.6, 0.5))] += 1
    model = quality.estimate(sorted(counts.items()), ["x", "y", "z"])
    assert abs(model.prior - 0.8) < 0.08 and all(a > 0.9 for a in model.accuracies) and all(w[0] < -3 for w in model.weights)


def test_quality_odd_and_empty(odd, none):
    m = quality.measures(odd, "text", "_measures")
    got = quality.judge(m, "_measures", quality.fit(m, "_measures"), "p", "kept").where("kept").select("doc_id").collect()
    assert 1 not in [r.doc_id for r in got] and len(got) >= 1
    e = quality.measures(none, "text", "q")
    assert quality.judge(e, "q", quality.fit(e, "q"), "p", "k").count() == 0


# 6 sharding

def test_shards(odd, none):
    for t, n in ((odd, 3), (odd.union(odd), 7), (odd.limit(1), 40), (none, 4)):
        got = sharding.feistel_shards(t, n, seed=3).collect()
        assert len(got) == t.count()
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by[i]) for i in range(n)]
        assert max(sizes) - min(sizes) <= 1


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 9)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 50 or got != sorted(got)


def test_shards_do_not_depend_on_partitions(docs):
    a = rows(sharding.feistel_shards(docs, 40, 1), "doc_id", "shard", "slot")
    assert a == rows(sharding.feistel_shards(docs.repartition(13), 40, 1), "doc_id", "shard", "slot")
    assert a != rows(sharding.feistel_shards(docs, 40, 2), "doc_id", "shard", "slot")


# 7 decontamination

def test_containment(spark, odd, none, docs):
    items = spark.createDataFrame(
        [(1, dict(raw(odd))[9]), (2, None), (3, ""), (4, "a, b!"), (5, "the the the"), (6, "nothing of this is there at all"), (1, "a b")],
        "item_id long, text string")
    got = decontam.contaminated(odd, items)
    assert rows(got, *got.columns) == brute.contained(raw(odd), rows(items, "item_id", "text"), 80)
    kept = decontam.decontaminated(odd, items)
    assert kept.columns == odd.columns
    hit = {r.doc_id for r in got.collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in raw(odd)} - hit
    assert decontam.contaminated(none, items).count() == decontam.contaminated(odd, items.limit(0)).count() == 0
    assert "item_doc_id" in decontam.contaminated(odd, odd, item_key="doc_id").columns


def test_containment_with_edits_and_blocks(spark, monkeypatch, docs):
    r = random.Random(6)
    long = [str(r.randint(0, 10**6)) for _ in range(20_000)]
    items = [(i, " ".join(long[a : a + r.randint(6, 90)])) for i, a in enumerate(r.sample(range(19_000), 60))]
    texts = [(0, " ".join(long))]
    for i in range(60):  # an item broken in two places, far apart
        w = items[i][1].split()
        cut = len(w) // 2
        texts.append((i + 1, " ".join(w[:cut] + long[100:400] + w[cut:])))
    d, t = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (2000,))
    got = decontam.contaminated(d, t)
    assert rows(got, *got.columns) == brute.contained(texts, items, 80)


def test_many_rows_without_id_and_text_links(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    rows_ = [(None, t) for t in base for _ in range(50)] + [(None, t + " end") for t in base]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows_, "doc_id long, text string"), leader=True).collect()
    assert len(got) == len(rows_) and len({r.leader_hash for r in got}) == 40


# 8 substrings

def test_removed_words(odd, none):
    expected = brute.removed(raw(odd), 20)
    got = substring.deduplicated(odd, size=20, joined=True, names=("nw", "nr", "spans", "left"))
    assert got.count() == odd.count()
    for r in got.collect():
        gone = expected[r.doc_id, r.text]
        mask = [False] * r.nw
        for s in r.spans:
            mask[s["from"] : s["to"]] = [True] * (s["to"] - s["from"])
        assert (mask, r.nr) == (gone, sum(gone)), r.doc_id
        assert r.left == " ".join(w for w, g in zip(brute.words(r.text), gone) if not g)
    assert substring.deduplicated(none).count() == 0


def test_removed_words_random(spark):
    r = random.Random(7)
    texts = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(120)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for size in (2, 3, 7):
        expected = brute.removed(texts, size)
        for r_ in substring.deduplicated(d, size=size).collect():
            assert r_.n_removed == sum(expected[r_.doc_id, r_.text]), (size, r_.doc_id)


def _repeating(seed: int, n: int) -> list[str]:
    """Texts that share passages of all lengths up to 120 words."""
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(1, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            words += p[a : r.randint(a, len(p))] + [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        out.append(" ".join(words))
    return out + out[:5]


@pytest.mark.parametrize("size, shortest", [(2, 1), (3, 1), (7, 1), (20, 1), (20, 5), (50, 3), (50, 25)])
def test_removed_words_whatever_the_levels(spark, size, shortest):
    texts = list(enumerate(_repeating(size, 80)))
    expected = brute.removed(texts, size)
    got = substring.deduplicated(spark.createDataFrame(texts, "doc_id long, text string"), size=size, shortest=shortest)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {i: sum(expected[i, t]) for i, t in texts}
    assert any(map(sum, expected.values()))


def test_levels_double():
    assert substring.levels(20) == [5, 10] and substring.levels(50, 1) == [1, 3, 6, 12, 25] and substring.levels(2) == [1]


def test_removed_words_with_text_keys(spark):
    texts = [(f"k{i * 7919 % 97}", t) for i, t in enumerate(_repeating(3, 60))]
    expected = brute.removed(texts, 7)
    d = spark.createDataFrame(texts + [(None, texts[3][1])], "doc_id string, text string")
    got = substring.deduplicated(d, size=7)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "removed", "kept"]
    rows_ = got.collect()
    assert {r.doc_id: r.n_removed for r in rows_ if r.doc_id} == {i: sum(expected[i, t]) for i, t in texts}
    gone = [r for r in rows_ if r.doc_id is None]
    assert len(gone) == 1 and (gone[0].n_words < 7 or gone[0].n_removed == gone[0].n_words)


def test_text_without_removal_is_unchanged(docs):
    got = substring.deduplicated(docs, size=50)
    assert got.where("n_removed = 0 AND NOT (kept <=> text)").count() == 0


# 9 chat

def test_turns_come_back():
    r = random.Random(8)
    bits = ["</turn>", "<turn ", "\\", "\n", "user>", "a", "", ">", "\r", "é"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        turns = [chat.Turn(r.choice(["user", "a>%\n", ""]), t), chat.Turn("assistant", t)]
        parser = chat.Parser()
        assert list(parser.feed("".join(map(chat.render, turns)))) == turns and not parser.open


def test_chat_odd(spark):
    t = spark.createDataFrame(
        [(1, 0, "user", None, 1), (1, 1, "assistant", "</turn>", 1), (1, 1, "assistant", "b", 2), (None, None, None, "x", 3),
         (2, 5, "assistant", "y\n\\</turn>\n", 4), (2, 5, "assistant", "y\n\\</turn>\n", 4)],
        "conv_id long, turn long, role string, text string, rendered int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(t)).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == h("user\n\nassistant\n</turn>\nassistant\nb\n") and got[1].loss_sha256 == h("</turn>b")
    assert got[None].n_turns == 1 and got[None].loss_chars == 0 and got[2].loss_chars == 2 * len("y\n\\</turn>\n")
    assert chat.read_back(chat.formatted(t.limit(0))).count() == 0


# 10 ORC

def test_orc_round_trip(spark, odd, none):
    out = shared_path(spark, "orc-test")
    orc_tokens.write_tokens(odd, out, tokens.default_path(), 2, index_rows=1000)
    got = orc_tokens.with_start(orc_tokens.read_tokens(spark, out), out).orderBy("start").collect()
    lib = tokens.tokenizer(tokens.default_path()).lib
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    want = collections.Counter((k, tuple(lib.encode(t or "", add_special_tokens=False).ids + [2])) for k, t in raw(odd))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    one = orc_tokens.with_crc32(orc_tokens.read_tokens(spark, out, keys=[9])).collect()
    assert [r.doc_id for r in one] == [9]
    empty = shared_path(spark, "orc-test")
    orc_tokens.write_tokens(none, empty, tokens.default_path(), 2)
    assert spark.read.schema("doc_id long").orc(empty).count() == 0


# queries

def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_query_2_and_8_on_whole_tables(spark, docs):
    got = rows(QUERIES["op2_ngram_jaccard_join"](spark, SF), "doc_id", "n_shingles", "component_id")
    index, sets, parent = collections.defaultdict(list), {}, {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, t in raw(docs):
        sets[k], parent[k] = brute.shingles(brute.words(brute.lower(t)), 4), k
        for j, n in collections.Counter(j for s in sets[k] for j in index[s]).items():
            if 100 * n >= 85 * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((root(j), root(k)))
                parent[b] = a
        for s in sets[k]:
            index[s].append(k)
    assert got == sorted(((k, len(s), root(k)) for k, s in sets.items()), key=str)
    gone = brute.removed(raw(docs), 20)
    want = sorted(((k, len(g), sum(g), hashlib.sha256(" ".join(w for w, x in zip(brute.words(t), g) if not x).encode()).hexdigest())
                   for (k, t), g in gone.items()), key=str)
    assert rows(QUERIES["op8_substring_dedup"](spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == want
