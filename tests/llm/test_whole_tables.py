"""Registered queries over the whole small tables, with their own parameters, against plain Python."""

import collections
import zlib

import brute
import numpy as np
import pytest

from cellshift.llm import tokens
from cellshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    lib = tokens.tokenizer(tokens.default_path()).lib
    return {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_op1_packs_every_id_into_the_fewest_sequences_of_best_fit(spark, ids):
    got = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    expected = collections.Counter()
    for k, v in ids.items():
        whole = [*v, 0]
        for i, a in enumerate(range(0, len(whole), 2048)):
            part = whole[a : a + 2048]
            expected[k, i, a, len(part), crc(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(held) == brute.best_fit_bins([r.length for r in got], 2048)


def test_op3_tells_held_out_languages(spark, texts):
    got = QUERIES["op3_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r.doc_id: r.held_out for r in got} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in texts}
    seen = [r for r in got if r.held_out and lang[r.doc_id] and any(c.isalpha() for c in texts[r.doc_id] or "")]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in seen]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in got)


def test_op5_measures_and_base_rule(spark, texts):
    got = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, lines, repeats = brute.measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)


def test_op6_shards_by_rows(spark, texts):
    got = QUERIES["op6_feistel_sharding"](spark, SF).collect()
    raw = {k: (t or "").encode() for k, t in texts.items()}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {
        k: (len(b) + 16, zlib.crc32(b), "rows", None) for k, b in raw.items()}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    again = QUERIES["op6_feistel_sharding"](spark, SF).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_op10_files_hold_every_id_in_order(spark, ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_orc_tokens"](spark, SF).collect()}
    at, expected = 0, {}
    for k in sorted(ids):
        whole = [*ids[k], 2]
        expected[k] = (at, len(whole), crc(whole))
        at += len(whole)
    assert got == expected
