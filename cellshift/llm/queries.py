"""Queries of the operators over the given tables, and the SQL that checks them where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, collocations, concat, decontam, langid, ngram_join, orc_tokens, packing, quality, sharding, substring, tokens, url_filter, whitening,
)
from .store import shared_path, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), 2048, tokens.default_path(), end_id=0)
    return packing.pack(stored(pieces, "pieces"), 2048, ["doc_id", "piece", "start", "ids_crc32"])


@query
def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "orc")
    orc_tokens.write_tokens(_table(spark, sf_dir, "documents"), out, tokens.default_path(), end_id=2)
    return orc_tokens.with_start(orc_tokens.with_crc32(orc_tokens.read_tokens(spark, out)), out)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = stored(quality.measures(docs, "text", "q").drop("text"), "quality")
    judged = quality.judge(measured, "q", quality.fit(measured, "q"), "probability", "kept")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(f"q.{c}" for c in base), quality.base_failed("q").alias("base_failed"), "kept", "probability")


@query
def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.feistel_shards(stored(rows, "sizes"), 40, seed=20)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = "VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')"


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS t(rule, verdict)")
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLES["op4_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules AS (
  SELECT rule, verdict, regexp_extract(rule, '^[^/]*') AS h, regexp_extract(rule, '/.*$') AS p
  FROM ({URL_RULES}) AS t(rule, verdict)
), hit AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (n)
"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = shared_path(spark, "chat")
    chat.formatted(turns).write.parquet(out)
    return chat.read_back(spark.read.parquet(out))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(fold != 2).select("text", "lang"))
    return langid.predict(
        docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substring.deduplicated(docs, size=20, joined=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), size=4, percent=85).drop("text_hash")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, top=2000)


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened_components(_table(spark, sf_dir, "embeddings"), "embedding", 32)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = concat.token_runs(_table(spark, sf_dir, "documents"), tokens.default_path(), end_id=2)
    return concat.cut(stored(runs, "runs"), 4096)


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES["op2_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = t.doc_id) AS component_id
FROM documents t LEFT JOIN n USING (doc_id)
"""

ORACLES["op7_decontamination"] = r"""
WITH t AS (
  SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM t
), s AS (
  SELECT DISTINCT k, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE k = 'b' GROUP BY id)
SELECT d.id AS doc_id, item_id, count(*) AS n_shared, n_shingles FROM s d JOIN s b ON d.k = 'd' AND b.k = 'b' AND d.g = b.g
JOIN n ON item_id = b.id GROUP BY d.id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

ORACLES["op8_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)
), f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g
), x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE again
), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM p ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES["op9_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (SELECT unnest([0, 1]) AS i)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + length('<turn >' || '</turn>') + 3
    + len(regexp_extract_all(chr(10) || text, '\n\\*(?:<turn |</turn>)')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES["op11_phrase_collocations"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS t FROM documents
), p AS (SELECT i, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))
), f AS MATERIALIZED (SELECT lang, g, any_value(m) AS m, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100
), c AS (SELECT lang, g, m, f AS a, string_split(g, ' ') AS x FROM f WHERE m > 1
), inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(c.x[i:i + k - 1], ' ') AS g, c.a AS f
  FROM (SELECT lang, x, m, a, k, unnest(range(1, m - k + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS k) WHERE k < m) AS c
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.g = c.g AND i.f >= c.a)
), cut AS (
  SELECT kept.lang, kept.g, a, k, p.f AS l, q.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) AS kept JOIN n USING (lang)
  JOIN f p ON p.lang = kept.lang AND p.g = array_to_string(x[1:k], ' ')
  JOIN f q ON q.lang = kept.lang AND q.g = array_to_string(x[k + 1:], ' ')
), least AS (
  SELECT lang, g AS phrase, a, l, r, n, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= 2000
"""
