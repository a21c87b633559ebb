"""The registered queries of the text operators, over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.llm import chat_format, exact_topk, fingerprints, kneser_ney, language_id, lexical_rank, license_scan, mixing, ngram_join, piece_tokens, toxicity, url_filters, whitening
from cindergrid.llm.common import crc_mod, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 1
    scored = kneser_ney.perplexity_table(docs, ~held, order=3)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.Toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    scored = model.score(docs)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


#: Rules as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render_conversations(table(spark, sf_dir, "conversations"))


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 for documents labelled good, a half for bad ones."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return known.select("doc_id", F.when(F.col("good") == 1, 2.0).when(F.col("good") == 0, 0.5).alias("quality"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, label_quality(table(spark, sf_dir, "labels")), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    net = language_id.fit(docs.select("doc_id", "text", "lang"), ~held)
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_tokens.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=16, scale=64.0, shift=1_000_000)


def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_lm_score, op2_ngram_jaccard, op3_toxicity, op4_exact_topk, op5_url_filters, op6_fingerprints, op7_chat_format, op8_mix_sources, op9_language_id, op10_sentencepiece, op11_whitening, op12_lexical_rank, op13_license_scan]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP4_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
b AS (
  SELECT *, host = 'example.com' OR ends_with(host, '.example.com') AS ex, host = 'www.example.com' OR ends_with(host, '.www.example.com') AS wx,
    host = 'com' OR ends_with(host, '.com') AS c, host = 'net' OR ends_with(host, '.net') AS n FROM h),
r AS (
  SELECT page_id, host, path, CASE
    WHEN wx AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ex AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN n AND starts_with(path, '/es/') THEN 'net/es/' WHEN n AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN c AND starts_with(path, '/') THEN 'com/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS turns,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
  FROM t GROUP BY conv_id),
u AS (SELECT turns, n_turns, any_value(chat) AS chat, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n_turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM c, LATERAL (SELECT unnest(range(1, n_turns)) AS k))
SELECT conv_id, n_turns, copies, chat FROM u WHERE turns NOT IN (SELECT turns FROM p)
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
n AS (SELECT r, CAST(count(*) AS BIGINT) AS n FROM occ GROUP BY r),
t AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
post AS (SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM occ GROUP BY r, doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
items AS (
  SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ask AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM ask JOIN post USING (term) JOIN df USING (term) JOIN n USING (r) CROSS JOIN t GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

ORACLE_SQL = {"op4_exact_topk": OP4_SQL, "op5_url_filters": OP5_SQL, "op7_chat_format": OP7_SQL, "op12_lexical_rank": OP12_SQL}
