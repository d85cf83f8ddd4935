"""Checked queries of the training-data operators, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hardneg, langid, mixing, ngram_lm, packing, pii, quality, runs, secrets, simhash, topk, urlfilter
from .textkit import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def byte_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.Vocabulary(spark, byte_ranks()), kind="digest")


@_query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.find(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def id_remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@_query
def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.score(docs, id_remainder(7) == 2)


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_fingerprint_text(simhash.cluster(table(spark, sf_dir, "documents")))


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = quality.judge(table(spark, sf_dir, "documents"))
    return verdict.select("doc_id", *quality.STATS, "base_failed", "n_removed", "kept")


#: The same counts and verdict: words and lines by expressions, windows and lines grouped by row.
ORACLES["op5_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
spots AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
wins AS (SELECT rid, i, w[i:i+4] AS win FROM spots),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
ls AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS nr FROM d),
lw AS (SELECT rid, source, line, nr, regexp_extract_all(line, '[^ 	-
]+') AS w FROM ls),
norm AS (
  SELECT rid, source, line, nr, len(w) AS words,
         md5(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM lw WHERE len(w) > 0),
dup AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM norm GROUP BY ALL) GROUP BY rid),
txt AS (SELECT rid, any_value(source) AS source, md5(string_agg(h, '' ORDER BY nr)) AS c FROM norm GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT c) AS documents FROM txt GROUP BY source),
freq AS (SELECT n.source, n.h, count(DISTINCT t.c) AS docs FROM norm n JOIN txt t USING (rid) GROUP BY n.source, n.h),
wide AS (SELECT f.source, f.h FROM freq f JOIN hosts o ON f.source IS NOT DISTINCT FROM o.source
         WHERE f.docs > 10 AND f.docs > 10 * greatest(1, log2(o.documents / 100))),
gone AS (SELECT n.rid, sum(n.words) AS n FROM norm n JOIN wide x ON n.source IS NOT DISTINCT FROM x.source AND n.h = x.h GROUP BY n.rid),
r AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n_removed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed >= 10
        AND n_words - n_removed >= n_words * CAST(0.2 AS DOUBLE)) AS kept
FROM r"""


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(table(spark, sf_dir, "documents"), F.xxhash64("text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model, held_out.alias("held_out"))


@_query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(pii.find(table(spark, sf_dir, "documents")), pii.KINDS)


@_query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLES["op9_topk"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of byte-pair ids; the two ids after the vocabulary's are a document's end and the padding."""
    import public_tokenizers

    ids = packing.token_ids(table(spark, sf_dir, "documents"), byte_ranks(), public_tokenizers.PATTERN)
    return packing.pack_ids(ids, 50256, 50257)


@_query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.when(h % 10 == 0, F.floor(h / 10))
    return runs.run_digest(runs.collapse(table(spark, sf_dir, "documents"), seed))


#: Fixed values of op12: rules on host and path; words whose hosts' URLs are listed.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED_WORDS = ("casino", "pills", "bets", "ads-track")


@_query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of all pages whose host holds one of the listed words."""
    pages = table(spark, sf_dir, "pages")
    host = urlfilter.host_of(F.col("url"))
    listed = pages.where(F.greatest(*(F.instr(host, w) for w in LISTED_WORDS)) > 0).select(urlfilter.canonical(F.col("url")))
    return urlfilter.judge(pages, listed, URL_RULES).drop("canonical", "listed")


ORACLES["op12_url_filter"] = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('ref', 'gclid', 'fbclid'))), '&') AS q
  FROM a),
k AS (
  SELECT page_id, host, path, CASE WHEN host IN ('', 'www.') THEN NULL ELSE
         (CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END) || rtrim(path, '/') || (CASE WHEN q <> '' THEN '?' || q ELSE '' END) END AS canonical,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p),
listed AS (SELECT DISTINCT canonical FROM k WHERE canonical IS NOT NULL AND (instr(host, 'casino') > 0 OR instr(host, 'pills') > 0 OR instr(host, 'bets') > 0 OR instr(host, 'ads-track') > 0))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN listed l ON k.canonical = l.canonical"""


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0)


ORACLES["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
a AS (SELECT DISTINCT vec_id, label, x FROM e WHERE vec_id % 50 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM a JOIN e c ON c.vec_id <> a.vec_id OR c.label <> a.label),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE label = anchor_label QUALIFY place <= 5),
m AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3"""
