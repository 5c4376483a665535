"""Ready queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.llm import divergence, fingerprint, html, importance, lines, mixing, neighbours, packing, similarity, suffixes, surrogates, toxicity, urls
from gaugeline.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(load(spark, sf_dir, "documents")).select("row.doc_id", "text", "n_entities", "n_distinct")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(load(spark, sf_dir, "documents"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(load(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_lines(load(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(load(spark, sf_dir, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(load(spark, sf_dir, "documents"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(load(spark, sf_dir, "pages"))


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(load(spark, sf_dir, "pages"), rules).select("row.page_id", "host", "path", "rule", "verdict")


SQL["op13_url_filters"] = """WITH rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (SELECT page_id, row_number() OVER () AS r,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fits AS (SELECT r, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule, arg_max(rverdict, length(rhost) * 100000 + length(rpath)) AS rverdict
  FROM parts JOIN rules ON ('.' || host) LIKE '%.' || rhost AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


# crc32 of each different feature, a byte at a time with the table of remainders
SQL["op12_importance_resampling"] = """WITH RECURSIVE step(c, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT c, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY c) AS t FROM step WHERE k = 8),
texts AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
words AS (SELECT kind, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (SELECT kind, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
  || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS feature FROM words),
counted AS (SELECT kind, r, feature, count(*) AS n FROM runs GROUP BY ALL),
spelled AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)),
hashed AS (SELECT feature, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM spelled, crc_table),
found AS (SELECT kind, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
totals AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM found GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM totals) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM totals) + 10000)::DOUBLE))) AS BIGINT) AS g FROM totals),
weighed AS (SELECT r, sum(n) AS n_features, sum(n * g) AS weight FROM found JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (r) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= k THEN place END AS rank FROM placed"""


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = """WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
used AS (SELECT r, lang, source, unnest(w) AS term FROM texts),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM used GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM used SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(counts.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10"""
