"""Report scoring, question typing, SQL audit and text-vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import text as tx, vectors
from gaugeline.operators import sqlaudit, textscore as ts
from gaugeline.sources.catalog import columns_of, schema_drift
from gaugeline.sources.tables import load, load_spread
from registry.base import query

TEMPLATES = [
    "The treatment increased revenue, a statistically significant result (p < 0.03). Revenue reached ${p} and we should ship now.",
    "No significant change: the experiment declined by 3.5%. Large effect of {p}. Roll out, then re-run a larger experiment.",
    "Revenue is more than double: $120,000.50 versus ${p}. A positive correlation exists.",
    "Revenue was 3 times higher: ${p} vs 40,000 in 2023. Negligible effect, proceed.",
    "A strong positive correlation with a small effect of {p}%; investigate before launch.",
    "Only a weak correlation and a negative relationship near 0.05; do not ship. Treatment improved 12%.",
    "Triple growth from 10,500.5 to ${p}; launch it although a guardrail was breached. p < 0.01, significant.",
    "How the {p} total splits is unclear; the experiment group dropped. Not significant, extend the experiment.",
]


def reports(spark, sf_dir):
    """One written report per order, with the results it is checked against."""
    k, price = F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice")
    body = None
    for i, t in enumerate(TEMPLATES):
        head, tail = t.split("{p}", 1) if "{p}" in t else (t, "")
        piece = F.concat(F.lit(head), price, F.lit(tail)) if "{p}" in t else F.lit(t)
        body = F.when(k % 8 == i, piece) if body is None else body.when(k % 8 == i, piece)
    return load_spread(spark, sf_dir, "orders").select(
        k.alias("id"), "o_totalprice", "o_orderstatus", body.alias("text"), ((k % 13) / 100.0).alias("p_value"), ((k % 21) / 20.0 - 0.5).alias("cohens_d"),
        (k % 5 - 2.0).alias("ci_lower"), (k % 5 + 1.0).alias("ci_upper"), (k % 13 < 5).alias("significant"), ((k % 3) - 1.0).alias("cuped_ate"),
        (k % 10 == 0).alias("srm_detected"), (k % 4 == 0).alias("any_breached"), ((k % 10) / 10.0).alias("post_hoc_power"),
        ((k % 17) / 10.0 - 0.8).alias("max_r"), ((k % 17) / 10.0 - 0.9).alias("min_r"))


def _sql_text(t: str) -> str:
    t = t.replace("'", "''")
    if "{p}" not in t:
        return f"'{t}'"
    head, tail = t.split("{p}", 1)
    return f"'{head}' || format('{{:.2f}}', o_totalprice) || '{tail}'"


REPORTS_SQL = "rep AS (SELECT o_orderkey AS id, o_totalprice AS p, o_orderstatus, CASE o_orderkey % 8 " + " ".join(
    f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(TEMPLATES)) + """ END AS text, (o_orderkey % 13) / 100 AS p_value, (o_orderkey % 21) / 20 - 0.5 AS d,
 o_orderkey % 5 - 2 AS lo, o_orderkey % 5 + 1 AS hi, o_orderkey % 13 < 5 AS sig, o_orderkey % 3 - 1 AS ate, o_orderkey % 10 = 0 AS srm, o_orderkey % 4 = 0 AS br,
 (o_orderkey % 10) / 10 AS ph, (o_orderkey % 17) / 10 - 0.8 AS max_r, (o_orderkey % 17) / 10 - 0.9 AS min_r FROM orders)"""

# Expected magnitude violations straight from the templates' numbers; an amount that reads as a year is no number.
MAGNITUDE_SQL = """CASE WHEN id % 8 IN (2, 3) AND p >= 1900 AND p < 2100 THEN 0 ELSE CASE id % 8 WHEN 2 THEN (greatest(120000.5, p) / least(120000.5, p) <= 2)::INT
 WHEN 3 THEN (abs(greatest(40000, p) / least(40000, p) - 3) / 3 > 0.25)::INT
 WHEN 6 THEN (abs(greatest(10500.5, p) / 0.01 - 3) / 3 > 0.15)::INT ELSE 0 END END"""

_NUMBERS_SQL = r"""list_filter(list_transform(list_filter(list_transform(
  list_filter(regexp_extract_all({t}, '\$\s*[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?\s*%|\b[0-9]+\.[0-9]+\b'), lambda m: NOT regexp_matches(m, '\b(19|20)[0-9]{2}\b')),
  lambda m: regexp_replace(m, '[$%,\s]', '', 'g')), lambda r: contains(r, '.') OR try_cast(r AS DOUBLE) > 5), lambda r: try_cast(r AS DOUBLE)), lambda v: v IS NOT NULL)"""


def numbers_sql(column: str) -> str:
    return _NUMBERS_SQL.replace("{t}", column)


@query("cited_numbers", "G5 H1", f"""SELECT doc_id AS id, CAST(len(n) AS INTEGER) AS cited, list_sum(n) AS total FROM (SELECT doc_id, {numbers_sql('text')} AS n FROM documents)""",
       "", {"total": 3})
def cited_numbers(spark, sf_dir):
    docs = load_spread(spark, sf_dir, "documents").select("doc_id", tx.cited_numbers(F.col("text")).alias("n"))
    return docs.select(F.col("doc_id").alias("id"), F.size("n").alias("cited"),
                       F.when(F.size("n") > 0, F.aggregate("n", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query("faithfulness", "C8 H2", f"""WITH {REPORTS_SQL}, nums AS (SELECT id, unnest({numbers_sql('text')}) AS x FROM rep),
refs AS (SELECT l_orderkey AS id, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_orderkey, l_discount FROM lineitem),
hit AS (SELECT id, x, EXISTS (SELECT 1 FROM refs r WHERE r.id = nums.id AND (abs(x - v) / CASE WHEN abs(x) > 1e-9 THEN abs(x) ELSE 1 END <= 0.1
   OR (x > 0 AND x <= 100 AND abs(x / 100 - v) / (x / 100) <= 0.1))) AS ok FROM nums),
s AS (SELECT id, count(*) AS total, count(*) FILTER (ok) AS supported FROM hit GROUP BY id)
SELECT rep.id, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported,
 CASE WHEN coalesce(total, 0) = 0 THEN 1.0::DOUBLE WHEN rep.id IN (SELECT id FROM refs) THEN supported / total END AS faithfulness FROM rep LEFT JOIN s USING (id)""", "faithfulness")
def faithfulness(spark, sf_dir):
    values = F.explode(F.array("l_extendedprice", "l_discount"))
    refs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), values.alias("v"))
    return ts.faithfulness(reports(spark, sf_dir), refs, "id", "text", "v")


@query("faithfulness_shared_references", "C8 H2", f"""WITH nums AS (SELECT doc_id, unnest({numbers_sql('text')}) AS x FROM documents), refs AS (SELECT DISTINCT p_retailprice AS v FROM part UNION SELECT DISTINCT p_size FROM part),
hit AS (SELECT doc_id, x, EXISTS (SELECT 1 FROM refs WHERE abs(x - v) / CASE WHEN abs(x) > 1e-9 THEN abs(x) ELSE 1 END <= 0.1
   OR (x > 0 AND x <= 100 AND abs(x / 100 - v) / (x / 100) <= 0.1)) AS ok FROM nums),
s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (ok) AS supported FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported, CASE WHEN coalesce(total, 0) = 0 THEN 1.0::DOUBLE ELSE supported / total END AS faithfulness
FROM documents LEFT JOIN s USING (doc_id)""", "faithfulness")
def faithfulness_shared_references(spark, sf_dir):
    refs = load(spark, sf_dir, "part").select(F.explode(F.array("p_retailprice", F.col("p_size").cast("double"))).alias("v"))
    return ts.faithfulness(load_spread(spark, sf_dir, "documents"), refs, "doc_id", "text", "v", per_report=False)


_VIOLATION = "CASE WHEN {a} AND {v} THEN 1 ELSE 0 END"


def _rules_sql(rules: list[tuple[str, str]], magnitude: str | None) -> str:
    checks = " + ".join(f"coalesce(({a})::INT, 0)" for a, _ in rules)
    bad = " + ".join(f"coalesce(({a} AND {v})::INT, 0)" for a, v in rules)
    if magnitude:
        checks += f" + ({magnitude}) + (({magnitude}) > 0)::INT"
        bad += f" + ({magnitude})"
    return f"CAST({checks} AS INTEGER) AS checks, CAST({bad} AS INTEGER) AS n_violations"


def _score_sql(rules, magnitude, source="rep"):
    return f"""SELECT id, checks, n_violations, CASE WHEN checks > 0 THEN 1 - n_violations / checks ELSE 1.0::DOUBLE END AS score
FROM (SELECT id, {_rules_sql(rules, magnitude)} FROM {source})"""


def _m(p: str) -> str:
    return "regexp_matches(text, '(?i)" + p.replace("'", "''") + "')"


CLAIMS = [(_m(ts.SIGNIFICANT), "p_value >= 0.05"), (_m(ts.NOT_SIGNIFICANT), "p_value < 0.05"), (_m(ts.LARGE_EFFECT), "abs(d) <= 0.5"), ("sig", "lo < 0 AND hi > 0"),
          (_m(ts.SMALL_EFFECT), "abs(d) > 0.5"),
          (f"abs(ate) > 1e-6 AND ({_m(ts.TREATMENT_FELL)} OR {_m(ts.TREATMENT_ROSE)})",
           f"((ate > 0 AND {_m(ts.TREATMENT_FELL)} AND NOT {_m(ts.TREATMENT_ROSE)}) OR (ate < 0 AND {_m(ts.TREATMENT_ROSE)} AND NOT {_m(ts.TREATMENT_FELL)}))")]


def _shown(df):
    return df.select("id", "checks", F.size("violations").alias("n_violations"), "score")


@query("experiment_claims", "H6 H8", f"WITH {REPORTS_SQL} {_score_sql(CLAIMS, MAGNITUDE_SQL)}", "score")
def experiment_claims(spark, sf_dir):
    return _shown(ts.experiment_claims(reports(spark, sf_dir), "text"))


@query("magnitude_claims", "H8", f"WITH {REPORTS_SQL} SELECT id, CAST({MAGNITUDE_SQL} AS INTEGER) AS n FROM rep")
def magnitude_claims(spark, sf_dir):
    return reports(spark, sf_dir).select("id", ts.magnitude_violations(F.col("text")).alias("n"))


@query("magnitude_claims_in_documents", "H8", r"""WITH t AS (SELECT doc_id, substr('Twice as much, ' || text, 1, 200) AS near FROM documents),
m AS (SELECT doc_id, list_filter(regexp_extract_all(near, '\$\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*%|\b\d[\d,]*(?:\.\d+)?\b'), lambda x: NOT regexp_matches(x, '\b(19|20)\d{2}\b')) AS l FROM t),
n AS (SELECT doc_id, list_distinct(list_transform(list_filter(list_transform(l, lambda x: regexp_replace(x, '[$%,\s]', '', 'g')), lambda r: contains(r, '.') OR r::DOUBLE > 5), lambda r: r::DOUBLE)) AS l FROM m),
r AS (SELECT doc_id, len(l) AS c, list_max(l) / list_min(list_filter(l, lambda v: v > 0)) AS ratio FROM n)
SELECT doc_id, 1::INT AS n FROM r WHERE c >= 2 AND ratio <> 1 AND abs(ratio - 2) / 2 > 0.15""")
def magnitude_claims_in_documents(spark, sf_dir):
    docs = load_spread(spark, sf_dir, "documents")
    return docs.select("doc_id", ts.magnitude_violations(F.concat(F.lit("Twice as much, "), F.col("text"))).alias("n")).where("n > 0")


SAFETY = [("srm", f"{_m(ts.SHIP)} AND NOT {_m(ts.STOP)}"), ("br AND sig", f"{_m(ts.SHIP)} AND NOT {_m(ts.STOP)} AND NOT {_m(ts.GUARDRAIL_MENTION)}"),
          ("sig AND ph < 0.5", f"{_m(ts.SHIP)} AND NOT {_m(ts.CONFIRMATORY)}")]


@query("safety_rules", "H7", f"WITH {REPORTS_SQL} {_score_sql(SAFETY, None)}", "score")
def safety_rules(spark, sf_dir):
    return _shown(ts.safety_rules(reports(spark, sf_dir), "text"))


_STRONGEST = "greatest(abs(max_r), abs(min_r))"
CORRELATION = [(_m(ts.STRONG_CORRELATION), f"{_STRONGEST} < 0.5"), (_m(ts.NO_CORRELATION), f"{_STRONGEST} >= 0.3"),
               (_m(ts.POSITIVE_CORRELATION), "max_r <= 0"), (_m(ts.NEGATIVE_CORRELATION), "min_r >= 0")]


@query("correlation_claims", "H9", f"WITH {REPORTS_SQL} {_score_sql(CORRELATION, MAGNITUDE_SQL)}", "score")
def correlation_claims(spark, sf_dir):
    return _shown(ts.correlation_claims(reports(spark, sf_dir), "text"))


# Conversations: a user's turn is the question and the next turn is the answer.
PAIRS_SQL = """pr AS (SELECT q.conv_id * 1000 + q.turn AS id, q.conv_id, q.turn, q.text AS task, a.text AS answer FROM conversations q JOIN conversations a
 ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user')"""


def question_pairs(spark, sf_dir):
    turns = load_spread(spark, sf_dir, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("task"))
    return asked.join(answers, ["conv_id", "turn"]).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


_CANON = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in vectors.CANONICAL_TERMS.items()) + "}"
_STOP = ", ".join(f"'{w}'" for w in vectors.STOPWORDS)


def weights_sql(source: str, keys: str, text: str) -> str:
    """Raw bucket weights ``(keys, bucket, weight)`` of a text column, as a chain of named subqueries ``wt``."""
    return f"""tk AS (SELECT {keys}, list_transform(list_filter(list_transform(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'),
   lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN t[1:length(t) - 1] ELSE t END), lambda t: coalesce({_CANON}[t], t)),
   lambda t: t <> '' AND t NOT IN ({_STOP})), lambda t: 'tok:' || t) AS l FROM {source}),
 ft AS (SELECT {keys}, unnest(l) AS f, 2.0::DOUBLE AS w FROM tk UNION ALL
   SELECT {keys}, unnest(list_transform(generate_series(1, len(l) - 1), lambda i: 'bigram:' || l[i] || ':' || l[i + 1])), 1.0 FROM tk WHERE len(l) > 1),
 wt AS (SELECT {keys}, CAST(('0x' || substr(md5(f), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket, sum(w) AS weight FROM ft GROUP BY ALL)"""


@query("text_vectors", "G7 G12 J1", f"""WITH {weights_sql('conversations', 'conv_id, turn', 'text')}
SELECT conv_id, turn, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY conv_id, turn)) AS weight FROM wt""", "weight")
def text_vectors(spark, sf_dir):
    return vectors.embed(load_spread(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query("dense_vectors", "J1 G10", f"""WITH {weights_sql('conversations', 'conv_id, turn', 'text')}, n AS (SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS filled, max(weight) / sqrt(sum(weight * weight)) AS top FROM wt GROUP BY ALL)
SELECT conv_id, turn, 384 AS length, filled, 1.0::DOUBLE AS norm, top FROM n""", "", {"norm": 4, "top": 4})
def dense_vectors(spark, sf_dir):
    out = vectors.dense(vectors.embed(load_spread(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.size("vector").alias("length"), F.size(F.filter("vector", lambda v: v > 0)).cast("bigint").alias("filled"),
                      vectors.l2_norm(F.col("vector")).alias("norm"), F.array_max("vector").cast("double").alias("top"))


_RELEVANCY = f"""{PAIRS_SQL}, side AS (SELECT id, 0 AS s, task AS text FROM pr UNION ALL SELECT id, 1, answer FROM pr), {weights_sql('side', 'id, s', 'text')},
pb AS (SELECT id, bucket, coalesce(sum(weight) FILTER (s = 0), 0) AS a, coalesce(sum(weight) FILTER (s = 1), 0) AS b FROM wt GROUP BY ALL),
rel AS (SELECT id, CASE WHEN sum(a * a) * sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END AS relevancy FROM pb GROUP BY id)"""


@query("relevancy", "G10 H3", f"WITH {_RELEVANCY} SELECT * FROM rel", "relevancy")
def relevancy(spark, sf_dir):
    return vectors.pair_cosine(question_pairs(spark, sf_dir), "id", "task", "answer")


_FINDINGS = """kf AS (SELECT id, exp, CASE WHEN len(exp) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(exp, lambda w: contains(lower(answer), w))) / len(exp) END AS findings
 FROM (SELECT id, answer, list_distinct_ordered AS exp FROM (SELECT id, answer, list_filter(regexp_extract_all(lower(task), '[a-z0-9]+'), lambda t: length(t) >= 3) AS list_distinct_ordered FROM pr)))"""


@query("key_findings", "H4 U3", f"WITH {PAIRS_SQL}, {_FINDINGS} SELECT id, findings FROM kf", "findings")
def key_findings(spark, sf_dir):
    expected = F.filter(tx.word_tokens(F.col("task")), lambda t: F.length(t) >= 3)
    return question_pairs(spark, sf_dir).select("id", ts.key_findings(F.col("answer"), expected).alias("findings"))


@query("composite_quality", "H5 H10", f"""WITH {_RELEVANCY}, {_FINDINGS},
c AS (SELECT id, exp, findings, relevancy, CASE WHEN id % 3 > 0 THEN (id % 7) / 7 END AS faith FROM kf JOIN rel USING (id)),
s AS (SELECT *, (0.2 * findings + CASE WHEN faith IS NOT NULL THEN 0.5 * faith ELSE 0 END + 0.3 * relevancy) / (0.5 + CASE WHEN faith IS NOT NULL THEN 0.5 ELSE 0 END) AS score FROM c),
q AS (SELECT *, ((id % 2 = 0)::INT + 1 + (id % 5 = 0)::INT + 1 + 1) / 5 AS complete, CASE WHEN id % 4 = 0 THEN least(score, 0.6) ELSE score END AS capped FROM s)
SELECT id, score, 0.6 * complete + 0.4 * capped AS quality FROM q""", "score quality")
def composite_quality(spark, sf_dir):
    pairs = question_pairs(spark, sf_dir)
    expected = F.filter(tx.word_tokens(F.col("task")), lambda t: F.length(t) >= 3)
    i = F.col("id")
    scored = pairs.join(vectors.pair_cosine(pairs, "id", "task", "answer"), "id").select(
        "id", ts.composite(F.when(i % 3 > 0, (i % 7) / 7), F.col("relevancy"), ts.key_findings(F.col("answer"), expected), F.size(expected) > 0).alias("score"))
    complete = ts.completeness(F.lit("general"), {"describe": i % 2 == 0, "correlations": F.lit(True), "charts": i % 5 == 0, "narrative": F.lit(True), "result": F.lit(True)})
    return scored.select("id", "score", ts.quality(complete, F.col("score"), i % 4 == 0).alias("quality"))


@query("labelled_report_scores", "H1", f"""WITH nums AS (SELECT doc_id, len({numbers_sql('text')}) AS n FROM documents)
SELECT quality, toxic, count(*) AS reports, avg(n) AS mean_score FROM nums JOIN labels USING (doc_id) GROUP BY ALL""", "mean_score")
def labelled_report_scores(spark, sf_dir):
    cited = load_spread(spark, sf_dir, "documents").select("doc_id", F.size(tx.cited_numbers(F.col("text"))).cast("double").alias("score"))
    return ts.mean_score(cited.join(load(spark, sf_dir, "labels"), "doc_id"), ["quality", "toxic"])


_OPENINGS = ["How many users signed up", "What is the total value by platform", "List all events of", "Show me the total count of", "Why did value drop for",
             "count the purchases per number of", "Compare treatment vs control for", "What are the top 5 items in"]


@query("question_types", "H11", "WITH q AS (SELECT event_id, CASE user_id % 8 " + " ".join(f"WHEN {i} THEN '{o} '" for i, o in enumerate(_OPENINGS)) + f""" END || event_type AS question FROM events),
r AS (SELECT *, regexp_matches(question, '(?i){ts.LOOKUP_OPENING}') AS opens,
 regexp_replace(question, '(?i)\\b(by|per|across|between|split)\\s+(number|count|total|amount|volume|sum)\\b', '', 'g') AS rest FROM q)
SELECT question, CASE WHEN opens AND NOT regexp_matches(rest, '(?i){ts.ANALYSIS_WORDS.replace("(?!(number|count|total|amount|volume|sum)" + chr(92) + "b)", "")}') THEN 'lookup' ELSE 'exploratory' END AS type, count(*) AS n
FROM r GROUP BY ALL""")
def question_types(spark, sf_dir):
    u, opening = F.col("user_id") % 8, None
    for i, o in enumerate(_OPENINGS):
        opening = F.when(u == i, o + " ") if opening is None else opening.when(u == i, o + " ")
    asked = load(spark, sf_dir, "events").select(F.concat(opening, F.col("event_type")).alias("question"))
    return asked.select("question", ts.question_type(F.col("question")).alias("type")).groupBy("question", "type").agg(F.count(F.lit(1)).alias("n"))


STATEMENTS = [
    "SELECT e.value, e.user_id FROM events e JOIN orders o ON o.o_custkey = e.user_id WHERE e.event_type = '{t}'",
    "WITH top AS (SELECT user_id FROM events) SELECT t.user_id FROM top t JOIN missing_table m ON m.x1 = t.user_id",
    "DELETE FROM events WHERE event_type = '{t}'",
    "SELECT 'DROP-off; it''s {t}' AS label FROM events -- note; done",
    "SELECT e.bogus, e.value FROM events AS e; SELECT 1",
    "SELECT * FROM read_csv('{t}.csv')",
    "/* block; {t} */ SELECT c.c_name, c.c_phone FROM customer c;",
    "  ",
]
AUDIT_TABLES = ("events", "orders", "customer")


def sql_log(spark, sf_dir):
    u, body = F.col("user_id") % 8, None
    for i, s in enumerate(STATEMENTS):
        text = F.replace(F.lit(s), F.lit("{t}"), F.col("event_type"))
        body = F.when(u == i, text) if body is None else body.when(u == i, text)
    return load(spark, sf_dir, "events").select("event_id", body.alias("sql"))


_LOG_SQL = "lg AS (SELECT event_id, user_id % 8 AS k, CASE user_id % 8 " + " ".join(
    "WHEN {} THEN replace('{}', '{{t}}', event_type)".format(i, s.replace("'", "''")) for i, s in enumerate(STATEMENTS)) + " END AS sql FROM events)"


def audit_catalog(spark, sf_dir):
    return columns_of({t: load(spark, sf_dir, t) for t in AUDIT_TABLES})


_CATALOG_SQL = """cat AS (SELECT * FROM (VALUES ('events', 'event_id'), ('events', 'ts'), ('events', 'user_id'), ('events', 'event_type'), ('events', 'value'), ('events', 'props'),
 ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'), ('orders', 'o_orderpriority'),
 ('customer', 'c_custkey'), ('customer', 'c_name'), ('customer', 'c_nationkey'), ('customer', 'c_acctbal'), ('customer', 'c_mktsegment')) v("table", "column"))"""


@query("sql_lint", "H12", f"""WITH {_LOG_SQL} SELECT sql, CASE k WHEN 2 THEN 'not a query' WHEN 4 THEN 'more than one statement' WHEN 5 THEN 'file read' WHEN 7 THEN 'empty' ELSE 'ok' END AS verdict, count(*) AS n FROM lg GROUP BY ALL""")
def sql_lint(spark, sf_dir):
    return sql_log(spark, sf_dir).select("sql", sqlaudit.lint(F.col("sql")).alias("verdict")).groupBy("sql", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("sql_checkable_text", "H12", fr"""WITH {_LOG_SQL} SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(sql, '''(?:[^'']|'''')*''', '''''', 'g'), '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g') AS bare FROM lg""")
def sql_checkable_text(spark, sf_dir):
    return sql_log(spark, sf_dir).select(sqlaudit.checkable(F.col("sql")).alias("bare")).distinct()


@query("sql_unknown_tables", "C10", f"""WITH {_LOG_SQL}, {_CATALOG_SQL}, r AS (SELECT DISTINCT event_id, lower(unnest(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN)\\s+([\\w.]+)', 1))) AS "table", lower(sql) AS s FROM lg)
SELECT event_id, "table" FROM r WHERE length("table") > 2 AND "table" NOT IN (SELECT "table" FROM cat) AND NOT contains(s, 'with ' || "table" || ' as')""")
def sql_unknown_tables(spark, sf_dir):
    return sqlaudit.unknown_tables(sql_log(spark, sf_dir), "event_id", "sql", audit_catalog(spark, sf_dir))


@query("sql_unknown_columns", "C11", f"""WITH {_LOG_SQL} SELECT event_id, 'e' AS alias, 'bogus' AS "column", 'events' AS "table" FROM lg WHERE k = 4
UNION ALL SELECT event_id, 'c', 'c_phone', 'customer' FROM lg WHERE k = 6""")
def sql_unknown_columns(spark, sf_dir):
    return sqlaudit.unknown_columns(sql_log(spark, sf_dir), "event_id", "sql", audit_catalog(spark, sf_dir))


@query("sql_outside_allowed", "C14", f"""WITH {_LOG_SQL} SELECT event_id, t AS "table" FROM lg JOIN (VALUES (0, 'orders'), (1, 'missing_table'), (5, 'read_csv'), (6, 'customer')) v(kk, t) ON k = kk""")
def sql_outside_allowed(spark, sf_dir):
    allowed = audit_catalog(spark, sf_dir).where("table = 'events'")
    return sqlaudit.outside_allowed(sql_log(spark, sf_dir), "event_id", "sql", allowed)


@query("sql_usable_examples", "C12 G11 U3", f"""WITH {_LOG_SQL} SELECT event_id FROM lg WHERE k IN (2, 3, 4, 7)""")
def sql_usable_examples(spark, sf_dir):
    return sqlaudit.usable_examples(sql_log(spark, sf_dir), "sql", ["events"]).select("event_id")


@query("schema_drift", "C13", f"""WITH {_CATALOG_SQL}, want AS (SELECT DISTINCT lower(event_type) AS "table", NULL AS "column" FROM events UNION ALL SELECT 'events', 'user_id' UNION ALL SELECT 'events', 'platform' UNION ALL SELECT 'orders', 'c_name'),
nt AS (SELECT DISTINCT "table" FROM want WHERE "table" NOT IN (SELECT "table" FROM cat))
SELECT "table", '' AS "column", 'missing table' AS finding FROM nt UNION ALL
SELECT "table", "column", 'missing column' FROM want WHERE "column" IS NOT NULL AND "table" NOT IN (SELECT "table" FROM nt) AND "column" NOT IN (SELECT "column" FROM cat)""")
def drift(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    tables = ev.select(F.col("event_type").alias("table"), F.lit(None).cast("string").alias("column")).distinct()
    fixed = spark.createDataFrame([("events", "user_id"), ("events", "platform"), ("orders", "c_name")], "table string, column string")
    return schema_drift(tables.unionByName(fixed), audit_catalog(spark, sf_dir))


@query("keyword_overlap", "G6 G11 U3", """SELECT conv_id, turn, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CAST(len(a) AS INTEGER) AS size_a FROM (SELECT q.conv_id, q.turn,
 list_distinct(list_filter(regexp_extract_all(lower(q.text), '[a-z0-9]+'), lambda t: length(t) >= 3)) AS a, list_distinct(list_filter(regexp_extract_all(lower(n.text), '[a-z0-9]+'), lambda t: length(t) >= 3)) AS b
 FROM conversations q JOIN conversations n ON n.conv_id = q.conv_id AND n.turn = q.turn + 1 WHERE q.role = 'user')""")
def keyword_overlap(spark, sf_dir):
    a, b = tx.keyword_set(F.col("task")), tx.keyword_set(F.col("answer"))
    return question_pairs(spark, sf_dir).select("conv_id", "turn", tx.overlap_size(a, b).alias("shared"), F.size(a).alias("size_a"))
