"""Similarity, retrieval, curation, retention, spend, rate and ingestion queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeline.functions import times
from gaugeline.operators import explore, history, limiter, spend
from gaugeline.session import checkpoint_dir
from gaugeline.sources import catalog, files, profiles, runlog
from gaugeline.sources.tables import load, load_spread
from gaugeline.streaming import counters, limiter as streaming_limiter
from registry.base import query
from registry.text import weights_sql


def runs(spark, sf_dir):
    """User turns stand in for past runs."""
    c, t = F.col("conv_id"), F.col("turn")
    r = c * 1000 + t
    return load_spread(spark, sf_dir, "conversations").where("role = 'user'").select(
        r.alias("run_id"), F.timestamp_seconds(F.lit(1704067200) + (c * 7919 + t * 104729) % 2592000).alias("ts"), F.col("text").alias("task"),
        F.concat(F.lit("u"), c % 20).alias("user_id"), F.concat(F.lit("w"), c % 5).alias("workspace_id"),
        F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("p"), c % 3)).alias("metric_pack_id"), F.concat(F.lit("c"), c % 3).alias("connection_id"),
        ((r % 11) / 10.0).alias("eval_score"), (r % 4 != 0).alias("audit_passed"), F.concat(F.lit("metric "), t).alias("metric"),
        F.concat(F.lit("segment "), c % 7).alias("top_segment"), F.when(r % 5 == 0, " ").otherwise(F.concat(F.lit("SELECT  "), t % 3, F.lit(" FROM runs"))).alias("sql"),
        F.when(r % 3 == 0, "contributed").otherwise("gate").alias("source"), F.concat(F.lit("h"), c % 2).alias("schema_hash"),
        F.concat(F.lit('{"alpha": 0.0'), t % 10, F.lit("}")).alias("analyst_override"))


RUNS_SQL = """rn AS (SELECT conv_id * 1000 + turn AS run_id, TIMESTAMP '2024-01-01' + to_seconds((conv_id * 7919 + turn * 104729) % 2592000) AS ts, text AS task,
 'u' || conv_id % 20 AS user_id, 'w' || conv_id % 5 AS workspace_id, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'p' || conv_id % 3 END AS metric_pack_id, 'c' || conv_id % 3 AS connection_id,
 ((conv_id * 1000 + turn) % 11) / 10 AS eval_score, (conv_id * 1000 + turn) % 4 <> 0 AS audit_passed, 'metric ' || turn AS metric, 'segment ' || conv_id % 7 AS top_segment,
 CASE WHEN (conv_id * 1000 + turn) % 5 = 0 THEN ' ' ELSE 'SELECT  ' || turn % 3 || ' FROM runs' END AS sql, CASE WHEN (conv_id * 1000 + turn) % 3 = 0 THEN 'contributed' ELSE 'gate' END AS source,
 'h' || conv_id % 2 AS schema_hash FROM conversations WHERE role = 'user')"""


def questions(spark, sf_dir):
    """New questions: the runs' texts, every second one without its first word, asked from a neighbouring pack and connection."""
    i = F.col("run_id")
    number = F.substring("user_id", 2, 9).cast("int")
    return runs(spark, sf_dir).select(
        i.alias("question_id"), "user_id", "workspace_id", F.when(i % 2 == 0, F.regexp_replace("task", r"^\S+\s+", "")).otherwise(F.col("task")).alias("task"),
        F.concat(F.lit("p"), number % 3).alias("metric_pack_id"), F.concat(F.lit("c"), (number + 1) % 3).alias("connection_id"), F.concat(F.lit("h"), number % 2).alias("schema_hash"))


QUESTIONS_SQL = """qs AS (SELECT run_id AS question_id, user_id, workspace_id, CASE WHEN run_id % 2 = 0 THEN regexp_replace(task, '^\\S+\\s+', '') ELSE task END AS task,
 'p' || substr(user_id, 2)::INT % 3 AS metric_pack_id, 'c' || (substr(user_id, 2)::INT + 1) % 3 AS connection_id, 'h' || substr(user_id, 2)::INT % 2 AS schema_hash FROM rn)"""

_BOTH = "bo AS (SELECT 0 AS side, question_id AS id, task FROM qs UNION ALL SELECT 1, run_id, task FROM rn)"
_VECTORS = f"""{RUNS_SQL}, {QUESTIONS_SQL}, {_BOTH}, {weights_sql('bo', 'side, id', 'task')},
vc AS (SELECT side, id, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY side, id)) AS weight FROM wt)"""
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) >= 3))"
_BOOST = """(CASE WHEN r.metric_pack_id = q.metric_pack_id THEN 2.0 WHEN r.metric_pack_id <> '' THEN -1.5 ELSE 0 END + CASE WHEN r.connection_id = q.connection_id THEN 1.0 ELSE -1.0 END)"""


@query("similar_runs", "C9 J2 G10", f"""WITH {_VECTORS},
pairs AS (SELECT q.question_id, r.run_id, r.ts, sum(a.weight * b.weight) AS sim FROM qs q JOIN rn r USING (user_id) JOIN vc a ON a.side = 0 AND a.id = q.question_id
  JOIN vc b ON b.side = 1 AND b.id = r.run_id AND b.bucket = a.bucket GROUP BY ALL),
best AS (SELECT *, round(sim, 7) AS s, row_number() OVER (PARTITION BY question_id ORDER BY round(sim, 7) DESC, ts DESC, run_id DESC) AS rnk FROM pairs WHERE round(sim, 7) >= 0.8)
SELECT question_id, run_id AS matched_run, s AS similarity, CASE WHEN s >= 0.92 THEN 'hard' ELSE 'soft' END AS hit_type FROM best WHERE rnk = 1""", "", {"similarity": 7})
def similar_runs(spark, sf_dir):
    return history.similar_runs(questions(spark, sf_dir), runs(spark, sf_dir), ["user_id"], "question_id", "run_id")


@query("class_neighbours", "C9 G10 J2", """WITH p AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL),
s AS (SELECT p.label, vec_id, round(sum(x::DOUBLE * m) / sqrt(sum(x::DOUBLE * x) * sum(m * m)), 7) AS similarity FROM p JOIN c ON c.label = p.label AND c.i = p.i GROUP BY ALL)
SELECT label, arg_max(vec_id, similarity) AS nearest, max(similarity) AS similarity FROM s GROUP BY label""", "similarity")
def class_neighbours(spark, sf_dir):
    stored = load(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    centres = history.class_centres(stored, "label", "vector").withColumn("asked", F.col("label"))
    out = history.closest_vectors(centres, stored, ["label"], "asked", "vec_id")
    return out.withColumnRenamed("asked", "label")


@query("relevant_history", "J3 G6", f"""WITH {RUNS_SQL}, {QUESTIONS_SQL},
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run_id DESC) AS k FROM rn WHERE audit_passed) WHERE k <= 80),
s AS (SELECT q.question_id, r.run_id, r.ts, CAST(len(list_intersect({_TOK.format('q.task')}, {_TOK.format("r.task || ' ' || r.top_segment || ' ' || r.metric")})) AS INTEGER) AS overlap,
   CASE WHEN r.eval_score <> 0 THEN r.eval_score ELSE 0.5 END AS quality, {_BOOST} AS boost FROM qs q JOIN recent r USING (user_id)),
t AS (SELECT *, overlap * 0.7::DOUBLE + quality * 0.3::DOUBLE + boost AS score FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, ts DESC, run_id DESC) AS rank FROM t)
SELECT question_id, run_id, overlap, score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 3 AND overlap > 0""", "score")
def relevant_history(spark, sf_dir):
    return history.relevant_history(questions(spark, sf_dir), runs(spark, sf_dir))


@query("example_statements", "J4", f"""WITH {_VECTORS},
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run_id DESC) AS k FROM rn WHERE sql IS NOT NULL) WHERE k <= 200 AND trim(sql) <> ''),
s AS (SELECT q.question_id, r.run_id, r.ts, round(coalesce((SELECT sum(a.weight * b.weight) FROM vc a JOIN vc b ON a.bucket = b.bucket WHERE a.side = 0 AND b.side = 1 AND a.id = q.question_id AND b.id = r.run_id), 0)
  + 0.05 * {_BOOST}, 7) AS similarity FROM qs q JOIN recent r USING (user_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, ts DESC, run_id DESC) AS rank FROM s WHERE similarity >= 0.40)
SELECT question_id, run_id AS example_id, similarity, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 2""", "", {"similarity": 7})
def example_statements(spark, sf_dir):
    return history.example_statements(questions(spark, sf_dir), runs(spark, sf_dir))


def pairs(spark, sf_dir):
    return runs(spark, sf_dir).select(F.col("run_id").alias("vq_id"), F.col("ts").alias("created_at"), "task", "sql", "source", "user_id", "workspace_id", "connection_id", "schema_hash")


@query("verified_statements", "J5 J6", f"""WITH {_VECTORS},
seen AS (SELECT question_id, run_id FROM qs q JOIN rn r ON r.user_id = q.user_id OR r.workspace_id = q.workspace_id),
nw AS (SELECT * FROM (SELECT s.question_id, r.*, row_number() OVER (PARTITION BY s.question_id ORDER BY r.ts DESC, r.run_id DESC) AS k FROM seen s JOIN rn r USING (run_id)) WHERE k <= 200),
sm AS (SELECT n.question_id, n.run_id, sum(a.weight * b.weight) AS d FROM nw n JOIN vc a ON a.side = 0 AND a.id = n.question_id JOIN vc b ON b.side = 1 AND b.id = n.run_id AND a.bucket = b.bucket GROUP BY ALL),
s AS (SELECT n.question_id, n.run_id, n.ts, round(coalesce(d, 0) + CASE n.source WHEN 'contributed' THEN 0.10 ELSE 0.05 END + CASE WHEN q.connection_id = n.connection_id THEN 0.05 ELSE 0 END
   - CASE WHEN q.schema_hash <> n.schema_hash THEN 0.15 ELSE 0 END, 7) AS similarity FROM nw n JOIN qs q USING (question_id) LEFT JOIN sm USING (question_id, run_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, ts DESC, run_id DESC) AS rank FROM s WHERE similarity >= 0.40)
SELECT question_id, run_id AS example_id, similarity, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 2""", "", {"similarity": 7})
def verified_statements(spark, sf_dir):
    return history.verified_statements(questions(spark, sf_dir), pairs(spark, sf_dir))


@query("merged_examples", "U2", f"""WITH {RUNS_SQL}, a AS (SELECT user_id, sql, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run_id DESC) AS rank, CASE WHEN source = 'contributed' THEN 0 ELSE 1 END AS src FROM rn),
k AS (SELECT user_id, trim(regexp_replace(lower(sql), '\\s+', ' ', 'g')) AS key, src, rank, sql FROM a WHERE trim(sql) <> ''),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY src, rank) AS d FROM k) WHERE d = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src, rank) AS position FROM f)
SELECT user_id, CAST(position AS INTEGER) AS position, CAST(src AS INTEGER) AS source_order, sql FROM o WHERE position <= 3""")
def merged_examples(spark, sf_dir):
    from pyspark.sql import Window as W
    order = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    ranked = runs(spark, sf_dir).select("user_id", "sql", "source", F.row_number().over(order).alias("rank"))
    return history.merged_examples(ranked.where("source = 'contributed'").drop("source"), ranked.where("source = 'gate'").drop("source"), ["user_id"])


@query("gate_upsert", "E5", f"""WITH {RUNS_SQL}, p AS (SELECT run_id AS vq_id, ts, source, user_id, 'question ' || run_id % 7 AS task, connection_id FROM rn)
SELECT vq_id, source FROM p WHERE source <> 'gate' UNION ALL
SELECT vq_id, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, task, connection_id ORDER BY ts DESC, vq_id DESC) AS k FROM p WHERE source = 'gate') WHERE k = 1""")
def gate_upsert(spark, sf_dir):
    named = pairs(spark, sf_dir).withColumn("task", F.concat(F.lit("question "), F.col("vq_id") % 7))
    return history.replace_gate_rows(named).select("vq_id", "source")


@query("contribution_cap", "E6", f"""WITH {RUNS_SQL} SELECT run_id AS vq_id, row_number() OVER (PARTITION BY workspace_id ORDER BY ts, run_id) <= 20 AS accepted FROM rn WHERE source = 'contributed'""")
def contribution_cap(spark, sf_dir):
    contributed = pairs(spark, sf_dir).where("source = 'contributed'")
    return history.flag_over_cap(contributed, ["workspace_id"], "created_at", "vq_id").select("vq_id", "accepted")


@query("visible_pairs", "J6", f"""WITH {RUNS_SQL} SELECT run_id AS vq_id FROM rn WHERE (user_id = 'u3' OR workspace_id = 'w1') AND connection_id = 'c1' AND run_id % 6 <> 0""")
def visible_pairs(spark, sf_dir):
    left = history.without(pairs(spark, sf_dir), pairs(spark, sf_dir).where("vq_id % 6 = 0"))
    return history.visible_to(left, "u3", "w1", "c1").select("vq_id")


@query("newest_runs", "T3", f"""WITH {RUNS_SQL} SELECT run_id, user_id FROM rn WHERE workspace_id = 'w2' ORDER BY ts DESC, run_id DESC LIMIT 25""")
def newest_runs(spark, sf_dir):
    return history.newest_runs(runs(spark, sf_dir), 25, workspace_id="w2").select("run_id", "user_id")


@query("runs_with_usernames", "C6", f"""WITH {RUNS_SQL} SELECT run_id, coalesce(c_name, '') AS username FROM rn LEFT JOIN (SELECT 'u' || c_custkey AS user_id, c_name FROM customer WHERE c_custkey % 2 = 0) USING (user_id)""")
def runs_with_usernames(spark, sf_dir):
    users = load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return history.with_usernames(runs(spark, sf_dir), users).select("run_id", "username")


@query("run_score_updates", "A22", f"""WITH {RUNS_SQL} SELECT run_id, CASE WHEN run_id % 3 = 0 THEN (run_id % 100) / 100 ELSE eval_score END AS eval_score FROM rn""", "eval_score")
def run_score_updates(spark, sf_dir):
    log = runs(spark, sf_dir)
    scores = log.where("run_id % 3 = 0").select("run_id", ((F.col("run_id") % 100) / 100.0).alias("eval_score"))
    return history.apply_updates(log, scores).select("run_id", "eval_score")


@query("run_log_roundtrip", "A21 A22 G13", f"""WITH {RUNS_SQL} SELECT run_id, (run_id % 1000) % 10 / 100 AS alpha, CASE WHEN run_id % 2 = 0 THEN 1.0::DOUBLE ELSE eval_score END AS eval_score FROM rn""", "alpha eval_score")
def run_log_roundtrip(spark, sf_dir):
    """Append in two parts, rewrite with updates, read the new version."""
    folder = f"{checkpoint_dir(spark)}/runlog-{uuid.uuid4().hex}"
    log = runs(spark, sf_dir)
    runlog.append(log.where("run_id % 2 = 0"), f"{folder}/log")
    runlog.append(log.where("run_id % 2 = 1"), f"{folder}/log")
    stored = runlog.read(spark, f"{folder}/log")
    path = runlog.rewrite(stored, stored.where("run_id % 2 = 0").select("run_id", F.lit(1.0).alias("eval_score")), folder)
    alpha = history.override_field(stored, "analyst_override", "alpha").cast("double")
    return runlog.read(spark, path).select("run_id", alpha.alias("alpha"), "eval_score")


@query("event_properties", "G13", """SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k FROM events GROUP BY 1""")
def event_properties(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total_k"))


@query("prune_runs", "J8", f"""WITH {RUNS_SQL} SELECT run_id FROM rn WHERE ts >= TIMESTAMP '2024-01-12 06:00:00'""")
def prune_runs(spark, sf_dir):
    return history.prune_older(runs(spark, sf_dir), "ts", "2024-01-12 06:00:00").select("run_id")


def checkpoints(spark, sf_dir):
    """Checkpoint rows whose only time is inside their identifier; every ninth id is of another version."""
    at = F.col("ts").cast("timestamp")
    made = times.uuid6_from_timestamp(at, F.col("event_id"))
    other = F.concat(F.substring(made, 1, 14), F.lit("4"), F.substring(made, 16, 30))
    return load(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 31 + F.dayofyear("ts") % 3).alias("thread_id"),
                                                F.when(F.col("event_id") % 9 == 0, other).otherwise(made).alias("checkpoint_id"))


_THREADS = "cp AS (SELECT event_id, user_id * 31 + dayofyear(ts) % 3 AS thread_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS made FROM events)"


@query("identifier_times", "G9", f"WITH {_THREADS} SELECT event_id, coalesce(epoch_us(made), -1) AS us FROM cp")
def identifier_times(spark, sf_dir):
    at = times.uuid6_timestamp(F.col("checkpoint_id"))
    return checkpoints(spark, sf_dir).select("event_id", F.coalesce(F.unix_micros(at), F.lit(-1)).alias("us"))


@query("prune_threads", "G9 J9", f"""WITH {_THREADS}, n AS (SELECT thread_id, max(made) AS newest FROM cp GROUP BY 1)
SELECT event_id FROM cp LEFT JOIN n USING (thread_id) WHERE newest IS NULL OR newest >= TIMESTAMP '2024-01-29'""")
def prune_threads(spark, sf_dir):
    kept = history.prune_stale_groups(checkpoints(spark, sf_dir), "thread_id", times.uuid6_timestamp(F.col("checkpoint_id")), "2024-01-29")
    return kept.select("event_id")


@query("newest_snapshots", "J10 T2", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 7""")
def newest_snapshots(spark, sf_dir):
    return history.newest_per(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 7).select("event_id")


MODELS = ["claude-haiku-4-5-20251001", "claude-sonnet-4-20250514", "claude-sonnet-4-6", "claude-opus-4-1-x", "unlisted-model"]
_RATES = {"claude-haiku-4-5-20251001": (1, 5), "claude-sonnet-4-20250514": (3, 15), "claude-sonnet-4-6": (3, 15), "claude-opus-4-1-x": (15, 75), "unlisted-model": (15, 75)}


def calls(spark, sf_dir):
    u, model = F.col("user_id") % len(MODELS), None
    for i, m in enumerate(MODELS):
        model = F.when(u == i, m) if model is None else model.when(u == i, m)
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 500).alias("run_id"), model.alias("model"), (F.col("value") * 100).cast("bigint").alias("input_tokens"),
        (F.col("event_id") % 900).alias("output_tokens"), (F.col("event_id") % 50).alias("cache_read_tokens"), (F.col("event_id") % 30).alias("cache_write_tokens"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("guest-"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("user_id") % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("10.0.0."), F.col("user_id") % 10)).alias("ip"))


_CALLS = "cl AS (SELECT *, CASE user_id % 5 " + " ".join(f"WHEN {i} THEN {_RATES[m][0]}" for i, m in enumerate(MODELS)) + " END AS ri, CASE user_id % 5 " + " ".join(
    f"WHEN {i} THEN {_RATES[m][1]}" for i, m in enumerate(MODELS)) + """ END AS ro, CASE WHEN user_id % 3 = 0 THEN 'ip:' || CASE WHEN user_id % 6 = 0 THEN 'unknown' ELSE '10.0.0.' || user_id % 10 END ELSE 'user:' || user_id END AS scope,
 trunc(value * 100) AS it FROM events), co AS (SELECT *, (it * ri + (event_id % 900) * ro + (event_id % 50) * ri * 0.1 + (event_id % 30) * ri * 1.25)::DOUBLE / 1000000 AS usd FROM cl)"""


@query("cost_per_run", "C7 J7", f"WITH {_CALLS} SELECT event_id % 500 AS run_id, count(*) AS calls, sum(usd) AS cost_usd FROM co GROUP BY 1", "", {"cost_usd": 8})
def cost_per_run(spark, sf_dir):
    return spend.cost_per_run(spend.priced(calls(spark, sf_dir)))


@query("longest_prefix_rates", "C7", """WITH pr AS (SELECT DISTINCT substr(p_type, 1, 1 + p_size % 4) AS prefix, 1 + p_size % 4 AS len FROM part),
m AS (SELECT DISTINCT p_type || '-' || p_brand AS model FROM part), b AS (SELECT model, max(len) AS len FROM m JOIN pr ON starts_with(model, prefix) GROUP BY 1)
SELECT model, substr(model, 1, len) AS prefix, len::DOUBLE AS input_rate, 5.0 * len AS output_rate FROM b""", "input_rate output_rate")
def longest_prefix_rates(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    length = (F.lit(1) + F.col("p_size") % 4)
    prices = part.select(F.substring(F.col("p_type"), F.lit(1), length).alias("prefix"), length.cast("double").alias("input_rate")).distinct() \
        .withColumn("output_rate", F.col("input_rate") * 5)
    return spend.rates_from_table(part.select(F.concat_ws("-", "p_type", "p_brand").alias("model")), prices)


_CAPS = {"global": 40.0, "user": 1.2, "guest": 0.9}


@query("daily_spend", "V2 G8", f"""WITH {_CALLS}, s AS (SELECT CAST(ts AS DATE) AS d, scope, sum(usd) AS spent, count(*) AS records FROM co WHERE usd > 0 GROUP BY ALL
 UNION ALL SELECT CAST(ts AS DATE), '__global__', sum(usd), count(*) FROM co WHERE usd > 0 GROUP BY 1),
c AS (SELECT *, CASE WHEN scope = '__global__' THEN 40.0 WHEN scope LIKE 'ip:%' THEN 0.9 ELSE 1.2 END AS cap FROM s)
SELECT CAST(d AS VARCHAR) AS day, scope, spent, records, cap, spent >= cap AS over FROM c""", "", {"spent": 8, "cap": 6})
def daily_spend(spark, sf_dir):
    costs = spend.priced(calls(spark, sf_dir)).withColumnRenamed("cost_usd", "usd")
    return spend.daily_spend(costs, _CAPS).withColumn("day", F.col("day").cast("string"))


@query("guest_uploads", "V2", f"""WITH {_CALLS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, scope, count(*) AS uploads, count(*) >= 4 AS over FROM co WHERE user_id % 3 = 0 GROUP BY ALL""")
def guest_uploads(spark, sf_dir):
    return spend.guest_uploads(calls(spark, sf_dir), cap=4).withColumn("day", F.col("day").cast("string"))


@query("trailing_event_rate", "E7", """WITH e AS (SELECT event_type, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, us AS at_us, n AS events, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing,
 sum(n) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) > 2 AS over FROM e""")
def trailing_event_rate(spark, sf_dir):
    return spend.trailing_counts(load(spark, sf_dir, "events"), "event_type", "ts", 300, limit=2)


@query("streaming_event_rates", "V1", """WITH w AS (SELECT event_type, epoch_us(ts) // 60000000 - k AS m FROM events, generate_series(0, 4) g(k)), c AS (SELECT m * 60 AS start_s, event_type, count(*) AS events FROM w GROUP BY ALL)
SELECT CAST(start_s AS BIGINT) AS start_s, event_type, events FROM c""")
def streaming_event_rates(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    stream = counters.file_stream(spark, sf_dir, schema, "events.parquet")
    folder = f"{checkpoint_dir(spark)}/rates-{uuid.uuid4().hex}"
    counters.run_to_parquet(counters.event_rates(stream, "event_type"), f"{folder}/out", f"{folder}/state")
    done = counters.latest(spark, f"{folder}/out", ["window_start", "window_end", "event_type"])
    return done.select(F.unix_seconds("window_start").alias("start_s"), "event_type", "events")


# one step a row: leave the window what is too old, admit as many as fit, over all event types at once
ADMITTED_SQL = """WITH RECURSIVE p AS (SELECT event_type, epoch_us(ts) AS us, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY us) AS i FROM events GROUP BY event_type, us),
run(event_type, i, us, n, held, admitted) AS (
  SELECT event_type, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL
  SELECT event_type, i, us, n, young || list_transform(range(least(n, 2 - len(young))), lambda x: us), least(n, 2 - len(young))
  FROM (SELECT p.event_type, p.i, p.us, p.n, list_filter(r.held, lambda t: t >= p.us - 3600000000) AS young FROM run r JOIN p ON p.event_type = r.event_type AND p.i = r.i + 1))
SELECT event_type, us AS at_us, n AS events, admitted FROM run WHERE i > 0"""


@query("admitted_events", "E7", ADMITTED_SQL)
def admitted_events(spark, sf_dir):
    return limiter.admitted_events(load(spark, sf_dir, "events"), "event_type", "ts", 3600, limit=2)


@query("streaming_admitted_events", "E7 V1", ADMITTED_SQL + " AND us < (SELECT epoch_ms(max(ts)) - 600000 FROM events) * 1000")
def streaming_admitted_events(spark, sf_dir):
    """Decided are the events that the watermark of ten minutes has passed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming_limiter.ROCKS)
    stream = counters.file_stream(spark, sf_dir, load(spark, sf_dir, "events").schema, "events.parquet")
    folder = f"{checkpoint_dir(spark)}/admitted-{uuid.uuid4().hex}"
    streaming_limiter.append_to_parquet(streaming_limiter.admitted_stream(stream, "event_type", "ts", 3600, 2, "10 minutes"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query("streaming_daily_spend", "V2", """WITH s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN user_id % 3 = 0 THEN 'ip:unknown' ELSE 'user:' || user_id END AS scope, value FROM events WHERE value > 0),
t AS (SELECT day, scope, sum(value) AS spent, count(*) AS records FROM s GROUP BY ALL UNION ALL SELECT day, '__global__', sum(value), count(*) FROM s GROUP BY day)
SELECT *, CAST(CASE WHEN scope = '__global__' THEN 5000 WHEN scope = 'ip:unknown' THEN 300 ELSE 0 END AS DOUBLE) AS cap,
 CASE WHEN scope = '__global__' THEN spent >= 5000 WHEN scope = 'ip:unknown' THEN spent >= 300 ELSE false END AS over FROM t""", "cap", {"spent": 4})
def streaming_daily_spend(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    stream = counters.file_stream(spark, sf_dir, schema, "events.parquet").withColumns({
        "user_id": F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("guest-"), "user_id")).otherwise(F.col("user_id").cast("string")), "ip": F.lit(None).cast("string")})
    folder = f"{checkpoint_dir(spark)}/spend-{uuid.uuid4().hex}"
    counters.run_to_parquet(counters.spend_by_day(stream, amount="value"), f"{folder}/out", f"{folder}/state")
    done = spend.against_caps(counters.latest(spark, f"{folder}/out", ["day", "scope"]), {"global": 5000.0, "guest": 300.0, "user": 0.0})
    return done.withColumn("day", F.col("day").cast("string"))


# Files and catalogs.

@query("csv_round_trip", "A1 A2 A7", """SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS acct_bal, c_mktsegment AS segment, c_mktsegment AS segment_2, '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS joined_date,
 'bigint' AS key_type, 'double' AS bal_type, 'date' AS date_type FROM customer""", "acct_bal")
def csv_round_trip(spark, sf_dir):
    """Write a table as CSV with untidy headers, read it back with inferred types."""
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
    untidy = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" Customer Key "), F.col("c_name").alias("Customer (Name)"), F.col("c_acctbal").alias("ACCT__BAL"),
        F.col("c_mktsegment").alias("Segment"), F.col("c_mktsegment").alias("segment."), day.alias("joined/date"))
    untidy.write.option("header", True).csv(folder)
    back = files.read_csv(spark, folder)
    kind = dict(back.dtypes)
    return back.select(F.col("customer_key").cast("bigint").alias("customer_key"), "customer_name", "acct_bal", "segment", "segment_2", F.col("joined_date").cast("string").alias("joined_date"),
                       F.lit({"int": "bigint"}.get(kind["customer_key"], kind["customer_key"])).alias("key_type"), F.lit(kind["acct_bal"]).alias("bal_type"), F.lit(kind["joined_date"]).alias("date_type"))


@query("infer_experiment_by_name", "A3 A5", """SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS assignment_date, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, 1::INT AS week, value AS value FROM events""", "value")
def infer_experiment_by_name(spark, sf_dir):
    flat = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("event_date"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("cohort"), "value", "event_id")
    t = files.infer_tables(flat)
    ids = flat.select("user_id", F.col("event_date").alias("assignment_date"), F.col("cohort").alias("variant"), "event_id")
    same = t["experiment"].distinct().join(ids, ["user_id", "assignment_date", "variant"]).join(t["events"].select("event_id", "value"), "event_id")
    return same.select("event_id", "user_id", F.col("assignment_date").cast("string").alias("assignment_date"), "variant", "week", "value")


@query("infer_arm_by_value", "A3 A4", """SELECT CASE WHEN user_id % 2 = 0 THEN 'Control' ELSE 'Exposed' END AS variant, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def infer_arm_by_value(spark, sf_dir):
    flat = load(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("user_id") % 2 == 0, "Control").otherwise("Exposed").alias("bucket_name"), "value")
    return files.infer_tables(flat, "2024-01-01")["experiment"].groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("infer_stub_experiment", "A3", """SELECT c_custkey AS user_id, 'control' AS variant, 1::INT AS week, '2024-01-01' AS assignment_date FROM customer""")
def infer_stub_experiment(spark, sf_dir):
    flat = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_acctbal", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 9).cast("int")).alias("joined_date"))
    return files.infer_tables(flat)["experiment"].withColumn("assignment_date", F.col("assignment_date").cast("string"))


@query("infer_time_series", "A3 A5", """SELECT 'user_1' AS user_id, CAST(o_orderdate AS DATE)::VARCHAR AS order_date, count(*) AS n FROM orders GROUP BY ALL""")
def infer_time_series(spark, sf_dir):
    flat = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("order_date"), "o_totalprice")
    return files.infer_tables(flat)["events"].groupBy("user_id", F.col("order_date").cast("string").alias("order_date")).agg(F.count(F.lit(1)).alias("n"))


@query("merged_profile", "A15 D7 D34", """SELECT 'l_quantity' AS "column", count(*) AS n, count(l_quantity) AS non_null, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, true AS distinct_close, true AS median_close FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*), count(l_extendedprice), avg(l_extendedprice), stddev_samp(l_extendedprice), min(l_extendedprice), max(l_extendedprice), true, true FROM lineitem
UNION ALL SELECT 'l_tax', count(*), count(l_tax), avg(l_tax), stddev_samp(l_tax), min(l_tax), max(l_tax), true, true FROM lineitem""", "low high", {"mean": 4, "std": 4})
def merged_profile(spark, sf_dir):
    """States of the ship months are stored, one month again, and merged; estimates are held against exact values."""
    lines = load(spark, sf_dir, "lineitem")
    columns, month = ["l_quantity", "l_extendedprice", "l_tax"], F.date_format("l_shipdate", "yyyy-MM")
    folder = f"{checkpoint_dir(spark)}/profile-{uuid.uuid4().hex}"
    profiles.store(profiles.profile_state(lines, month, columns), folder)
    profiles.store(profiles.profile_state(lines.where(month == "1995-03"), month, columns), folder)
    state = profiles.merged(profiles.stored(spark, folder))
    exact = explore.numeric_summary(lines, columns).select(F.col("name").alias("column"), "n_unique", "p25", "p75")
    out = profiles.shown(state).join(exact, "column").join(state.select("column", "low", "high"), "column")
    return out.select("column", "n", "non_null", "mean", "std", "low", "high", (F.abs(F.col("about_distinct") / F.col("n_unique") - 1) < 0.05).alias("distinct_close"),
                      F.col("about_median").between(F.col("p25"), F.col("p75")).alias("median_close"))


@query("table_profile", "A15 A16", """WITH p AS (SELECT 'orders' AS "table", count(*) AS n_rows, count(DISTINCT o_orderkey) AS d0, count(DISTINCT o_custkey) AS d1, count(DISTINCT o_orderstatus) AS d2, count(DISTINCT o_totalprice) AS d3, count(DISTINCT o_orderdate) AS d4, count(DISTINCT o_orderpriority) AS d5 FROM orders)
SELECT "table", position::INT AS position, "column", type, n_rows, n_distinct, samples FROM p, LATERAL (VALUES (0, 'o_orderkey', 'bigint', d0, NULL), (1, 'o_custkey', 'bigint', d1, NULL),
 (2, 'o_orderstatus', 'string', d2, (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders ORDER BY 1 LIMIT 5))), (3, 'o_totalprice', 'double', d3, NULL),
 (4, 'o_orderdate', 'timestamp_ntz', d4, NULL), (5, 'o_orderpriority', 'string', d5, (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY 1 LIMIT 5)))) v(position, "column", type, n_distinct, samples)""")
def table_profile(spark, sf_dir):
    return catalog.table_profile(load(spark, sf_dir, "orders"), "orders")


@query("sample_values", "A16", """SELECT CAST(l_linenumber AS VARCHAR) AS value FROM (SELECT DISTINCT l_linenumber FROM lineitem ORDER BY 1 LIMIT 10)""")
def sample_values(spark, sf_dir):
    return catalog.sample_values(load(spark, sf_dir, "lineitem"), "l_linenumber")


@query("annotated_catalog", "A13 A17", """SELECT 'o_orderstatus' AS "column", 'order state' AS comment UNION ALL
SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) || ' distinct  e.g. ' || (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY 1 LIMIT 5)) FROM orders""")
def annotated_catalog(spark, sf_dir):
    profile = catalog.table_profile(load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), "orders")
    notes = spark.createDataFrame([("orders", "o_orderstatus", "order state"), ("orders", "o_orderpriority", "")], "table string, column string, comment string")
    return catalog.annotated_catalog(profile, notes).select("column", "comment")


_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@query("catalog_hashes", "A13 A23", """WITH t AS (SELECT * FROM (VALUES ('region', 'r_regionkey int' || chr(10) || 'r_name string'), ('labels', 'doc_id bigint' || chr(10) || 'quality int' || chr(10) || 'toxic int'),
 ('nation', 'n_nationkey int' || chr(10) || 'n_name string' || chr(10) || 'n_regionkey int')) v("table", lines)), n AS (SELECT (SELECT count(*) FROM region) AS region, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM nation) AS nation)
SELECT "table", substr(sha256(lines), 1, 16) AS schema_hash, CASE "table" WHEN 'region' THEN region WHEN 'labels' THEN labels ELSE nation END AS n_rows FROM t, n""")
def catalog_hashes(spark, sf_dir):
    from functools import reduce
    names = ("region", "labels", "nation")
    tables = {n: load(spark, sf_dir, n) for n in names}
    counts = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(n)) for n, df in tables.items()])
    return catalog.schema_hash(catalog.columns_of(tables)).join(counts, "table")


@query("stored_snapshots", "A24 A25", """SELECT 'events' AS "table", c AS "column", k AS change, e.n_rows FROM (VALUES ('event_id', 'added'), ('user_id', 'added'), ('event_type', 'added'), ('props', 'added'), ('value', 'retyped')) t(c, k), (SELECT count(*) AS n_rows FROM events) e""")
def stored_snapshots(spark, sf_dir):
    """Three snapshots of two connections are stored one by one; the newest of one is compared with the table as it is."""
    events = load(spark, sf_dir, "events")
    folder = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    for connection, at, columns in (("c1", "2024-01-01 00:00:00", ["ts"]), ("c2", "2024-03-01 00:00:00", ["user_id"]), ("c1", "2024-02-01 00:00:00", ["ts", "value"])):
        old = events.select(*[F.col(c).cast("string").alias(c) if c == "value" else c for c in columns])
        catalog.append_snapshot(catalog.columns_of({"events": old}), connection, at, folder)
    newest = catalog.latest_snapshot(catalog.read_snapshots(spark, folder)).where("connection_id = 'c1'")
    rows = events.agg(F.count(F.lit(1))).scalar()
    return catalog.schema_changes(newest, catalog.columns_of({"events": events})).select("table", "column", "change", rows.alias("n_rows"))


@query("schema_changes", "A24 A25", """SELECT t."table", t."column", t.change, e.n_rows FROM (VALUES ('events', 'props', 'removed'), ('events', 'platform', 'added'), ('events', 'value', 'retyped')) t("table", "column", change), (SELECT count(*) AS n_rows FROM events) e""")
def schema_changes(spark, sf_dir):
    before = load(spark, sf_dir, "events")
    after = before.drop("props").withColumn("platform", F.lit("web")).withColumn("value", F.col("value").cast("string"))
    old = catalog.snapshot(catalog.columns_of({"events": before}), "c1", "2024-01-01 00:00:00")
    stale = catalog.snapshot(catalog.columns_of({"events": before.select("ts")}), "c1", "2023-01-01 00:00:00")
    latest = catalog.latest_snapshot(stale.unionByName(old))
    rows = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return catalog.schema_changes(latest, catalog.columns_of({"events": after})).select("table", "column", "change", rows.alias("n_rows"))


@query("dataset_fingerprints", "A23 G7", """SELECT event_type, platform, substr(sha256(coalesce(nullif(src, ''), 'demo') || '|pack=' || platform || '|v=' || v || '|schema=' || sch), 1, 32) AS fingerprint, count(*) AS n FROM (
 SELECT event_type, CASE user_id % 3 WHEN 0 THEN '' ELSE 'p' || user_id % 3 END AS platform, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS src, CASE WHEN user_id % 3 = 1 THEN '1' ELSE '' END AS v, substr(sha256(event_type), 1, 16) AS sch FROM events) GROUP BY ALL""")
def dataset_fingerprints(spark, sf_dir):
    m = F.col("user_id") % 3
    ev = load(spark, sf_dir, "events").select("event_type", F.when(m == 0, "").otherwise(F.concat(F.lit("p"), m)).alias("platform"), F.when(m == 1, 1).alias("v"))
    src = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    counted = ev.groupBy("event_type", "platform", "v").agg(F.count(F.lit(1)).alias("n"))
    print_ = catalog.fingerprint_columns(src, F.col("platform"), F.col("v"), F.substring(F.sha2("event_type", 256), 1, 16))
    return counted.select("event_type", "platform", print_.alias("fingerprint"), "n")
