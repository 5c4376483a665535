"""Run history: similarity lookup, retrieval of examples, curation and retention.

Per-scope limits ("newest 80", "newest 200") are part of the rules. They are applied with ranked filters
that Spark evaluates before the shuffle, so a scope with very many runs sends only its newest rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeline.functions import vectors
from gaugeline.functions.text import keyword_set, one_line, overlap_size
from gaugeline.session import cut_lineage

HARD_HIT, SOFT_HIT = 0.92, 0.80
HISTORY_DEPTH, EXAMPLE_DEPTH, CONTRIBUTED_CAP = 80, 200, 20
MIN_SIMILARITY = 0.40
#: rows of one side that meet in one task, and rows multiplied at a time
BLOCK, CHUNK = 16_384, 256
SOURCE_BOOST = {"contributed": 0.10, "gate": 0.05}


def newest_per(df: DataFrame, keys: list[str], order: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key."""
    ranked = W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Upsert result: the newest row per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def replace_gate_rows(pairs: DataFrame) -> DataFrame:
    """Gate captures keep the newest row per (user, task, connection); contributed rows all stay."""
    gate = latest_per_key(pairs.where("source = 'gate'"), ["user_id", "task", "connection_id"], "created_at", "vq_id")
    return pairs.where("source <> 'gate'").unionByName(gate.select(*pairs.columns))


def flag_over_cap(df: DataFrame, scope: list[str], order: str, tie: str, cap: int = CONTRIBUTED_CAP) -> DataFrame:
    """Mark rows past the first ``cap`` of their scope (``accepted``); nothing is dropped.

    Only the first rows of each scope are ranked. Their last one is the limit the other rows are compared with.
    """
    first = W.partitionBy(*scope).orderBy(order, tie)
    ranked = df.select(*scope, order, tie, F.row_number().over(first).alias("_rn")).where(F.col("_rn") <= cap)
    limits = ranked.groupBy(*scope).agg(F.max(F.struct(order, tie)).alias("_limit"))
    return df.join(limits, scope).withColumn("accepted", F.struct(order, tie) <= F.col("_limit")).drop("_limit")


# Similarity lookup.

def _signed(df: DataFrame, scope: list[str], text: str) -> DataFrame:
    """Add a signature of the canonical wording: texts that agree in it share one vector."""
    return df.withColumn("_sig", F.md5(F.array_join(vectors.canonical_tokens(F.col(text)), " ")))


def _blocks(df: DataFrame, scope: list[str], name: str, size: int) -> DataFrame:
    """How many blocks of about ``size`` rows a scope is cut into."""
    return df.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def _met_in_blocks(asked: DataFrame, stored: DataFrame, scope: list[str], pick, schema: str, cut_stored: bool = True) -> DataFrame:
    """Every asked row meets every stored row of its scope, in tasks of one block of each; ``pick`` gets both as Arrow tables.

    Rows are dealt to blocks by a hash of all their columns, so a scope that holds most rows is many tasks, and a task holds
    two blocks however many rows there are. Without ``cut_stored`` the stored rows of a scope are one block.
    """
    stored_blocks = _blocks(stored, scope, "_rn", BLOCK) if cut_stored else stored.select(*scope).distinct().withColumn("_rn", F.lit(1))
    counts = _blocks(asked, scope, "_qn", BLOCK).join(stored_blocks, scope)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    left = asked.join(counts, scope).select(*asked.columns, dealt(asked, "_qn").alias("_qb"), every("_rn").alias("_rb"))
    right = stored.join(counts, scope).select(*stored.columns, dealt(stored, "_rn").alias("_rb"), every("_qn").alias("_qb"))
    by = [*scope, "_qb", "_rb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(pick, schema)


def _matrix(table: pa.Table) -> np.ndarray:
    return vectors.matrix(table["buckets"].combine_chunks(), table["weights"].combine_chunks())


def _closest(scope: list[str], order: str, run_id: str, soft: float):
    """The most similar stored row of a block per asked row, the newest of equal ones; none below ``soft``."""
    def pick(asked: pa.Table, stored: pa.Table) -> pa.Table:
        stored = stored.sort_by([(order, "descending"), (run_id, "descending")])
        q, r = _matrix(asked), _matrix(stored).T
        found, similarity = np.zeros(len(q), dtype=np.int64), np.full(len(q), -np.inf)
        for at in range(0, len(q) if stored.num_rows else 0, CHUNK):
            dots = q[at:at + CHUNK] @ r
            best = np.round(dots, 7).argmax(axis=1)
            found[at:at + CHUNK], similarity[at:at + CHUNK] = best, dots[np.arange(len(best)), best]
        hit = np.flatnonzero(similarity >= soft - 1e-6)
        asked, chosen = asked.take(pa.array(hit)), stored.take(pa.array(found[hit]))
        return pa.table([*[asked[c] for c in scope], asked["q_sig"], pa.array(similarity[hit]), chosen[order], chosen[run_id]],
                        names=[*scope, "q_sig", "_dot", order, run_id])

    return pick


def similar_runs(questions: DataFrame, runs: DataFrame, scope: list[str], question_id: str, run_id: str, text: str = "task",
                 order: str = "ts", soft: float = SOFT_HIT, hard: float = HARD_HIT) -> DataFrame:
    """Best stored run per question within its scope: ``hit_type`` hard or soft; questions without a hit do not appear.

    Exact: copies collapse to one vector per scope (newest run), and the vectors of a scope meet as products of matrix
    blocks, of which only the best stored row per question leaves a task. No pair is written out.
    """
    asked = _signed(questions, scope, text).where(" AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in scope))
    stored = _signed(runs, scope, text).groupBy(*scope, "_sig").agg(
        F.max(F.struct(F.col(order), F.col(run_id))).alias("_newest"), F.first(text).alias(text))
    distinct_asked = asked.groupBy(*scope, "_sig").agg(F.first(text).alias(text))
    keys = [*scope, "_sig"]
    # vectors are written out once: they are counted and dealt out
    q = cut_lineage(vectors.packed(vectors.embed(distinct_asked, keys, text), keys).withColumnRenamed("_sig", "q_sig"))
    r = cut_lineage(vectors.packed(vectors.embed(stored, keys, text), keys).join(stored.select(*keys, "_newest.*"), keys).drop("_sig"))
    shown = q.select(*scope, "q_sig", F.lit(0.0).alias("_dot")).schema
    for name in (order, run_id):
        shown = shown.add(r.schema[name])
    met = _met_in_blocks(q, r, scope, _closest(scope, order, run_id, soft), shown)
    rounded = met.withColumn("similarity", F.round("_dot", 7)).where(F.col("similarity") >= soft)
    best = rounded.groupBy(*scope, "q_sig").agg(F.max(F.struct("similarity", F.struct(order, run_id).alias("_newest"))).alias("_b"))
    return asked.withColumnRenamed("_sig", "q_sig").join(best, [*scope, "q_sig"]).select(
        question_id, F.col(f"_b._newest.{run_id}").alias("matched_run"), F.col("_b.similarity").alias("similarity"),
        F.when(F.col("_b.similarity") >= hard, "hard").otherwise("soft").alias("hit_type"))


def closest_vectors(asked: DataFrame, stored: DataFrame, scope: list[str], asked_id: str, stored_id: str, vector: str = "vector") -> DataFrame:
    """Most similar stored vector of the same scope per asked vector, for supplied dense vectors.

    Meant for a few asked vectors per scope (a question, a class centre): the work is linear in the stored rows
    and the best row is kept by partial aggregation. Tables of texts go through :func:`similar_runs`.
    """
    probes = asked.select(*scope, F.col(asked_id), F.col(vector).alias("_q"))
    compared = stored.select(*scope, F.col(stored_id), F.col(vector).alias("_v")).join(probes, scope)
    best = F.struct(F.round(vectors.cosine(F.col("_q"), F.col("_v")), 7).alias("similarity"), (-F.col(stored_id)).alias("k"))
    return compared.groupBy(asked_id).agg(F.max(best).alias("b")).select(asked_id, (-F.col("b.k")).alias("nearest"), F.col("b.similarity").alias("similarity"))


def class_centres(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label: positions average independently, so a large label combines on the map side."""
    per_position = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_position.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


# Retrieval with scope preferences.

def scope_boost(pack: Column, connection: Column, own_pack: Column, own_connection: Column) -> Column:
    """Prefer the same metric pack, then the same connection; mild penalties across scopes."""
    wanted = lambda c: F.coalesce(c, F.lit("")) != ""
    return (F.when(wanted(own_pack) & (pack == own_pack), 2.0).when(wanted(own_pack) & wanted(pack), -1.5).otherwise(0.0)
            + F.when(wanted(own_connection) & (connection == own_connection), 1.0)
            .when(wanted(own_connection) & wanted(connection), -1.0).otherwise(0.0))


def relevant_history(questions: DataFrame, runs: DataFrame, top: int = 3) -> DataFrame:
    """The most relevant audited runs of the same user per question: keyword overlap, quality and scope.

    Questions hold ``question_id, user_id, task, metric_pack_id, connection_id``; runs also ``run_id, ts, metric,
    top_segment, eval_score, audit_passed``. A run among the top that shares no keyword is left out.
    """
    recent = newest_per(runs.where("audit_passed"), ["user_id"], "ts", "run_id", HISTORY_DEPTH)
    words = keyword_set(F.concat_ws(" ", "task", "top_segment", "metric"))
    recent = recent.select("user_id", "run_id", "ts", words.alias("_words"), "eval_score", F.col("metric_pack_id").alias("_pack"),
                           F.col("connection_id").alias("_conn"))
    asked = questions.select("question_id", "user_id", keyword_set(F.col("task")).alias("_asked"), "metric_pack_id", "connection_id")
    both = asked.join(recent, "user_id")
    quality = F.when(F.coalesce("eval_score", F.lit(0.0)) != 0, F.col("eval_score")).otherwise(0.5)
    overlap = overlap_size(F.col("_asked"), F.col("_words"))
    scored = both.withColumns({"overlap": overlap, "score": overlap * 0.7 + quality * 0.3 + scope_boost(
        F.col("_pack"), F.col("_conn"), F.col("metric_pack_id"), F.col("connection_id"))})
    order = W.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("ts").desc(), F.col("run_id").desc())
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top) & (F.col("overlap") > 0)) \
        .select("question_id", "run_id", "overlap", "score", "rank")


def _vector_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return vectors.packed(vectors.embed(df, [key], text), [key])


def _agreement(asked: pa.ChunkedArray, stored: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs: whether both sides are given and equal, and whether both are given; null and '' are not given."""
    a, b = (np.array([v or "" for v in c.to_pylist()], dtype=object) for c in (asked, stored))
    codes = pd.factorize(np.concatenate([[""], a, b]))[0]
    a, b = codes[1:len(a) + 1, None], codes[None, len(a) + 1:]
    given = (a != 0) & (b != 0)
    return given & (a == b), given


def _scope_preference(asked: pa.Table, stored: pa.Table, similarity: np.ndarray) -> np.ndarray:
    """As :func:`scope_boost`, for all pairs of two blocks."""
    same_pack, both_packs = _agreement(asked["metric_pack_id"], stored["_pack"])
    same, both = _agreement(asked["connection_id"], stored["_conn"])
    boost = np.where(same_pack, 2.0, np.where(both_packs, -1.5, 0.0)) + np.where(same, 1.0, np.where(both, -1.0, 0.0))
    return similarity + 0.05 * boost


def _source_preference(asked: pa.Table, stored: pa.Table, similarity: np.ndarray) -> np.ndarray:
    """Boosts by source and connection, and the penalty on another schema, for all pairs of two blocks."""
    same, _ = _agreement(asked["connection_id"], stored["_conn"])
    same_schema, both_schemas = _agreement(asked["schema_hash"], stored["_hash"])
    return similarity + stored["_boost"].to_numpy()[None, :] + np.where(same, 0.05, 0.0) - np.where(both_schemas & ~same_schema, 0.15, 0.0)


def _top_examples(preference, top: int):
    """The ``top`` stored rows of most similarity per asked row, newest first among equal ones."""
    def pick(asked: pa.Table, stored: pa.Table) -> pa.Table:
        stored = stored.sort_by([("_ts", "descending"), ("example_id", "descending")])
        r = _matrix(stored).T
        of_asked, of_stored, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for at in range(0, asked.num_rows, CHUNK):
            part = asked.slice(at, CHUNK)
            scores = preference(part, stored, _matrix(part) @ r)
            rounded, rows = np.round(scores, 7), np.arange(part.num_rows)
            for _ in range(min(top, stored.num_rows)):
                best = rounded.argmax(axis=1)
                kept = np.flatnonzero(rounded[rows, best] >= MIN_SIMILARITY - 1e-6)
                of_asked.append(at + kept)
                of_stored.append(best[kept])
                found.append(scores[kept, best[kept]])
                rounded[rows, best] = -np.inf
        chosen = stored.take(pa.array(np.concatenate(of_stored)))
        return pa.table([asked["question_id"].take(pa.array(np.concatenate(of_asked))), chosen["example_id"], chosen["_ts"], pa.array(np.concatenate(found))],
                        names=["question_id", "example_id", "_ts", "_score"])

    return pick


def _ranked(asked: DataFrame, stored: DataFrame, scope: str, preference, top: int) -> DataFrame:
    """The ``top`` examples per question. A scope's stored rows are few and meet its questions block by block."""
    shown = asked.select("question_id").schema
    for name in ("example_id", "_ts"):
        shown = shown.add(stored.schema[name])
    shown = shown.add("_score", "double")
    scored = _met_in_blocks(asked, stored, [scope], _top_examples(preference, top), shown, cut_stored=False)
    order = W.partitionBy("question_id").orderBy(F.col("similarity").desc(), F.col("_ts").desc(), F.col("example_id").desc())
    return scored.withColumn("similarity", F.round("_score", 7)).where(F.col("similarity") >= MIN_SIMILARITY) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("question_id", "example_id", "similarity", "rank")


def example_statements(questions: DataFrame, runs: DataFrame, top: int = 2) -> DataFrame:
    """Past statements of the same user for similar questions; runs hold ``run_id, user_id, ts, task, sql, …``."""
    recent = newest_per(runs.where("sql IS NOT NULL"), ["user_id"], "ts", "run_id", EXAMPLE_DEPTH)
    kept = recent.where(F.trim("sql") != "")
    stored = kept.join(_vector_of(kept, "run_id", "task"), "run_id", "left").select(
        "user_id", F.col("run_id").alias("example_id"), F.col("ts").alias("_ts"), F.col("metric_pack_id").alias("_pack"),
        F.col("connection_id").alias("_conn"), "buckets", "weights")
    asked = questions.join(_vector_of(questions, "question_id", "task"), "question_id", "left").select(
        "question_id", "user_id", "metric_pack_id", "connection_id", "buckets", "weights")
    return _ranked(cut_lineage(asked), cut_lineage(stored), "user_id", _scope_preference, top)


def visible_pairs(callers: DataFrame, pairs: DataFrame, depth: int = EXAMPLE_DEPTH) -> DataFrame:
    """The newest pairs each caller may see: their own and their workspace's.

    The newest of a union lie within the newest of its parts, so each part is limited before it meets the callers.
    """
    own = newest_per(pairs, ["user_id"], "created_at", "vq_id", depth)
    shared = newest_per(pairs.where("workspace_id <> ''"), ["workspace_id"], "created_at", "vq_id", depth)
    rest = [c for c in pairs.columns if c not in ("user_id", "workspace_id")]
    mine = callers.join(own.select("user_id", *rest), "user_id").select("caller_id", *rest)
    ours = callers.where("workspace_id <> ''").join(shared.select("workspace_id", *rest), "workspace_id").select("caller_id", *rest)
    return newest_per(mine.unionByName(ours).dropDuplicates(["caller_id", "vq_id"]), ["caller_id"], "created_at", "vq_id", depth)


def verified_statements(questions: DataFrame, pairs: DataFrame, top: int = 2) -> DataFrame:
    """Verified pairs for similar questions: visible scope, source and connection boosts, stale-schema penalty.

    Questions hold ``question_id, user_id, workspace_id, task, connection_id, schema_hash``.
    """
    callers = questions.select("user_id", "workspace_id").distinct().withColumn("caller_id", F.concat_ws("\u0001", "user_id", "workspace_id"))
    seen = visible_pairs(callers, pairs)
    vec = _vector_of(pairs.join(seen.select("vq_id").distinct(), "vq_id", "left_semi"), "vq_id", "task")
    boosts = F.create_map(*[F.lit(x) for kv in SOURCE_BOOST.items() for x in kv])
    stored = seen.join(vec, "vq_id").select("caller_id", F.col("vq_id").alias("example_id"), F.col("created_at").alias("_ts"),
                                            F.coalesce(F.try_element_at(boosts, F.col("source")), F.lit(0.0)).alias("_boost"),
                                            F.col("connection_id").alias("_conn"), F.col("schema_hash").alias("_hash"), "buckets", "weights")
    asked = questions.withColumn("caller_id", F.concat_ws("\u0001", "user_id", "workspace_id")).join(_vector_of(questions, "question_id", "task"), "question_id") \
        .select("question_id", "caller_id", "connection_id", "schema_hash", "buckets", "weights")
    return _ranked(cut_lineage(asked), cut_lineage(stored), "caller_id", _source_preference, top)


def merged_examples(verified: DataFrame, cached: DataFrame, by: list[str], sql: str = "sql", top: int = 3) -> DataFrame:
    """Verified examples first, then cached ones; the first of equal statements stays; at most ``top`` per group."""
    both = verified.withColumn("_source", F.lit(0)).unionByName(cached.withColumn("_source", F.lit(1)))
    keyed = both.withColumn("_key", one_line(F.col(sql))).where("_key <> ''")
    rest = [c for c in keyed.columns if c not in (*by, "_key")]
    first = keyed.groupBy(*by, "_key").agg(F.min(F.struct("_source", "rank", *[c for c in rest if c not in ("_source", "rank")])).alias("_f"))
    order = W.partitionBy(*by).orderBy("_f._source", "_f.rank", "_key")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top) \
        .select(*by, "position", F.col("_f._source").alias("source_order"), F.col(f"_f.{sql}").alias(sql))


# Lists and retention.

def visible_to(pairs: DataFrame, user_id: str, workspace_id: str = "", connection_id: str | None = None) -> DataFrame:
    """Pairs of a caller or their workspace, newest first."""
    mine = F.col("user_id") == user_id
    scope = mine | (F.col("workspace_id") == workspace_id) if workspace_id else mine
    out = pairs.where(scope)
    out = out if connection_id is None else out.where(F.col("connection_id") == connection_id)
    return out.orderBy(F.col("created_at").desc(), "vq_id")


def without(pairs: DataFrame, removed: DataFrame, key: str = "vq_id") -> DataFrame:
    """Delete by key: what remains after the rewrite."""
    return pairs.join(removed.select(key).distinct(), key, "left_anti").select(*pairs.columns)


def newest_runs(runs: DataFrame, limit: int = 50, user_id: str | None = None, workspace_id: str | None = None) -> DataFrame:
    """Newest runs of a workspace, else of a user, else of everyone; at most 100."""
    scoped = runs.where(F.col("workspace_id") == workspace_id) if workspace_id else runs.where(F.col("user_id") == user_id) if user_id else runs
    return scoped.orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(min(limit, 100))


def with_usernames(runs: DataFrame, users: DataFrame) -> DataFrame:
    return runs.join(users.select("user_id", "username"), "user_id", "left").withColumn("username", F.coalesce("username", F.lit("")))


def apply_updates(runs: DataFrame, updates: DataFrame, key: str = "run_id") -> DataFrame:
    """Set the non-null columns of ``updates`` on the rows with the same key; the result is written as a new version."""
    changed = [c for c in updates.columns if c != key]
    renamed = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = runs.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in runs.columns])


def prune_older(df: DataFrame, order: str, cutoff: str) -> DataFrame:
    """Keep rows not older than the cutoff."""
    return df.where(F.col(order) >= F.lit(cutoff).cast(df.schema[order].dataType))


def prune_stale_groups(df: DataFrame, group: str, order: Column, cutoff: str) -> DataFrame:
    """Drop whole groups whose newest row is older than the cutoff; groups without any time stay."""
    newest = df.groupBy(group).agg(F.max(order).alias("_newest"))
    stale = newest.where(F.col("_newest") < F.lit(cutoff).cast("timestamp")).select(group)
    return df.join(stale, group, "left_anti").select(*df.columns)


def override_field(runs: DataFrame, column: str, field: str) -> Column:
    """A field of the JSON stored with a run."""
    return F.get_json_object(F.col(column), f"$.{field}")
