import random

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import times, vectors
from gaugeline.operators import history, spend


def test_similar_runs_equal_brute_force_with_copies_and_a_hot_scope(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    runs = [(i, "hot" if i % 3 else f"u{i % 5}", " ".join(rng.choice(words) for _ in range(6)) if i % 4 else "daily revenue by platform", i) for i in range(200)]
    asked = [(i, s, t if i % 2 else " ".join(t.split()[1:]), 0) for i, s, t, _ in runs if i % 3 != 2] + [(999, None, "daily revenue", 0), (998, "", "daily revenue", 0)]
    rd = spark.createDataFrame(runs, "run_id int, user_id string, task string, ts int")
    qd = spark.createDataFrame(asked, "question_id int, user_id string, task string, x int")
    got = {r["question_id"]: (r["matched_run"], round(r["similarity"], 6), r["hit_type"]) for r in history.similar_runs(qd, rd, ["user_id"], "question_id", "run_id").collect()}
    vec = lambda df, k: {r[k]: r["vector"] for r in vectors.dense(vectors.embed(df, [k], "task"), [k], "double").collect()}
    rv, qv = vec(rd, "run_id"), vec(qd, "question_id")
    want = {}
    for q, scope, _, _ in asked:
        best = max(((round(sum(a * b for a, b in zip(qv[q], rv[r])), 7), r) for r, s, _, _ in runs if s == scope), default=None)
        if best and best[0] >= 0.8:
            want[q] = (best[1], round(best[0], 6), "hard" if best[0] >= 0.92 else "soft")
    assert got == want and len(got) > 50


def test_similar_runs_are_the_same_in_many_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, "hot" if i % 4 else "cold", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))), i % 50) for i in range(300)]
    rd = spark.createDataFrame(rows, "run_id int, user_id string, task string, ts int")
    qd = spark.createDataFrame([(i, s, " ".join(t.split()[1:]), 0) for i, s, t, _ in rows], "question_id int, user_id string, task string, x int")
    found = lambda: sorted(map(tuple, history.similar_runs(qd, rd, ["user_id"], "question_id", "run_id").collect()))
    whole = found()
    monkeypatch.setattr(history, "BLOCK", 16)
    monkeypatch.setattr(history, "CHUNK", 3)
    assert found() == whole and len(whole) > 50


@pytest.mark.parametrize("block", [4, 16_384])
def test_examples_equal_brute_force_with_nulls_and_equal_scores(spark, monkeypatch, block):
    monkeypatch.setattr(history, "BLOCK", block)
    rng = random.Random(8)
    words = ["revenue", "region", "churn", "weekly", "country", "orders"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
    some = lambda *v: rng.choice([None, "", *v])
    rd = [(i, rng.choice("uv"), i % 7, text(), "select 1", some("p", "q"), some("c", "d")) for i in range(60)]
    qd = [(i, rng.choice("uvw"), text(), some("p", "q"), some("c", "d")) for i in range(30)]
    runs_ = spark.createDataFrame(rd, "run_id int, user_id string, ts int, task string, sql string, metric_pack_id string, connection_id string")
    asked = spark.createDataFrame(qd, "question_id int, user_id string, task string, metric_pack_id string, connection_id string")
    vec = lambda df, k: {r[k]: r["vector"] for r in vectors.dense(vectors.embed(df, [k], "task"), [k], "double").collect()}
    rv, qv, none = vec(runs_, "run_id"), vec(asked, "question_id"), [0.0] * vectors.DIMENSIONS
    part = lambda own, other, same, apart: 0.0 if not own else same if own == other else apart if other else 0.0
    want = []
    for q, user, _, pack, conn in qd:
        scores = [(round(sum(a * b for a, b in zip(qv.get(q, none), rv.get(r, none))) + 0.05 * (part(pack, p, 2.0, -1.5) + part(conn, c, 1.0, -1.0)), 7), ts, r)
                  for r, u, ts, _, _, p, c in rd if u == user]
        want += [(q, r, s, k + 1) for k, (s, _, r) in enumerate(sorted((x for x in scores if x[0] >= 0.4), reverse=True)[:2])]
    got = sorted(map(tuple, history.example_statements(asked, runs_).collect()))
    assert [(q, r, pytest.approx(s, abs=2e-7), k) for q, r, s, k in sorted(want)] == got and len(got) > 20


def test_cap_marks_but_keeps_rows(spark):
    df = spark.createDataFrame([("a" if i < 90 else "b", i) for i in range(100)], "scope string, t int")
    out = history.flag_over_cap(df, ["scope"], "t", "t", 20)
    assert out.count() == 100 and out.where("accepted").groupBy("scope").count().orderBy("scope").collect()[0]["count"] == 20


def test_history_prefers_scope_and_needs_overlap(spark):
    cols = "run_id int, user_id string, ts int, task string, metric string, top_segment string, eval_score double, audit_passed boolean, metric_pack_id string, connection_id string"
    runs = spark.createDataFrame([(1, "u", 1, "revenue by region", "", "", 0.0, True, "p", "c"), (2, "u", 2, "revenue by region", "", "", 0.9, True, "q", "d"),
                                  (3, "u", 3, "other words", "", "", 1.0, True, "p", "c"), (4, "u", 4, "revenue by region", "", "", 1.0, False, "p", "c")], cols)
    q = spark.createDataFrame([(7, "u", "revenue trend region", "p", "c")], "question_id int, user_id string, task string, metric_pack_id string, connection_id string")
    rows = history.relevant_history(q, runs).collect()
    assert [r["run_id"] for r in rows] == [1, 2] and rows[0]["score"] == pytest.approx(2 * 0.7 + 0.15 + 3)


def test_trailing_counts_on_bursts_and_edges(spark):
    rng = random.Random(1)
    stamps = sorted([1_000_000 * rng.randrange(0, 2000) + rng.choice([0, 1, 999_999]) for _ in range(400)] + [5_000_000] * 30 + [305_000_000, 305_000_001])
    df = spark.createDataFrame([("hot", s) for s in stamps] + [("cold", 7)], "k string, us long").select("k", F.timestamp_micros("us").alias("ts"))
    got = {(r["k"], r["at_us"]): r["trailing"] for r in spend.trailing_counts(df, "k", "ts", 300).collect()}
    for s in set(stamps):
        assert got["hot", s] == sum(s - 300_000_000 <= x <= s for x in stamps)
    assert got["cold", 7] == 1


def test_rates(spark):
    df = spark.createDataFrame([("claude-sonnet-4-20250514",), ("claude-sonnet-4-6",), ("nobody",)], "model string")
    assert [r[0] for r in df.select(spend.rate(F.col("model"), 0)).collect()] == [3.0, 3.0, 15.0]
    calls = spark.createDataFrame([("claude-haiku-4-5", 1_000_000, 1_000_000, 1_000_000, 1_000_000)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    assert spend.priced(calls).first()["cost_usd"] == pytest.approx(1 + 5 + 0.1 + 1.25)
    prices = spark.createDataFrame([("a", 1.0, 2.0), ("ab", 3.0, 4.0)], "prefix string, input_rate double, output_rate double")
    got = {r["model"]: r["input_rate"] for r in spend.rates_from_table(spark.createDataFrame([("abc",), ("ax",), ("z",)], "model string"), prices).collect()}
    assert got == {"abc": 3.0, "ax": 1.0, "z": 15.0}


def test_identifier_time(spark):
    df = spark.createDataFrame([("1ec9414c-232a-6b00-b3c8-9e6bdeced846",), ("not an id",), ("1ec9414c-232a-4b00-b3c8-9e6bdeced846",)], "i string")
    rows = [r[0] for r in df.select(F.unix_seconds(times.uuid6_timestamp(F.col("i")))).collect()]
    assert rows == [1645557742, None, None]


def test_updates_and_deletes(spark):
    runs = spark.createDataFrame([(1, 0.1), (2, 0.2)], "run_id int, eval_score double")
    out = {r["run_id"]: r["eval_score"] for r in history.apply_updates(runs, spark.createDataFrame([(2, 0.9)], "run_id int, eval_score double")).collect()}
    assert out == {1: 0.1, 2: 0.9}
    assert history.without(runs, runs.where("run_id = 1"), "run_id").count() == 1


def test_spend_caps(spark):
    df = spark.createDataFrame([("guest-1", "1.1.1.1", "2024-01-01 01:00:00", 0.6), ("guest-2", "1.1.1.1", "2024-01-01 23:59:59", 0.5), ("u", None, "2024-01-02 00:00:00", 1.0), ("u", None, "2024-01-02 00:00:00", 0.0)],
                               "user_id string, ip string, ts string, usd double").withColumn("ts", F.to_timestamp("ts"))
    rows = {(str(r["day"]), r["scope"]): r for r in spend.daily_spend(df, {"global": 0, "user": 5.0, "guest": 1.0}).collect()}
    assert rows["2024-01-01", "ip:1.1.1.1"]["over"] and not rows["2024-01-01", "__global__"]["over"] and rows["2024-01-02", "user:u"]["records"] == 1
