import pytest
from pyspark.sql import functions as F

from gaugeline.functions import text as tx, vectors
from gaugeline.operators import sqlaudit, textscore as ts


def test_cited_numbers(spark):
    df = spark.createDataFrame([("In 2023 revenue was $1,234.50, up 32.7% (3 of 5 teams, 0.5 pts, 4%, $2024, 12)",), ("no numbers",)], "t string")
    assert [r[0] for r in df.select(tx.cited_numbers(F.col("t"))).collect()] == [[1234.5, 32.7, 0.5], []]


@pytest.mark.parametrize("text, wrong", [
    ("Revenue more than doubled? It is more than double: $322,996 vs $248,410.", 1), ("It is double: 20.0 against 10.0.", 0), ("It is double: 20.0 against 14.0.", 1),
    ("Sales were three times 30.0 and 10.0", 0), ("Costs are 4 times higher: 100.0 vs 50.0", 1), ("2.0 times: 100.0 vs 50.0", 0), ("double", 0), ("double in 2020 and 2021", 0),
    ("twice as much: 0.0 and 0.0", 0)])
def test_magnitude_claims(spark, text, wrong):
    assert ts.magnitude_violation_count(text) == wrong
    assert spark.createDataFrame([(text,)], "t string").select(ts.magnitude_violations(F.col("t"))).first()[0] == wrong


def test_magnitude_over_whole_documents_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("Twice 30.5 or 61.0. "), "text", F.lit(" double 7.5 vs 9.5")).alias("t"))
    rows = docs.select("t", ts.magnitude_violations(F.col("t")).alias("n")).collect()
    assert rows and all(r["n"] == ts.magnitude_violation_count(r["t"]) for r in rows) and sum(r["n"] for r in rows) > 0


def test_faithfulness_edges(spark):
    reports = spark.createDataFrame([(1, "77.4% of users"), (2, "it was 110.1"), (3, "it was 109.9"), (4, "no numbers"), (5, "cites 12.5"), (6, "exactly 0.0 and 200.0%")], "id int, text string")
    refs = spark.createDataFrame([(1, 0.774), (2, 100.0), (3, 100.0), (4, 1.0), (6, 0.05), (6, float("inf")), (6, -3.0)], "id int, v double")
    got = {r["id"]: r["faithfulness"] for r in ts.faithfulness(reports, refs, "id", "text", "v").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: None, 6: 0.5}
    tight = {r["id"]: r["faithfulness"] for r in ts.faithfulness(reports, refs, "id", "text", "v", tolerance=0.0917).collect()}
    assert tight[2] == 0.0 and tight[3] == 1.0


def test_claims(spark):
    cols = "id int, text string, p_value double, cohens_d double, ci_lower double, ci_upper double, significant boolean, cuped_ate double"
    df = spark.createDataFrame([
        (1, "A statistically significant drop.", 0.2, 0.1, -1.0, 1.0, False, -0.1), (2, "not significant", 0.01, 0.1, 0.1, 0.2, True, 0.1),
        (3, "large effect", 0.01, 0.3, -0.1, 0.2, True, 0.1), (4, "The treatment decreased use.", 0.5, 0.1, None, None, None, 0.2),
        (5, "significant", None, None, None, None, None, None), (6, "The treatment decreased use.", 0.5, 0.1, None, None, None, -0.2)], cols)
    got = {r["id"]: sorted(r["violations"]) for r in ts.experiment_claims(df, "text").collect()}
    assert got == {1: ["claims significance"], 2: ["claims no significance"], 3: ["claims large effect", "interval crosses zero"], 4: ["direction"], 5: [], 6: []}


def test_safety(spark):
    df = spark.createDataFrame([(1, "We should ship.", True, False, False, None), (2, "Stop; do not ship.", True, False, False, None), (3, "Deploy it.", False, True, True, None),
                                (4, "Launch after a larger experiment", False, False, True, 0.3), (5, "Launch", False, False, True, 0.3)],
                               "id int, text string, srm_detected boolean, any_breached boolean, significant boolean, post_hoc_power double")
    assert {r["id"]: len(r["violations"]) for r in ts.safety_rules(df, "text").collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}


def test_composite_and_quality(spark):
    row = spark.range(1).select(
        ts.composite(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(True)).alias("a"), ts.composite(F.lit(None).cast("double"), F.lit(-1.0), F.lit(1.0), F.lit(False)).alias("b"),
        ts.composite(F.lit(None).cast("double"), F.lit(0.5), F.lit(1.0), F.lit(False)).alias("c"), ts.quality(F.lit(0.5), F.lit(0.9), F.lit(True)).alias("d"),
        ts.quality(F.lit(0.5), F.lit(-1.0), F.lit(False)).alias("e"), ts.quality(F.lit(0.5), F.lit(-1.0), F.lit(True)).alias("f")).first()
    assert row["a"] == pytest.approx(0.65) and row["b"] == -1 and row["c"] == pytest.approx(0.7) and row["d"] == pytest.approx(0.54) and row["e"] == 0.5 and row["f"] == pytest.approx(0.54)


def test_question_types(spark):
    df = spark.createDataFrame([("How many TVs were sold?",), ("How many users by variant?",), ("count by number of items",), ("Why did it drop?",), ("List all vs. none",)], "q string")
    assert [r[0] for r in df.select(ts.question_type(F.col("q"))).collect()] == ["lookup", "exploratory", "lookup", "exploratory", "exploratory"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "average revenue per customer", "avg revenue by customers"), (2, "average revenue per customer", "umbrella weather in paris"), (3, "", "x")], "id int, a string, b string")
    got = {r["id"]: r["relevancy"] for r in vectors.pair_cosine(df, "id", "a", "b").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] < 0.2 and got[3] == 0.0
    v = vectors.dense(vectors.embed(df, ["id"], "a"), ["id"]).where("id = 1").first()["vector"]
    assert len(v) == 384 and sum(x * x for x in v) == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("sql, verdict", [
    ("SELECT 1", "ok"), ("with a as (select 1) select * from a;", "ok"), ("SELECT 1 -- drop; table", "ok"), ("SELECT 'it''s; DROP' AS x", "ok"), ("-- c\nSELECT 1", "ok"),
    ("SELECT 1; SELECT 2", "more than one statement"), ("DROP TABLE x", "not a query"), ("SELECT * FROM x; DELETE FROM y", "more than one statement"), ("SELECT 1 FROM (DELETE FROM y)", "mutation"),
    ("SELECT * FROM read_parquet('f')", "file read"), ("  ", "empty"), ("SELECT \"a;b\" FROM `t;u` /* ; */", "ok"), ("/* only", "not a query"), ("SELECT 'open; literal", "ok")])
def test_lint(spark, sql, verdict):
    assert spark.createDataFrame([(sql,)], "s string").select(sqlaudit.lint(F.col("s"))).first()[0] == verdict


def test_references(spark):
    catalog = spark.createDataFrame([("events", "user_id"), ("events", "value"), ("marts.orders", "id")], "table string, column string")
    sql = "WITH p AS (SELECT e.user_id FROM events e), q AS (SELECT 1) SELECT p.x, e.nope, o.id, z.y, s.bad FROM p JOIN marts.orders o ON o.id = p.x JOIN stray s ON 1 = 1 JOIN q ON true"
    df = spark.createDataFrame([(1, sql)], "id int, sql string")
    assert [r["table"] for r in sqlaudit.unknown_tables(df, "id", "sql", catalog).collect()] == ["stray"]
    assert [(r["alias"], r["column"]) for r in sqlaudit.unknown_columns(df, "id", "sql", catalog).collect()] == [("e", "nope")]
    assert sqlaudit.usable_examples(df, "sql", ["events", "marts.orders", "stray"]).count() == 1
    assert sqlaudit.usable_examples(df, "sql", ["events"]).count() == 0 and sqlaudit.usable_examples(df, "sql", []).count() == 0
