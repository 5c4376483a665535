import pytest
from pyspark.sql import functions as F

from gaugeline.functions import names
from gaugeline.sources import catalog, databases, files


def test_clean_names():
    assert files.clean_names([" User ID ", "Revenue (USD)", "user-id", "***", "café", "a__b", "***"]) == ["user_id", "revenue_usd", "user_id_2", "col", "café", "a_b", "col_2"]


def test_csv_types_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Order Date,Returned,Note\n2024-01-02,1,"a, ""b"""\n2024-01-03,0,\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"order_date": "date", "returned": "int", "note": "string"} and df.first()["note"] == 'a, "b"'


def test_shapes(spark):
    ab = spark.createDataFrame([(1, "control", "2024-01-01", 2.0)], "patient_id int, treatment_group string, enrollment_date string, score double")
    t = files.infer_tables(ab)
    assert t["experiment"].columns == ["user_id", "variant", "assignment_date", "week"] and t["events"].columns == ["user_id", "score"]
    plain = spark.createDataFrame([(1, 2.0), (1, 3.0)], "shipment_id int, cost double")
    t = files.infer_tables(plain, "2024-05-01")
    assert t["experiment"].count() == 1 and str(t["experiment"].first()["assignment_date"]) == "2024-05-01" and t["events"].columns == ["user_id", "cost"]
    series = spark.createDataFrame([("2024-01", 5.0)], "month string, revenue double")
    assert files.infer_tables(series)["events"].columns == ["user_id", "month", "revenue"]


def test_arm_by_value(spark):
    df = spark.createDataFrame([("x", "Holdout"), ("y", "B"), ("z", "b")], "name string, bucket string")
    assert files.arm_column_by_value(df) == "bucket"
    assert files.arm_column_by_value(df.union(spark.createDataFrame([("q", "c")], "name string, bucket string"))) is None
    assert files.arm_column_by_value(df.union(spark.createDataFrame([("q", "a1")], "name string, bucket string"))) is None


def test_ingest_checks(spark):
    with pytest.raises(ValueError, match="empty"):
        files.check_ingest(spark.range(0))
    with pytest.raises(ValueError, match="rows"):
        files.check_ingest(spark.range(11), max_rows=10)
    with pytest.raises(ValueError, match="columns"):
        files.check_ingest(spark.range(1), max_columns=0)
    files.check_ingest(spark.range(10), max_rows=10)
    assert files.preview(spark.range(10)).count() == 5


def test_ingest_of_a_table_longer_than_one_upload(spark):
    long = spark.range(0, 2_500_000, 1, 2)
    with pytest.raises(ValueError, match="rows"):
        files.check_ingest(long)
    parts = files.uploads(long)
    files.check_ingest(parts, by="upload")
    sizes = [r["count"] for r in parts.groupBy("upload").count().collect()]
    assert sum(sizes) == 2_500_000 and max(sizes) == files.MAX_ROWS and len(sizes) == 4
    with pytest.raises(ValueError, match="an upload"):
        files.check_ingest(files.uploads(long, 2_000_000), by="upload")
    with pytest.raises(ValueError, match="empty"):
        files.check_ingest(files.uploads(spark.range(0)), by="upload")


def test_checked_ingest_counts_all_rows_of_a_long_table(spark, tmp_path):
    from registry.catalog import ENTRIES
    rows = spark.range(0, 1_200_000, 1, 1).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 3 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"), F.lit(1.0).alias("o_totalprice"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["priority"]: r["n"] for r in ENTRIES["ingest_checked"].run(spark, str(tmp_path)).collect()}
    assert got == {"1-URGENT": 400_000, "5-LOW": 800_000}


def test_result_ceiling(spark):
    with pytest.raises(catalog.ResultTooLargeError) as e:
        catalog.collect_guarded(spark.range(101), 100)
    assert e.value.rows == 101 and len(catalog.collect_guarded(spark.range(100), 100)) == 100 and len(catalog.collect_guarded(spark.range(5), 0)) == 5


def test_sql_and_listing(spark):
    spark.range(4).createOrReplaceTempView("numbers_view")
    assert catalog.count_rows(spark, "SELECT * FROM numbers_view WHERE id > 0") == 3
    with pytest.raises(ValueError):
        catalog.run_sql(spark, "DROP TABLE numbers_view")
    assert "numbers_view" in {r["name"] for r in catalog.list_tables(spark).collect()}
    assert catalog.list_schemas(spark)[0] == spark.catalog.currentDatabase()


def test_hash_follows_columns(spark):
    a = catalog.columns_of({"t": spark.range(1)})
    b = catalog.columns_of({"t": spark.range(1).withColumn("x", F.lit(1))})
    assert catalog.schema_hash(a).first()["schema_hash"] != catalog.schema_hash(b).first()["schema_hash"]
    assert {(r["column"], r["change"]) for r in catalog.schema_changes(a, b).collect()} == {("x", "added")}
    assert catalog.boolean_columns(spark.range(1).withColumn("f", F.lit(True))) == ["f"]


def test_database_options(spark):
    o = databases.postgres_options("h", "d", "u", "p", sslmode="require")
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["sslmode"] == "require"
    with pytest.raises(ValueError):
        databases.mysql_options("h", "d", "u", "p", tls="maybe")
    assert databases.mysql_options("h", "d", "u", "p")["connectTimeout"] == "10000"
    assert databases.bigquery_options("p", "SELECT 1", "tmp")["query"] == "SELECT 1"
    databases.jdbc_reader(spark, o, "SELECT 1", databases.Partitioning("id", "0", "100", 4))


def test_name_rules():
    assert names.harm_direction("notif_optout") == "increase" and names.harm_direction("d7_retained") == "decrease"
    assert names.harm_direction("retention_vs_churn_ratio") == "both" and names.harm_direction("height") == "both"
    assert names.default_winsor_pct("total_revenue") == 0.01 and names.default_winsor_pct("dau_rate") == 0.0
    assert names.looks_like_date_name("event_ts") and not names.looks_like_date_name("update")
    assert names.series_time_column(["event_date", "month"]) == "month" and names.entity_column(["x", "UID"]) == "UID"
    assert names.summary_dimension(["team", "order_year"]) == "order_year"
