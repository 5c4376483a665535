"""Ready queries for catalog, guard and shape operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.numbers import report_rounding
from gaugeline.operators import explore
from gaugeline.sources import catalog, files
from gaugeline.sources.tables import load, register_views
from registry.base import query

VIEWS = ("region", "nation", "supplier")


@query("listed_tables", "A12 A14", """SELECT 'region' AS name, 'TEMPORARY' AS kind, (SELECT count(*) FROM region) AS n_rows, true AS home_first UNION ALL
SELECT 'nation', 'TEMPORARY', (SELECT count(*) FROM nation), true UNION ALL SELECT 'supplier', 'TEMPORARY', (SELECT count(*) FROM supplier), true""")
def listed_tables(spark, sf_dir):
    register_views(spark, sf_dir, list(VIEWS))
    home = spark.catalog.currentDatabase()
    listed = catalog.list_tables(spark).where(F.col("name").isin(*VIEWS)).select("name", "kind")
    counts = [(v, catalog.count_rows(spark, f"SELECT * FROM {v}")) for v in VIEWS]
    return listed.join(spark.createDataFrame(counts, "name string, n_rows bigint"), "name").withColumn("home_first", F.lit(catalog.list_schemas(spark)[0] == home))


@query("counted_selects", "A18", """SELECT 'late' AS statement, count(*) AS n_rows FROM lineitem WHERE l_discount > 0.05 UNION ALL
SELECT 'nations', count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1)""")
def counted_selects(spark, sf_dir):
    register_views(spark, sf_dir, ["lineitem", "nation"])
    statements = {"late": "SELECT * FROM lineitem WHERE l_discount > 0.05", "nations": "WITH r AS (SELECT n_regionkey FROM nation GROUP BY 1) SELECT * FROM r"}
    return spark.createDataFrame([(k, catalog.count_rows(spark, s)) for k, s in statements.items()], "statement string, n_rows bigint")


@query("guarded_result", "A19", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def guarded_result(spark, sf_dir):
    grouped = load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    try:
        catalog.collect_guarded(load(spark, sf_dir, "customer"), ceiling=10)
    except catalog.ResultTooLargeError:
        return spark.createDataFrame(catalog.collect_guarded(grouped, ceiling=10), grouped.schema)
    raise AssertionError("the ceiling did not hold")


@query("boolean_probe", "A20", """SELECT 'large' AS "column", count(*) FILTER (l_quantity > 25) AS n_true FROM lineitem UNION ALL SELECT 'taxed', count(*) FILTER (l_tax > 0) FROM lineitem""")
def boolean_probe(spark, sf_dir):
    table = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") > 25).alias("large"), (F.col("l_tax") > 0).alias("taxed"))
    names = catalog.boolean_columns(table)
    return table.agg(*[F.count_if(c).alias(c) for c in names]) \
        .select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_true")) for c in names])).alias("r")).select("r.*")


@query("ingest_checked", "A6", """SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1""")
def ingest_checked(spark, sf_dir):
    """A table longer than one upload comes in several; each is checked and all rows are counted."""
    table = load(spark, sf_dir, "orders")
    parts = files.uploads(table)
    files.check_ingest(parts, by="upload")
    for bad in (dict(max_rows=10), dict(max_columns=2)):
        try:
            files.check_ingest(table, **bad)
        except ValueError:
            continue
        raise AssertionError(f"not refused: {bad}")
    return parts.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("joined_without_repeats", "B7", """SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def joined_without_repeats(spark, sf_dir):
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    both = nation.join(region.withColumnRenamed("r_regionkey", "k"), F.col("n_regionkey") == F.col("k"))
    twice = both.select("n_nationkey", "n_name", "n_regionkey", "r_name", both.n_name, both.n_regionkey)
    return explore.unique_columns(twice)


@query("lookup_answers", "T5", """SELECT 'region' AS answer, true AS shown, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'orders', false, (SELECT count(*) FROM orders)
UNION ALL SELECT 'none', false, 0""")
def lookup_answers(spark, sf_dir):
    tables = {"region": load(spark, sf_dir, "region"), "orders": load(spark, sf_dir, "orders"), "none": load(spark, sf_dir, "region").where("false")}
    return spark.createDataFrame([(k, explore.lookup_sized(t), t.count()) for k, t in tables.items()], "answer string, shown boolean, n bigint")


@query("rounded_report", "G2", """SELECT l_returnflag AS flag, round_even(CAST(sum(l_quantity) / count(*) AS DOUBLE), 2) AS mean_quantity, round_even(CAST(sum(l_discount) / count(*) AS DOUBLE), 4) AS mean_discount
FROM lineitem GROUP BY 1""", "mean_quantity mean_discount")
def rounded_report(spark, sf_dir):
    means = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.avg(F.col("l_quantity").cast("double")).alias("mean_quantity"), F.avg(F.col("l_discount").cast("double")).alias("mean_discount"))
    return report_rounding(means, {"mean_quantity": 2, "mean_discount": 4})
