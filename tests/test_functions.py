from pyspark.sql import functions as F

from gaugeline.functions import numbers


def test_ratio_and_labels(spark):
    row = spark.range(1).select(
        numbers.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), numbers.ratio(F.lit(1.0), F.lit(0.0), 0.0).alias("b"),
        numbers.money_label(F.lit(12345.0)).alias("c"), numbers.money_label(F.lit(845.4)).alias("d"),
        numbers.count_label(F.lit(1234567)).alias("e"), numbers.count_label(F.lit(None).cast("int")).alias("f")).first()
    assert tuple(row) == (None, 0.0, "~$12k", "~$845", "1,234,567", "n/a")


def test_report_rounding(spark):
    df = spark.createDataFrame([(0.125, 2.5, 7)], "x double, y double, n int")
    assert tuple(numbers.report_rounding(df, {"x": 2, "y": 0}).first()) == (0.12, 2.0, 7)
    assert tuple(numbers.report_rounding(df, 1).first()) == (0.1, 2.5, 7)
