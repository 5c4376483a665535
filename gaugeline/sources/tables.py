"""Parquet tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.session import prepare


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def load_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row, such as texts.

    A table of a few unsplittable files would keep most cores idle, so it is dealt out once; a table that already
    has enough splits is read as it is.
    """
    df = load(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Expose tables to ``spark.sql``: joins, windows, common table expressions and set operations all work there."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
