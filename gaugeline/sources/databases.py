"""Reader options for external databases. Statements run in the database; Spark reads the result in parallel ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


@dataclass(frozen=True)
class Partitioning:
    """Split a read into ranges of a numeric or date column, one task each."""

    column: str
    lower: str
    upper: str
    partitions: int


def postgres_options(host: str, database: str, user: str, password: str, port: int = 5432, sslmode: str = "prefer",
                     connect_timeout: int = 10, read_timeout: int = 60) -> dict[str, str]:
    return {"url": f"jdbc:postgresql://{host}:{port}/{database}", "user": user, "password": password, "driver": "org.postgresql.Driver",
            "sslmode": sslmode, "connectTimeout": str(connect_timeout), "socketTimeout": str(read_timeout), "readOnly": "true"}


def mysql_options(host: str, database: str, user: str, password: str, port: int = 3306, tls: str = "PREFERRED",
                  connect_timeout: int = 10, read_timeout: int = 60) -> dict[str, str]:
    if tls not in ("DISABLED", "PREFERRED", "REQUIRED", "VERIFY_CA", "VERIFY_IDENTITY"):
        raise ValueError(f"unknown TLS mode {tls}")
    return {"url": f"jdbc:mysql://{host}:{port}/{database}", "user": user, "password": password, "driver": "com.mysql.cj.jdbc.Driver",
            "sslMode": tls, "connectTimeout": str(connect_timeout * 1000), "socketTimeout": str(read_timeout * 1000)}


def jdbc_reader(spark: SparkSession, options: dict[str, str], sql: str, ranges: Partitioning | None = None, fetch_size: int = 10_000) -> DataFrameReader:
    """A reader over a SELECT. With ``ranges`` the statement becomes a subquery that Spark reads range by range."""
    reader = spark.read.format("jdbc").options(**options).option("fetchsize", fetch_size).option("pushDownAggregate", True)
    if ranges is None:
        return reader.option("query", sql)
    return reader.option("dbtable", f"({sql}) AS extract").option("partitionColumn", ranges.column).option("lowerBound", ranges.lower) \
        .option("upperBound", ranges.upper).option("numPartitions", ranges.partitions)


def read_jdbc(spark: SparkSession, options: dict[str, str], sql: str, ranges: Partitioning | None = None) -> DataFrame:
    return jdbc_reader(spark, options, sql, ranges).load()


def bigquery_options(project: str, sql: str, dataset_for_results: str, credentials_file: str | None = None) -> dict[str, str]:
    """Options of the public BigQuery connector; results go through the Storage Read API."""
    options = {"parentProject": project, "query": sql, "viewsEnabled": "true", "materializationDataset": dataset_for_results}
    return options | ({"credentialsFile": credentials_file} if credentials_file else {})


def read_bigquery(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("bigquery").options(**options).load()
