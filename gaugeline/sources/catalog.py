"""SQL over registered views, catalog listings, table profiles and schema comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from gaugeline.session import prepare

MAX_MATERIALISED_ROWS = 5_000_000
COLUMNS_PER_PASS = 6


class ResultTooLargeError(ValueError):
    """A result is larger than may be brought to the driver. It is refused, never cut off."""

    def __init__(self, rows: int, ceiling: int) -> None:
        self.rows, self.ceiling = rows, ceiling
        super().__init__(f"Result has {rows:,} rows, above the {ceiling:,}-row ceiling. Aggregate to the unit of analysis first.")


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Any read-only statement Spark SQL supports, as a lazy DataFrame."""
    first = sql.lstrip().split(None, 1)[0].lower() if sql.strip() else ""
    if first not in ("select", "with"):
        raise ValueError("Only SELECT/WITH queries are permitted")
    return prepare(spark).sql(sql)


def count_rows(spark: SparkSession, sql: str) -> int:
    return run_sql(spark, sql).count()


def collect_guarded(df: DataFrame, ceiling: int = MAX_MATERIALISED_ROWS) -> list:
    """Rows on the driver, or an error with the true row count when there are more than ``ceiling``. 0 turns the check off."""
    if ceiling > 0 and df.limit(ceiling + 1).count() > ceiling:
        raise ResultTooLargeError(df.count(), ceiling)
    return df.collect()


def list_tables(spark: SparkSession, schemas: list[str] | None = None, home: str | None = None) -> DataFrame:
    """Tables and views: bare names in the home schema, ``schema.name`` elsewhere; names with a dot are always qualified."""
    home = home or spark.catalog.currentDatabase()
    wanted = schemas or [home]
    rows = []
    for schema in sorted(wanted, key=lambda s: (s != home, s)):
        for t in spark.catalog.listTables(schema):
            qualified = schema != home or "." in t.name
            rows.append((schema, f"{schema}.{t.name}" if qualified and not t.isTemporary else t.name, t.tableType))
    return spark.createDataFrame(rows, "schema string, name string, kind string")


def list_schemas(spark: SparkSession, home: str | None = None) -> list[str]:
    """User schemas: home first, then alphabetical."""
    home = home or spark.catalog.currentDatabase()
    hidden = {"information_schema", "pg_catalog", "sys", "mysql", "performance_schema"}
    return sorted((d.name for d in spark.catalog.listDatabases() if d.name not in hidden), key=lambda s: (s != home, s))


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Ordered ``(table, position, column, type)`` of the given tables, from their schemas (no job)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def _as_text(df: DataFrame) -> DataFrame:
    """All columns in long form ``(column, value)`` as text."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value"))
                      for f in df.schema.fields])
    return df.select(F.explode(pairs).alias("r")).select("r.*")


def table_profile(df: DataFrame, table: str, max_distinct: int = 50, max_samples: int = 5) -> DataFrame:
    """Per column: rows, exact distinct count, and the first values in text order when there are few.

    An approximate count picks the columns worth sampling; only those are unpivoted, and the exact count decides.
    Columns are counted a few at a time; a pass reads only its own columns.
    """
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    listed, few = None, {}
    for at in range(0, len(fields), COLUMNS_PER_PASS):
        part = list(enumerate(fields))[at:at + COLUMNS_PER_PASS]
        facts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(f"`{f.name}`").alias(f.name) for _, f in part])
        rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                  F.col(f"`{f.name}`").alias("n_distinct")) for i, f in part])
        piece = facts.select("rows", F.explode(rows).alias("r")).select(F.lit(table).alias("table"), "r.*", F.col("rows").alias("n_rows"))
        listed = piece if listed is None else listed.unionByName(piece)
        few |= df.agg(*[F.approx_count_distinct(f"`{f.name}`").alias(f.name) for _, f in part]).first().asDict()
    likely = [f.name for f in fields if few[f.name] <= 2 * max_distinct]
    if not likely:
        return listed.withColumn("samples", F.lit(None).cast("string"))
    values = _as_text(df.select(*[f"`{c}`" for c in likely])).where("value IS NOT NULL").distinct()
    order = W.partitionBy("column").orderBy("value")
    first = values.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_samples)
    samples = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("samples"))
    return listed.join(samples, "column", "left").select(
        "table", "position", "column", "type", "n_rows", "n_distinct", F.when(F.col("n_distinct") <= max_distinct, F.col("samples")).alias("samples"))


def sample_values(df: DataFrame, column: str, max_distinct: int = 50, max_show: int = 10) -> DataFrame:
    """Up to ``max_show`` distinct values in text order; empty when the column has more than ``max_distinct``."""
    listed = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(max_distinct + 1)
    numbered = listed.withColumns({"_n": F.count(F.lit(1)).over(W.partitionBy(F.lit(1))), "_rn": F.row_number().over(W.orderBy("value"))})
    return numbered.where((F.col("_n") <= max_distinct) & (F.col("_rn") <= max_show)).select("value")


def annotated_catalog(profile: DataFrame, annotations: DataFrame) -> DataFrame:
    """Column list with a comment: the given annotation, else a note from the profile."""
    note = F.concat_ws("  ", F.concat(F.format_number("n_distinct", 0), F.lit(" distinct")), F.concat(F.lit("e.g. "), F.col("samples")))
    notes = annotations.select("table", "column", F.col("comment").alias("_given"))
    return profile.join(notes, ["table", "column"], "left").select(
        "table", "position", "column", "type", F.coalesce(F.nullif("_given", F.lit("")), note).alias("comment"))


def schema_hash(catalog: DataFrame) -> DataFrame:
    """Short stable hash per table over its ordered columns and types."""
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "column", "type").alias("line"))))
    text = F.array_join(F.transform(lines, lambda s: s["line"]), "\n")
    return catalog.groupBy("table").agg(F.substring(F.sha2(text, 256), 1, 16).alias("schema_hash"))


def dataset_fingerprint(source: str, pack: str = "", version: str = "", schema: str = ""):
    """Column expression: hash of the data source identity, metric pack and schema."""
    text = f"{source or 'demo'}|pack={pack}|v={version}|schema={schema}"
    return F.substring(F.sha2(F.lit(text), 256), 1, 32)


def fingerprint_columns(source, pack, version, schema):
    """The same fingerprint over columns of a table."""
    text = F.concat(F.coalesce(F.nullif(source, F.lit("")), F.lit("demo")), F.lit("|pack="), F.coalesce(pack, F.lit("")), F.lit("|v="),
                    F.coalesce(version.cast("string"), F.lit("")), F.lit("|schema="), F.coalesce(schema, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 32)


def snapshot(catalog: DataFrame, connection: str, taken_at: str) -> DataFrame:
    """Catalog rows stamped for the snapshot table."""
    return catalog.withColumns({"connection_id": F.lit(connection), "snapshot_ts": F.lit(taken_at).cast("timestamp")})


def append_snapshot(catalog: DataFrame, connection: str, taken_at: str, folder: str) -> None:
    """Add a snapshot to the table in ``folder``; earlier ones stay. Taking the same one again replaces it."""
    rows = snapshot(catalog, connection, taken_at).withColumn("day", F.date_format("snapshot_ts", "yyyyMMddHHmmss"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("connection_id", "day").parquet(folder)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("day").withColumn("connection_id", F.col("connection_id").cast("string"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each connection."""
    newest = snapshots.groupBy("connection_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return snapshots.join(newest, ["connection_id", "snapshot_ts"], "left_semi")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two catalogs."""
    old = before.select("table", "column", F.col("type").alias("old_type"))
    new = after.select("table", "column", F.col("type").alias("new_type"))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed") \
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    return old.join(new, ["table", "column"], "full_outer").withColumn("change", change).where("change IS NOT NULL")


def schema_drift(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Expected ``(table, column)`` rows the live catalog lacks.

    A missing table is one finding; a column counts as missing only when its table exists and no table has it.
    """
    live = catalog.select(F.lower("table").alias("table"), F.lower("column").alias("column"))
    want = expected.select(F.lower("table").alias("table"), F.lower("column").alias("column"))
    no_table = want.select("table").distinct().join(live.select("table").distinct(), "table", "left_anti")
    known = want.where("column IS NOT NULL").join(no_table, "table", "left_anti")
    no_column = known.join(live.select("column").distinct(), "column", "left_anti")
    return no_table.select("table", F.lit("").alias("column"), F.lit("missing table").alias("finding")) \
        .unionByName(no_column.select("table", "column", F.lit("missing column").alias("finding")))
