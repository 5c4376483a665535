"""Continuous forms of the event-rate and spend counters with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeline.operators.spend import GLOBAL_SCOPE, scope_of


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_rates(stream: DataFrame, key: str, at: str = "ts", window: str = "300 seconds", slide: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Events per key in sliding windows; a window is final once the watermark passes it."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    counted = timed.groupBy(F.window(at, window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events")


def spend_by_day(stream: DataFrame, at: str = "ts", user: str = "user_id", ip: str = "ip", amount: str = "usd", lateness: str = "1 hour") -> DataFrame:
    """Spend per UTC day and scope, and of everyone. Caps are put on finished rows with :func:`spend.against_caps`."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).where(F.col(amount) > 0).withWatermark(at, lateness)
    scoped = timed.withColumn("scope", F.explode(F.array(scope_of(F.col(user), F.col(ip)), F.lit(GLOBAL_SCOPE))))
    spent = scoped.groupBy(F.window(at, "1 day").alias("w"), "scope").agg(
        F.sum(amount).alias("spent"), F.count(F.lit(1)).alias("records"))
    return spent.select(F.to_date("w.start").alias("day"), "scope", "spent", "records")


def run_to_parquet(result: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is available and stop, with every changed window in ``out``, also those that are still open.

    Update mode: a batch writes only the windows it touched, into its own ``batch=`` folder, and the watermark drops the state of
    windows that are final. A repeated batch overwrites its folder, so a restart leaves no row twice. Read with :func:`latest`.
    """
    q = result.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row of every key among the updates that :func:`run_to_parquet` wrote."""
    updates = spark.read.parquet(out)
    values = [c for c in updates.columns if c not in keys and c != "batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, *[f"v.{c}" for c in values])


def compact(spark: SparkSession, out: str, keys: list[str], into: str) -> None:
    """The newest rows as one table, for readers that look often; ``out`` stays as it is."""
    latest(spark, out, keys).write.mode("overwrite").parquet(into)
