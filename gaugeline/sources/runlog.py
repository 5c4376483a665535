"""The run log as an append-only parquet table; updates produce a new version of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.operators.history import apply_updates


def new_runs(df: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Stamp rows with an id, the current time, and overrides as JSON text."""
    text = F.lit(json.dumps(overrides)) if overrides else F.lit(None).cast("string")
    return df.withColumns({"run_id": F.uuid(), "ts": F.current_timestamp(), "analyst_override": text})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rewrite(runs: DataFrame, updates: DataFrame, folder: str, key: str = "run_id") -> str:
    """Write the updated table next to the old version and return its path."""
    path = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    apply_updates(runs, updates, key).write.parquet(path)
    return path
