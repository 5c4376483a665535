"""Helpers of this subpackage: shared scratch tables, safe columns, connected groups."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gaugeline.session import checkpoint_dir

#: a word of the shingle and size contracts: a run of characters that are no ASCII white space
WORD_BREAK = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables as Parquet in the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts the lineage, survives lost executors and is compressed. ``release`` deletes what is no
    longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0
        self.held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, lean: bool = False) -> DataFrame:
        """``df``, written and read again. ``lean``: files of its shuffles are deleted as soon as it is written."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        before = self.spark.conf.get(CLEANUP)
        try:
            self.spark.conf.set(CLEANUP, "true" if lean else before)
            df.write.parquet(path, compression="zstd")
        finally:
            self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((kept, path))
        return kept

    def release(self, *tables: DataFrame) -> None:
        """Delete tables that no plan reads any more."""
        gone = [h for h in self.held if any(h[0] is t for t in tables)]
        self.held = [h for h in self.held if not any(h[0] is t for t in tables)]
        for _, path in gone:
            self._delete(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Keep the result and delete all that it was made from."""
        done = self.keep(df)
        self.release(*[t for t, _ in self.held if t is not done])
        return done

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under names of our own: clashing extra columns of the input never get in the way.

    Each value is ``column`` or ``column:type``.
    """
    out = []
    for name, spec in wanted.items():
        column, _, kind = spec.partition(":")
        c = F.col(f"`{column}`")
        out.append((c.cast(kind) if kind else c).alias(name))
    return df.select(*out)


def text_mb(df: DataFrame, column: str = "text") -> float:
    """Megabytes of a text column, measured: the optimiser has no usable size for joined, local or checkpointed tables."""
    return (df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0) / 1e6


def parts_for(df: DataFrame, mb: float, column: str = "text") -> int:
    """So many partitions that each holds about ``mb`` of the text column, at least as many as there are cores."""
    return int(max(df.sparkSession.sparkContext.defaultParallelism, text_mb(df, column) / mb + 1))


def ranked(df: DataFrame, scratch: Scratch, order: list[Column], name: str, rows_a_part: int = 1_000_000) -> DataFrame:
    """``df`` with a long column ``name``: 1, 2, 3… over all rows in the given order.

    The rows are dealt out by range and numbered within their range; only the row counts of the ranges are summed up
    in one task. Rows that are equal in ``order`` get different numbers.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows_a_part + 1)
    dealt = scratch.keep(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").count()
    before = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # one row per range
    return dealt.withColumn(name, here).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def tree_sum(chunks: DataFrame, dtype: str, deflated: bool = False) -> DataFrame:
    """Sum binary vectors by chunk number: columns chunk int, values binary (little-endian ``dtype``, deflated or not); 64-bit sums."""
    import numpy as np
    import pandas as pd

    def add(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, values in zip(frame["chunk"], frame["values"]):
                v = np.frombuffer(zlib.decompress(values) if deflated else values, dtype=dtype).astype("<i8")
                total[chunk] = total[chunk] + v if chunk in total else v
        if total:
            yield pd.DataFrame({"chunk": list(total), "values": [v.tobytes() for v in total.values()]})

    # a hashed repartition sends each chunk number to one task; a task folds its rows as they arrive
    return chunks.repartition("chunk").mapInPandas(add, "chunk int, values binary")


def connected(links: DataFrame, ident: str = "long") -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that links reach.

    Alternating large and small stars; each round is an aggregate and a join, cut by ``checkpoint``. A hub that
    holds most links is combined before the shuffle and its join side is split by adaptive execution.
    """
    spark = links.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    a, b = F.col("a"), F.col("b")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct().checkpoint()

    def facts(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum((F.xxhash64("a", "b") % 1_000_003))).first()

    before = facts(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("u"), F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(low, a == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("u"), "m")
        small = (large.join(small_low, a == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .union(small_low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        edges = small.checkpoint()
        now = facts(edges)
        if now == before:
            break
        before = now
    top = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(a.alias("id"), b.alias("component")).union(top).groupBy("id").agg(F.min("component").alias("component"))
