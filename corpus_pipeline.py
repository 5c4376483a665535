"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing and packing, each stage on all its predecessor kept."""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import lines, mixing, packing, similarity, toxicity
from gaugeline.llm.common import Scratch
from gaugeline.sources.tables import load


BATCH = 1000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidied(stage: Stage) -> Stage:
    """Let the driver give up what the stages before have left: plans, broadcasts and shuffles that nothing refers to any more.

    Texts go to Python in batches of ``BATCH`` rows, as workers keep the memory of their largest batch for later stages.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gc.collect()
        spark._jvm.System.gc()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)
    return run_stage


@_tidied
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean_documents(docs, load(spark, sf_dir, "labels"))


@_tidied
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first occurrence stays; documents that lose all they said go."""
    return lines.deduplicated_lines(docs)


@_tidied
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return similarity.first_of_each_group(docs)


@_tidied
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


@_tidied
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_duplicates),
          ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

#: SQL cannot express the classifier, the edit distances or the search; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again before the next stage."""
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if k:
                scratch.release(before)
    return docs
