"""Conditional conversion funnel: step k is measured among users who completed step k-1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gaugeline.functions import tails
from gaugeline.functions.numbers import POSITIVE_INFINITY, ratio
from gaugeline.plans.experiment import where_equal

DEFAULT_STEPS = ("impression", "click", "install", "d1_retain")


def present_steps(df: DataFrame, candidates: list[str]) -> list[str]:
    """The candidate steps that occur, in the given order. Collects at most one row per candidate."""
    found = {r[0] for r in df.where(F.col("step").isin(*candidates)).select("step").distinct().collect()}
    return [s for s in candidates if s in found]


def user_steps(df: DataFrame, steps: list[str], user: str = "user_id", variant: str = "variant") -> DataFrame:
    """One row per user and arm with a 0/1 column ``s0…`` per step."""
    done = F.col("completed").cast("int")
    return df.groupBy(user, variant).agg(*[
        F.max(F.when(F.col("step") == s, F.coalesce(done, F.lit(0))).otherwise(0)).alias(f"s{i}")
        for i, s in enumerate(steps)])


def arm_steps(df: DataFrame, steps: list[str], user: str = "user_id", variant: str = "variant") -> DataFrame:
    """Eligible and completed users per step and arm."""
    eligible = [F.lit(True)] + [F.col(f"s{i}") == 1 for i in range(len(steps) - 1)]
    aggs = []
    for i in range(len(steps)):
        aggs += [F.count_if(eligible[i]).alias(f"e{i}"), F.sum(F.when(eligible[i], F.col(f"s{i}")).otherwise(0)).alias(f"c{i}")]
    wide = user_steps(df, steps, user, variant).groupBy(variant).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(s).alias("step"), F.col(f"e{i}").alias("eligible"),
                              F.col(f"c{i}").alias("completed")) for i, s in enumerate(steps)])
    return wide.select(F.col(variant).alias("variant"), F.explode(rows).alias("r")).select("variant", "r.*")


def funnel_of_present_steps(df: DataFrame, candidates: list[str] | tuple[str, ...] = DEFAULT_STEPS, **options) -> DataFrame | None:
    """The funnel over those candidate steps that occur; None if fewer than two do."""
    steps = present_steps(df, list(candidates))
    return conditional_funnel(df, steps, **options) if len(steps) >= 2 else None


def conditional_funnel(df: DataFrame, steps: list[str] | tuple[str, ...] = DEFAULT_STEPS, alpha: float = 0.05,
                       user: str = "user_id", variant: str = "variant",
                       segment_filter: dict[str, object] | None = None, check_steps: bool = True) -> DataFrame:
    """One row per step: rates per arm, change, two-proportion z-test, and whether it is the biggest drop-off.

    Steps that do not occur in ``df`` raise; ``check_steps=False`` saves the job that looks.
    """
    if check_steps:
        there = present_steps(df, list(steps))
        unknown = [s for s in steps if s not in there]
        if unknown:
            raise ValueError(f"steps not found: {unknown}")
    if segment_filter:
        df = where_equal(df, segment_filter)
    per_arm = arm_steps(df, list(steps), user, variant)
    arm = lambda a, c: F.sum(F.when(F.col("variant") == a, F.col(c)))
    g = per_arm.groupBy("step_index", "step").agg(
        arm("control", "eligible").alias("n_control"), arm("treatment", "eligible").alias("n_treatment"),
        arm("control", "completed").alias("done_control"), arm("treatment", "completed").alias("done_treatment"))
    n_c, n_t = F.col("n_control"), F.col("n_treatment")
    g = g.withColumns({
        "status": F.when(n_c.isNull() | n_t.isNull(), "missing arm").when((n_c < 2) | (n_t < 2), "too few eligible users")
                   .otherwise("ok"),
        "control_rate": ratio(F.col("done_control"), n_c), "treatment_rate": ratio(F.col("done_treatment"), n_t),
        "pooled": ratio(F.col("done_control") + F.col("done_treatment"), n_c + n_t),
    })
    g = g.withColumns({
        "delta": F.col("treatment_rate") - F.col("control_rate"),
        "se": F.sqrt(F.col("pooled") * (1 - F.col("pooled")) * (ratio(F.lit(1.0), n_c) + ratio(F.lit(1.0), n_t))),
    })
    g = g.withColumns({
        "pct_change": F.when(F.col("control_rate") == 0, F.lit(POSITIVE_INFINITY))
                       .otherwise(ratio(F.col("delta"), F.col("control_rate")) * 100),
        "z_stat": ratio(F.col("delta"), F.col("se"), 0.0),
    }).withColumn("p_value", F.when(F.col("se") == 0, 1.0).otherwise(tails.z_two_sided(F.col("z_stat"))))
    biggest = W.partitionBy(F.lit(1)).orderBy(F.abs("delta").desc(), "step_index")
    return g.select("step_index", "step", "status", "n_control", "n_treatment", "control_rate", "treatment_rate", "delta",
                    "pct_change", "z_stat", "p_value", (F.col("p_value") < alpha).alias("significant"),
                    (F.row_number().over(biggest) == 1).alias("biggest_dropoff"))
