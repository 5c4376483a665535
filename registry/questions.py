"""The demo question set: one small grouped answer per question, in the long form (question, group_value, answer)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gaugeline.session import cut_lineage


def demo_answers(ev: DataFrame, ex: DataFrame, fu: DataFrame) -> DataFrame:
    # One row per user and day feeds every question about users; the questions then read far fewer rows.
    per_day = ev.groupBy("user_id", "date", "platform", "user_segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.sum("error_rate").alias("e"), F.sum("click_share").alias("c"))
    # Both reductions are read by several answers, so each is written out once.
    per_user = cut_lineage(per_day.groupBy("user_id", "platform", "user_segment").agg(
        *[F.sum(c).alias(c) for c in ("n", "v", "e", "c")]))
    arms = ex.select("user_id", "variant").distinct()
    by_arm = per_user.join(arms, "user_id").groupBy("variant").agg(
        F.avg((F.col("e") > 0).cast("double")).alias("share"), (F.sum("v") / F.sum("n")).alias("value"))
    dau = cut_lineage(per_day.groupBy("date", "platform").agg(F.count(F.lit(1)).alias("dau")))
    steps = fu.groupBy("user_id", "step").agg(F.max("completed").alias("done"))
    users = steps.groupBy("user_id").agg(F.max(F.when(F.col("step") == "purchase", F.col("done")).otherwise(0)).alias("bought"))
    segments = per_user.groupBy("user_segment").agg((F.sum("v") / F.sum("n")).alias("value"), (F.sum("e") / F.sum("n")).alias("errors"))

    def answer(name: str, df: DataFrame, value, group=None) -> DataFrame:
        return df.select(F.lit(name).alias("question"), (F.col(group).cast("string") if group else F.lit("")).alias("group_value"),
                         value.cast("double").alias("answer"))

    total = lambda df, expr: df.agg(expr.alias("a"))
    parts = [
        answer("count_events", total(per_user, F.sum("n")), F.col("a")),
        answer("variant_counts", arms.groupBy("variant").count(), F.col("count"), "variant"),
        answer("avg_dau", total(dau.groupBy("date").agg(F.sum("dau").alias("d")), F.avg("d")), F.col("a")),
        answer("dau_by_platform", dau.groupBy("platform").agg(F.sum("dau").alias("a")), F.col("a"), "platform"),
        answer("share_with_error_by_variant", by_arm, F.col("share"), "variant"),
        answer("funnel_steps", steps.groupBy("step").agg(F.sum("done").alias("a")), F.col("a"), "step"),
        answer("purchase_rate", total(users, F.avg("bought")), F.col("a")),
        answer("users_with_a_click", total(per_user, F.count_if(F.col("c") > 0)), F.col("a")),
        answer("value_by_segment", segments, F.col("value"), "user_segment"),
        answer("value_by_variant", by_arm, F.col("value"), "variant"),
        answer("assignments_by_week", ex.groupBy("week").count(), F.col("count"), "week"),
        answer("error_rate_by_segment", segments, F.col("errors"), "user_segment"),
        answer("first_seen_by_platform", per_user.groupBy("platform").count(), F.col("count"), "platform"),
    ]
    return reduce(DataFrame.unionByName, parts)
