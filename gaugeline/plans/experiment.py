"""The experiment plan: extract -> cells -> results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.operators import abtest, moments
from gaugeline.session import cut_lineage
from gaugeline.spec import ExperimentSpec


def experiment_start(experiment: DataFrame, spec: ExperimentSpec, like: DataFrame) -> Column:
    """First assignment date. A literal from the spec reaches the scan; otherwise a one-row scalar subquery."""
    date_type = like.schema[spec.date_col].dataType
    if spec.experiment_start:
        return F.lit(spec.experiment_start).cast(date_type)
    first = experiment.agg(F.min(spec.assignment_date_col).cast(date_type).alias("start"))
    return first.scalar()


def _aggregate(kind: str, column: str) -> Column:
    if kind == "count":
        return F.count(F.lit(1)).cast("double")
    value = F.col(column).cast("double")
    return F.sum(value) if kind == "sum" else F.avg(value)


def experiment_extract(events: DataFrame, experiment: DataFrame, spec: ExperimentSpec,
                       week_from: str = "date", last_week: int | None = None) -> DataFrame:
    """User-level experiment rows: metric, pre-period covariate, guardrails and segments.

    Both sides of the date cut are aggregated per user before any join, so a user with very many
    events is combined on the map side and joins as one row. ``week_from='date'`` puts every event in
    its own week; ``week_from='assignment'`` repeats the whole period for every assigned week. Events of all weeks
    from the start on take part; ``last_week`` leaves out what comes after that week.
    """
    user, date = spec.user_id_col, spec.date_col
    start = experiment_start(experiment, spec, events)
    segments = list(spec.segment_cols)
    keys = [user, *segments]
    after = events.where(F.col(date) >= start)
    if week_from == "date":
        week = F.floor(F.date_diff(F.col(date).cast("date"), start.cast("date")) / 7) + 1
        if last_week is not None:
            # a bound on the date column itself, so the scan can skip what lies beyond
            after = after.where(F.col(date) < F.date_add(start.cast("date"), 7 * last_week).cast(events.schema[date].dataType))
        after = after.withColumn(spec.week_col, week.cast("int"))
        keys.append(spec.week_col)
    during = after.groupBy(*keys).agg(
        _aggregate(spec.metric_agg, spec.metric_source_col).alias(spec.primary_metric),
        *[F.avg(F.col(g).cast("double")).alias(g) for g in spec.extra_guardrails])
    before = events.where(F.col(date) < start).groupBy(user).agg(
        _aggregate(spec.metric_agg, spec.covariate_source_col).alias(spec.covariate))
    arms = [F.col(user), F.col(spec.variant_col).alias("variant")]
    if week_from == "assignment":
        arms.append(F.col(spec.week_col))
    assigned = experiment.select(*arms).distinct()
    joined = during.join(assigned, user).join(before, user, "left")
    return joined.select(user, "variant", spec.week_col, spec.primary_metric,
                         F.coalesce(F.col(spec.covariate), F.lit(0.0)).alias(spec.covariate),
                         *spec.extra_guardrails, *segments)


def text_date_extract_cut(events: DataFrame, experiment: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Events from the first assignment on, compared as text so that ``2023-01`` style dates work."""
    start = experiment.agg(F.min(spec.assignment_date_col).cast("string").alias("start")).scalar()
    return events.where(F.col(spec.date_col).cast("string") >= start)


def experiment_cells(extract: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The only pass over the extract. The cells are a few hundred rows; they are written out once, so every
    statistic that follows reads them and not the extract. Raises where an arm is missing."""
    spec.validate_extract(extract)
    metrics = list(dict.fromkeys([spec.primary_metric, *[g for g in spec.guardrail_metrics if g in extract.columns]]))
    keys = ["variant", *[c for c in (spec.week_col, *spec.segment_cols) if c in extract.columns]]
    cells = cut_lineage(moments.cell_moments(extract, keys, metrics, spec.primary_metric, spec.covariate))
    abtest.require_arms(cells)
    return cells


def cuped_result(cells: DataFrame, spec: ExperimentSpec) -> DataFrame | None:
    """CUPED of the primary metric; None where the covariate is the metric itself, which would explain everything."""
    return None if spec.covariate == spec.primary_metric else abtest.cuped(moments.joint_moments(cells))


def flagship(events: DataFrame, experiment: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Did the treatment move the metric? Welch test and CUPED on one row."""
    cells = experiment_cells(experiment_extract(events, experiment, spec), spec)
    test = abtest.welch_test(moments.long_moments(cells, ["variant"], [spec.primary_metric]), ["metric"])
    adjusted = abtest.cuped(moments.joint_moments(cells)).withColumn("metric", F.lit(spec.primary_metric))
    return test.join(adjusted.drop("status"), "metric")


def funnel_extract(funnel: DataFrame, experiment: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Funnel rows with their arm. Only week 1 of the assignment joins, so two-row assignments do not fan out.

    Steps are reduced to one row per user and step before the join.
    """
    user = spec.user_id_col
    arms = experiment.where(F.col(spec.week_col) == 1).select(user, F.col(spec.variant_col).alias("variant"))
    steps = funnel.groupBy(user, "step").agg(F.max(F.col("completed").cast("int")).alias("completed"))
    return steps.join(arms, user).select(user, "variant", "step", "completed")


def variant_readout(events: DataFrame, experiment: DataFrame, spec: ExperimentSpec, metrics: list[str]) -> DataFrame:
    """Event totals per arm: totals per user first, then the arm label, then the arm totals."""
    user = spec.user_id_col
    per_user = events.groupBy(user).agg(F.count(F.lit(1)).alias("events"),
                                        *[F.sum(F.col(m).cast("double")).alias(m) for m in metrics])
    arms = experiment.select(user, F.col(spec.variant_col).alias("variant")).distinct()
    return per_user.join(arms, user).groupBy("variant").agg(
        F.count(F.lit(1)).alias("users"), F.sum("events").alias("events"), *[F.sum(m).alias(m) for m in metrics])


def where_equal(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Keep rows that match every given column value."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"segment filter columns not found: {missing}")
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items()], F.lit(True)))
