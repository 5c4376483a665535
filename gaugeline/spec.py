"""The experiment configuration: which columns play which role."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame

DIRECTIONS = ("higher_is_better", "lower_is_better")
AGGREGATES = ("mean", "sum", "count")


@dataclass(frozen=True)
class ExperimentSpec:
    primary_metric: str
    covariate: str
    metric_direction: str = "higher_is_better"
    metric_source_col: str = ""
    covariate_source_col: str = ""
    metric_agg: str = "mean"
    guardrail_metrics: tuple[str, ...] = ()
    segment_cols: tuple[str, ...] = ()
    funnel_steps: tuple[str, ...] = ()
    events_table: str = "events"
    experiment_table: str = "experiment"
    timeseries_table: str | None = None
    funnel_table: str | None = None
    user_id_col: str = "user_id"
    date_col: str = "date"
    variant_col: str = "variant"
    week_col: str = "week"
    assignment_date_col: str = "assignment_date"
    experiment_start: str | None = None
    experiment_weeks: int = 2
    revenue_per_unit: float = 0.50
    baseline_unit_count: int = 500_000
    guardrail_harm_directions: dict[str, str] = field(default_factory=dict)
    joins: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        for name in ("primary_metric", "covariate", "events_table", "experiment_table",
                     "user_id_col", "date_col", "variant_col", "week_col"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"{name} must be a non-empty string, got {value!r}")
            object.__setattr__(self, name, value.strip())
        for name in ("guardrail_metrics", "segment_cols"):
            values = tuple(getattr(self, name))
            if any(not isinstance(v, str) or not v.strip() for v in values):
                raise ValueError(f"{name} must hold non-empty strings, got {values!r}")
            object.__setattr__(self, name, tuple(v.strip() for v in values))
        if self.metric_direction not in DIRECTIONS:
            raise ValueError(f"metric_direction must be one of {DIRECTIONS}")
        if self.metric_agg not in AGGREGATES:
            raise ValueError(f"metric_agg must be one of {AGGREGATES}")
        if not self.metric_source_col.strip():
            object.__setattr__(self, "metric_source_col", self.primary_metric)
        if not self.covariate_source_col.strip():
            object.__setattr__(self, "covariate_source_col", self.covariate)

    @classmethod
    def from_dict(cls, raw: dict) -> "ExperimentSpec":
        """Build from a parsed JSON configuration; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and v is not None}
        return cls(**kept)

    @property
    def alternative(self) -> str:
        """Test direction implied by the metric direction."""
        return "greater" if self.metric_direction == "higher_is_better" else "less"

    @property
    def default_harm_direction(self) -> str:
        return "decrease" if self.metric_direction == "higher_is_better" else "increase"

    @property
    def extra_guardrails(self) -> tuple[str, ...]:
        """Guardrails that are not already present as metric, source or covariate."""
        taken = {self.primary_metric, self.metric_source_col, self.covariate}
        return tuple(g for g in self.guardrail_metrics if g not in taken)

    def validate_extract(self, extract: DataFrame) -> None:
        """The columns every test needs must exist in the extract (schema only, no job)."""
        missing = [c for c in (self.primary_metric, self.covariate, self.variant_col) if c not in extract.columns]
        if missing:
            raise ValueError(f"Missing columns in extract: {missing}")
