"""Normalised salaries to projected points."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.operators import features as W
from rosterlab.operators.audit import issues_report
from rosterlab.operators.keyed import latest_per_key
from rosterlab.operators.models import OUTPUT_COLUMNS, score_players
from rosterlab.operators.pool import salary_tier_join


def latest_features(history: DataFrame, name: str = "player_name") -> DataFrame:
    """Each player's most recent rolling features, by (name, pos)."""
    featured = W.rolling_features(history)
    newest = [F.col(c).desc() for c in ("season", "week", "seq")]
    return latest_per_key(featured, [name, "pos"], newest).select(F.col(name).alias("name"), "pos", *W.ROLLING_COLUMNS)


def project(
    salaries: DataFrame, models: dict[str, PipelineModel] | None = None, history: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(projections, issues).  Features come from the stat history, or from the salary tier where there is none."""
    tiered = W.dst_placeholders(salary_tier_join(salaries))
    if history is not None:
        recent = latest_features(history)
        real = recent.select("name", "pos", *[F.col(c).alias(f"_{c}") for c in W.ROLLING_COLUMNS if c in tiered.columns])
        joined = tiered.join(real, ["name", "pos"], "left")
        tiered = joined.select(*[
            F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in tiered.columns
        ])
    scored = score_players(tiered, models)
    kept = [c for c in ("slate_id", "id") if c in scored.columns]
    projections = scored.select(*kept, *OUTPUT_COLUMNS)
    return projections, issues_report(scored, salaries)
