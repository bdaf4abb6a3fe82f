"""Weekly stats to saved models and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rosterlab.operators import features as W
from rosterlab.operators import models as M
from rosterlab.sources.salaries import scan_weekly


def weekly_features(weekly: DataFrame, keep: Sequence[str] = ("seq",), **layout) -> DataFrame:
    """Rolling means of every stat that exists, and of the column sums whose addends all exist."""
    rows = scan_weekly(weekly, keep=keep)
    sums = {f: cs for f, cs in W.ROLLING_SUMS.items() if set(cs) <= set(rows.columns)}
    featured = W.rolling_features(rows, **layout)
    return W.rolling_sums_of_columns(featured, sums, **layout) if sums else featured


def train(weekly: DataFrame, path: str | None = None, keys: Sequence[str] = ("player_id", "seq"), **options) -> tuple[dict, DataFrame | None, DataFrame]:
    """(models by position, metrics, gate report); models are saved when a path is given."""
    features = weekly_features(weekly)
    models, predictions = M.train_position_models(features, list(keys), **options)
    if path is not None:
        M.save_models(models, path)
    return models, None if predictions is None else M.model_metrics(predictions), M.min_rows_gate(features)
