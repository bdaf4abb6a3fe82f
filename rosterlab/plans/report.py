"""All reports of finished lineups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.operators import lineups as L
from rosterlab.sources.lineups import write_reports
from rosterlab.sources.salaries import require_columns

REQUIRED = [("lineup",), ("slot",), ("name",), ("pos",), ("team",), ("salary",), ("proj_points",)]


def lineup_report(lineups: DataFrame, cap: int = C.SALARY_CAP) -> dict[str, DataFrame]:
    """Exposure, team exposure, stacks, validation summary and the violations behind it.

    Rows without a contest count as one contest; rows without a player id are identified by name.
    """
    require_columns(lineups, REQUIRED)
    rows = L.drop_total_rows(lineups)
    if "contest_id" not in rows.columns:
        rows = rows.withColumn("contest_id", F.lit(0).cast("bigint"))
    if "player_id" not in rows.columns:
        rows = rows.withColumn("player_id", F.col("name"))
    if "opp" not in rows.columns:
        rows = rows.withColumn("opp", F.lit(None).cast("string"))
    return {
        "player_exposure": L.player_exposure(rows).orderBy(F.col("appearances").desc(), "name"),
        "team_exposure": L.team_position_exposure(rows).orderBy(F.col("appearances").desc(), "team", "pos"),
        "stacks": L.bring_back(rows).orderBy("contest_id", "lineup"),
        "validation_report": L.validation_summary(rows, cap),
        "validation_errors": L.validation_errors(rows, cap),
    }


def write_lineup_report(lineups: DataFrame, path: str, cap: int = C.SALARY_CAP) -> dict[str, str]:
    return write_reports(lineup_report(lineups, cap), path)
