"""Raw salary feed to the eleven-column contract, and projection coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import names as N
from rosterlab.functions import values as V
from rosterlab.sources.salaries import SALARY_REQUIRED, MissingColumns, require_columns


def normalise_salaries(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """name, pos, team, opp, is_home, salary, game_date, home, away, name_key, is_dst (plus ``keep``).

    Team, opponent, away and home codes are all canonicalised; a missing opponent is derived from the game.
    """
    require_columns(raw, SALARY_REQUIRED)
    if not {"Position", "Roster Position"} & set(raw.columns):
        raise MissingColumns("missing columns: Position or Roster Position")

    def column(name: str):
        return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")

    game = column("GameInfo") if "GameInfo" in raw.columns else column("Game Info")
    parsed = raw.select(
        *[F.col(c) for c in keep],
        F.trim(column("Name")).alias("name"),
        N.pick_position(column("Position"), column("Roster Position")).alias("pos"),
        N.canon_team(column("TeamAbbrev")).alias("team"),
        N.canon_team(column("Opponent")).alias("_opponent"),
        column("Salary").alias("salary"),
        N.game_date(game).alias("game_date"),
        N.canon_team(N.game_home(game)).alias("home"),
        N.canon_team(N.game_away(game)).alias("away"),
    )
    return parsed.select(
        *[F.col(c) for c in keep],
        "name",
        "pos",
        "team",
        N.derive_opponent(F.col("_opponent"), F.col("team"), F.col("away"), F.col("home")).alias("opp"),
        N.is_home(F.col("team"), F.col("home")).alias("is_home"),
        V.to_number(F.col("salary")).cast("bigint").alias("salary"),
        "game_date",
        "home",
        "away",
        N.name_key(F.col("name")).alias("name_key"),
        N.is_defense(F.col("name")).alias("is_dst"),
    )


def coerce_projections(projections: DataFrame, points: str = "proj_points") -> DataFrame:
    """Numeric points; rows whose points do not parse are dropped."""
    return projections.withColumn(points, V.to_number(F.col(points))).filter(F.col(points).isNotNull())


def valid_salaries(salaries: DataFrame, salary: str = "salary") -> DataFrame:
    """Numeric positive salaries only."""
    return salaries.withColumn(salary, V.to_number(F.col(salary))).filter(V.valid_salary(F.col(salary)))


def min_salary_filter(pool: DataFrame, floor: int) -> DataFrame:
    """Players at or above a per-player salary floor."""
    return pool.filter(F.col("salary") >= floor) if floor > 0 else pool


def union_positions(scored: dict[str, DataFrame], empty: DataFrame) -> DataFrame:
    """Per-position outputs as one table; without any output the typed empty table."""
    result = empty.filter(F.lit(False))
    for pos in ("QB", "RB", "WR", "TE", "DST"):
        if pos in scored:
            result = result.unionByName(scored[pos])
    return result
