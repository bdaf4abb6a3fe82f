"""Salary, projection and weekly-stat sources: explicit schemas in, contract columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header synonyms of a projection file, first match wins (compared in lower case).
PROJECTION_SYNONYMS: dict[str, list[str]] = {
    "name": ["name", "player", "playername", "full_name", "dk name", "dk_name", "name + id", "player name"],
    "pos": ["pos", "position", "roster position"],
    "proj_points": [
        "proj_points", "projection", "proj", "fpts", "points", "projected points", "projpts", "avgpointspergame",
        "avg_points_per_game",
    ],
    "team": ["team", "teamabbrev", "tm"],
    "opp": ["opp", "opponent", "opp_team", "opponentteam"],
    "player_id": ["player_id", "entity_id", "id"],
}
PROJECTION_REQUIRED = ("name", "pos", "proj_points")

# Salary headers in rising priority; the last one present supplies the column.
SALARY_OVERRIDES: dict[str, list[str]] = {
    "name": ["Name"],
    "pos": ["Position", "Roster Position"],
    "team": ["Team", "TeamAbbrev"],
    "salary": ["Salary"],
    "game_info": ["Game Info"],
}

# Alternatives for the salary headers the normaliser needs.
SALARY_REQUIRED: list[tuple[str, ...]] = [("Name",), ("TeamAbbrev",), ("Salary",), ("GameInfo", "Game Info")]

# Weekly-stat columns that are kept, and the names they get.
WEEKLY_COLUMNS = [
    "player_id", "player_name", "position", "recent_team", "opponent_team", "week", "season", "fantasy_points_ppr",
    "passing_yards", "rushing_yards", "receiving_yards", "rushing_tds", "receiving_tds", "passing_tds", "receptions",
    "targets", "sacks", "interceptions", "fumbles_lost", "sack_fumbles_lost", "rushing_fumbles_lost",
    "receiving_fumbles_lost", "special_teams_tds", "fantasy_points",
]
WEEKLY_RENAMES = {"recent_team": "team", "opponent_team": "opp", "position": "pos"}


class MissingColumns(ValueError):
    """A source lacks required columns; the message lists every one of them."""


def scan_text_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Header CSV read with an explicit all-text schema; typing happens in the projection that follows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a header CSV, all columns text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def scan_salaries(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Salary feed: Parquet when the path says so, otherwise text-typed CSV."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return scan_text_csv(spark, path, columns or csv_header(spark, path))


def require_columns(df: DataFrame, required: Sequence[tuple[str, ...]]) -> DataFrame:
    """Every entry is a tuple of alternatives, one of which must be present."""
    missing = [" or ".join(names) for names in required if not any(n in df.columns for n in names)]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def resolve_synonyms(
    df: DataFrame,
    synonyms: dict[str, list[str]] = PROJECTION_SYNONYMS,
    required: Sequence[str] = PROJECTION_REQUIRED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rename columns to the contract by case-insensitive header synonyms; the first synonym present wins."""
    by_lower = {c.lower(): c for c in df.columns}
    found = {
        target: next((by_lower[n] for n in names if n in by_lower), None) for target, names in synonyms.items()
    }
    missing = [f"{t} (any of {', '.join(synonyms[t])})" for t in required if found[t] is None]
    if missing:
        raise MissingColumns(f"missing columns: {'; '.join(missing)}")
    return df.select(*[F.col(c) for c in keep], *[F.col(f"`{s}`").alias(t) for t, s in found.items() if s])


def override_columns(
    df: DataFrame, overrides: dict[str, list[str]] = SALARY_OVERRIDES, keep: Sequence[str] = ()
) -> DataFrame:
    """Rename to the contract where a later source header beats an earlier one."""
    chosen = {t: [n for n in names if n in df.columns] for t, names in overrides.items()}
    return df.select(*[F.col(c) for c in keep], *[F.col(f"`{n[-1]}`").alias(t) for t, n in chosen.items() if n])


def scan_weekly(df: DataFrame, columns: Sequence[str] = WEEKLY_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Keep the listed columns that exist, rename them, drop rows without a position or points."""
    present = [c for c in columns if c in df.columns]
    weekly = df.select(*[F.col(c) for c in keep], *[F.col(c).alias(WEEKLY_RENAMES.get(c, c)) for c in present])
    return weekly.dropna(subset=["pos", "fantasy_points_ppr"])
