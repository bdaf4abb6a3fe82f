"""The three identity tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.operators.identity import (
    IdentityTables, upsert_aliases, upsert_external_ids, upsert_players,
)

PLAYERS = (
    "id bigint, canonical_name string, first_name string, last_name string, position string, team string, nfl_id string, updated_seq bigint"
)
EXTERNAL_IDS = (
    "player_id bigint, source_name string, external_id string, external_name string, confidence_score double"
)
ALIASES = "player_id bigint, alias_name string, source_name string, confidence_score double"
FILES = {"players_master": PLAYERS, "external_ids": EXTERNAL_IDS, "aliases": ALIASES}


def _columns(name: str) -> list[str]:
    return [field.split()[0] for field in FILES[name].split(", ")]


def empty_tables(spark: SparkSession) -> IdentityTables:
    return IdentityTables(*[spark.createDataFrame([], schema) for schema in FILES.values()])


def export_identity(tables: IdentityTables, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write the tables under ``path``; returns where each one is."""
    frames = dict(zip(FILES, (tables.players, tables.external_ids, tables.aliases), strict=True))
    written = {}
    for name, frame in frames.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = frame.select(*_columns(name)).write.mode("overwrite")
        writer.option("header", True).csv(target) if fmt == "csv" else writer.parquet(target)
        written[name] = target
    return written


def _read(spark: SparkSession, path: str, name: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(FILES[name])
    target = f"{path.rstrip('/')}/{name}"
    return reader.option("header", True).csv(target) if fmt == "csv" else reader.parquet(target)


def import_identity(spark: SparkSession, path: str, into: IdentityTables | None = None, fmt: str = "parquet") -> IdentityTables:
    """Reload exported tables through the upserts.

    Players get the ids of the receiving store; ids and aliases follow their player by its canonical name.
    """
    store = into or empty_tables(spark)
    players = _read(spark, path, "players_master", fmt)
    merged = upsert_players(store.players, players.withColumn("seq", F.coalesce("updated_seq", F.lit(0))).drop("id"))
    moved = players.select(F.col("id").alias("player_id"), "canonical_name").join(
        merged.select(F.col("id").alias("_id"), "canonical_name"), "canonical_name"
    ).select("player_id", "_id")

    def follow(rows: DataFrame) -> DataFrame:
        columns = rows.columns
        return rows.join(moved, "player_id").withColumn("player_id", F.col("_id")).select(*columns, F.col("_id").alias("seq"))

    return IdentityTables(
        merged,
        upsert_external_ids(store.external_ids, follow(_read(spark, path, "external_ids", fmt))),
        upsert_aliases(store.aliases, follow(_read(spark, path, "aliases", fmt))),
    )
