"""File round trips: each query writes what it is given and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.catalog import lineups as _lineups  # noqa: F401  (its SQL checks the reports)
from rosterlab.catalog.registry import ORACLES, register
from rosterlab.fixtures import view
from rosterlab.operators import lineups as L
from rosterlab.operators.identity import IdentityTables
from rosterlab.session import placed_joins, scratch_path
from rosterlab.sources import identity_store as I
from rosterlab.sources import lineups as S

_SQL_LINEUPS = "SELECT contest_id, lineup, slate_id, slot, player_id, salary FROM v_lineups"


@register("write_lineups", _SQL_LINEUPS)
def write_lineups(spark, d):
    path = scratch_path(spark, "lineups")
    S.write_lineups(view(spark, d, "v_lineups"), path)
    return spark.read.parquet(path).select("contest_id", "lineup", F.col("slate_id").cast("bigint").alias("slate_id"), "slot", "player_id", "salary")


@register(
    "scan_lineup_files",
    "SELECT slate_id AS lineup, name, pos, team, CAST(salary AS DOUBLE) AS salary, CAST(proj_points AS DOUBLE) AS proj_points, CAST(lineup AS VARCHAR) AS lineup_k FROM v_lineups",
)
def scan_lineup_files(spark, d):
    """One file set per slate; the number comes from the folder name through the same reader."""
    path = scratch_path(spark, "files")
    rows = view(spark, d, "v_lineups").select("slate_id", "name", "pos", "team", "salary", "proj_points", F.col("lineup").alias("lineup_k"))
    S.write_lineups(rows.withColumnRenamed("slate_id", "lineup_file"), path, fmt="csv", partition_by=("lineup_file",))
    files = S.scan_lineup_files(spark, f"{path}/lineup_file=*", number=r"lineup_file=(\d+)", part="file_path")
    return files.select("lineup", *S.LINEUP_FILE_COLUMNS)


def _as_text(name: str, frame):
    """Rows of one table as (table, values)."""
    return frame.select(F.lit(name).alias("tab"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in frame.columns]).alias("row"))


def _sql_text(name: str, columns: tuple[str, ...], source: str) -> str:
    return f"SELECT '{name}' AS tab, concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), chr(126))' for c in columns)}) AS row FROM {source}"


_REPORTS = {
    "player_exposure": ("contest_id", "name", "pos", "team", "appearances"),
    "team_exposure": ("contest_id", "team", "total_exposure"),
    "stacks": ("contest_id", "lineup", "stack_no", "qb", "qb_team", "receivers", "stack_size"),
    "validation_report": ("contest_id", "lineup", "n_errors", "errors"),
}
_REPORT_SOURCES = {
    "player_exposure": "player_exposure", "team_exposure": "team_exposure", "stacks": "stack_sequence", "validation_report": "validate_lineups",
}


@register("write_reports", " UNION ALL ".join(_sql_text(n, _REPORTS[n], f"({ORACLES[q]})") for n, q in _REPORT_SOURCES.items()))
def write_reports(spark, d):
    """All four reports written and read back, every row of each; the verdicts are those of the lineups with faults."""
    rows = view(spark, d, "v_lineups")
    within = L.contest_columns(rows, "slate_id")
    reports = {
        "player_exposure": L.player_exposure(rows, within), "team_exposure": L.team_exposure(rows), "stacks": L.stack_sequence(rows, within),
        "validation_report": L.validate_lineups(L.drop_total_rows(view(spark, d, "v_broken_lineups"))),
    }
    with placed_joins(spark):
        written = S.write_reports(reports, scratch_path(spark, "reports"))
    read = {n: S.scan_lineup_table(spark, path) for n, path in written.items() if n != "validation_report"}
    # the verdicts hold a list and are JSON lines
    verdicts = spark.read.schema("contest_id bigint, lineup bigint, errors array<string>, n_errors bigint").json(written["validation_report"])
    read["validation_report"] = verdicts.withColumn("errors", F.array_join("errors", "; "))
    return reduce(DataFrame.union, [_as_text(n, read[n].select(*_REPORTS[n])) for n in _REPORTS])


def _tables(spark, d):
    return IdentityTables(view(spark, d, "v_players"), view(spark, d, "v_external_ids"), view(spark, d, "v_aliases"))


_PLAYER = ("canonical_name", "first_name", "last_name", "position", "team", "nfl_id")
_EXTERNAL, _ALIAS = ("source_name", "external_id", "external_name", "confidence_score"), ("alias_name", "source_name", "confidence_score")
_SQL_TABLES = " UNION ALL ".join([
    _sql_text("players", ("id", *_PLAYER), "v_players"), _sql_text("external_ids", ("player_id", *_EXTERNAL), "v_external_ids"), _sql_text("aliases", ("player_id", *_ALIAS), "v_aliases"),
])


@register("export_identity", _SQL_TABLES)
def export_identity(spark, d):
    """All three tables as CSV, read back."""
    path = scratch_path(spark, "identity")
    written = I.export_identity(_tables(spark, d), path, fmt="csv")
    read = {n: spark.read.schema(schema).option("header", True).csv(written[n]) for n, schema in I.FILES.items()}
    players, ids, aliases = read["players_master"].select("id", *_PLAYER), read["external_ids"].select("player_id", *_EXTERNAL), read["aliases"].select("player_id", *_ALIAS)
    return _as_text("players", players).union(_as_text("external_ids", ids)).union(_as_text("aliases", aliases))


_SQL_OWNED = " UNION ALL ".join([
    _sql_text("players", _PLAYER, "v_players"),
    _sql_text("external_ids", ("canonical_name", *(f"e.{c}" for c in _EXTERNAL)), "v_players p JOIN v_external_ids e ON e.player_id = p.id"),
    _sql_text("aliases", ("canonical_name", *(f"a.{c}" for c in _ALIAS)), "v_players p JOIN v_aliases a ON a.player_id = p.id"),
])


@register("import_identity", _SQL_OWNED)
def import_identity(spark, d):
    """All three tables exported and loaded again; ids and aliases under their player's name, as loading may number anew."""
    path = scratch_path(spark, "identity")
    I.export_identity(_tables(spark, d), path)
    loaded = I.import_identity(spark, path)
    owner = loaded.players.select(F.col("id").alias("player_id"), "canonical_name")
    ids = loaded.external_ids.join(owner, "player_id").select("canonical_name", *_EXTERNAL)
    aliases = loaded.aliases.join(owner, "player_id").select("canonical_name", *_ALIAS)
    return _as_text("players", loaded.players.select(*_PLAYER)).union(_as_text("external_ids", ids)).union(_as_text("aliases", aliases))
