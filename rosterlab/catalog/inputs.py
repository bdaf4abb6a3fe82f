"""Inputs the registered queries share, as DataFrames and as checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.fixtures import view
from rosterlab.functions import names as N
from rosterlab.operators.normalise import coerce_projections, normalise_salaries, valid_salaries


def raw_salaries(spark: SparkSession, d: str) -> DataFrame:
    """The messy salary feed under the headers a salary file has."""
    headers = {
        "name_text": "Name", "position_text": "Position", "roster_position": "Roster Position", "team_text": "TeamAbbrev",
        "opponent_text": "Opponent", "game_text": "GameInfo", "salary_text": "Salary",
    }
    return view(spark, d, "v_raw_salary").withColumnsRenamed(headers)


def salary_table(spark: SparkSession, d: str) -> DataFrame:
    """Normalised rows with a usable salary and one of the five positions."""
    rows = normalise_salaries(raw_salaries(spark, d), keep=("slate_id", "file_seq", "id"))
    return valid_salaries(rows.withColumn("pos", N.canon_position(F.col("pos")))).withColumn(
        "salary", F.col("salary").cast("bigint")
    )


def projection_feed(spark: SparkSession, d: str) -> DataFrame:
    """Projection updates; the name is the salary feed's own name of the player."""
    feed = view(spark, d, "v_projection_feed").withColumnRenamed("points_text", "proj_points")
    names = salary_table(spark, d).select(F.col("file_seq").alias("part_id"), "name", "pos", "team")
    return coerce_projections(feed).join(names, "part_id")


def sql_team(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in C.TEAM_ALIASES.items())
    return f"CASE upper(trim({x})) {cases} ELSE upper(trim({x})) END"


def sql_name_key(x: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^A-Za-z0-9 ]', '', 'g')),"
        r" '\b(jr|sr|ii|iii|iv)\b', '', 'g'), ' +', ' ', 'g'))"
    )


_PAIR = r"'\b([A-Z]{2,3})\s*@\s*([A-Z]{2,3})\b'"

SQL_NORMALISED = rf"""
    SELECT slate_id, file_seq, id, name, pos, team,
           coalesce(opponent, CASE WHEN team = away THEN home WHEN team = home THEN away END) AS opp,
           team = home AS is_home, CAST(TRY_CAST(salary_text AS DOUBLE) AS BIGINT) AS salary, game_date, home, away,
           {sql_name_key('name')} AS name_key,
           len(list_intersect(string_split_regex(lower(regexp_replace(name, '[^A-Za-z ]', '', 'g')), ' +'), ['dst', 'def', 'defense'])) > 0 AS is_dst
    FROM (SELECT *, trim(name_text) AS name,
                 coalesce(upper(trim(position_text)), upper(trim(split_part(roster_position, '/', 1)))) AS pos,
                 {sql_team('team_text')} AS team, {sql_team('opponent_text')} AS opponent,
                 {sql_team('away_text')} AS away, {sql_team('home_text')} AS home,
                 CASE WHEN away_text IS NOT NULL
                      THEN CAST(try_strptime(nullif(regexp_extract(game_text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), ''), '%m/%d/%Y') AS DATE) END AS game_date
          FROM (SELECT *, nullif(regexp_extract(game_text, {_PAIR}, 1), '') AS away_text,
                       nullif(regexp_extract(game_text, {_PAIR}, 2), '') AS home_text FROM v_raw_salary))"""

SQL_SALARIES = f"""
    SELECT * REPLACE (CASE WHEN split_part(pos, '/', 1) IN ('DEF', 'D', 'D/ST') THEN 'DST' ELSE split_part(pos, '/', 1) END AS pos)
    FROM ({SQL_NORMALISED}) WHERE salary > 0"""

SQL_FEED = f"""
    SELECT f.slate_id, f.player_id, f.part_id, f.feed_seq, TRY_CAST(f.points_text AS DOUBLE) AS proj_points, f.opp, s.name, s.pos, s.team
    FROM v_projection_feed f JOIN ({SQL_SALARIES}) s ON s.file_seq = f.part_id
    WHERE TRY_CAST(f.points_text AS DOUBLE) IS NOT NULL"""
