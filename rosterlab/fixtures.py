"""Roster-shaped views over the driver's generic tables.

Every view is one SQL text that both Spark SQL and the checking engine accept; ``@EACH<n>@`` is the only
dialect token (it turns one row into n rows numbered 0..n-1).  Views are whole-table: nothing is filtered,
so the work of every registered query grows with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("part", "orders", "lineitem", "customer", "supplier", "nation", "events")

SLATE_SIZE = 250  # players per slate; the number of slates grows with the part table

# Team codes for the first nine brands, and one alternative spelling of each.
TEAM_CODES = {1: "JAX", 2: "WAS", 3: "LAR", 4: "LV", 5: "LAC", 6: "ARI", 7: "TB", 8: "GB", 9: "SF"}
TEAM_SPELLINGS = {1: "JAC", 2: "WSH", 3: "LA", 4: "OAK", 5: "SD", 6: "ARZ", 7: "TAM", 8: "GNB", 9: "SFO"}


def _team(number: str, codes: dict[int, str] = TEAM_CODES) -> str:
    names = ",".join(codes.get(n, "T" + chr(64 + n)) for n in range(1, 26))
    return f"split_part('{names}', ',', CAST({number} AS INT))"


def _opponent_number(number: str) -> str:
    return f"CASE WHEN {number} = 25 THEN NULL WHEN {number} % 2 = 1 THEN {number} + 1 ELSE {number} - 1 END"


def _digits(key: str) -> str:
    # 618033989 is coprime with 10^9, so distinct keys below 10^9 give distinct digit strings.
    return f"lpad(CAST(({key} * 618033989) % 1000000000 AS STRING), 9, '0')"


def _letters(key: str, position: int, alphabet: str) -> str:
    return f"translate(substr({_digits(key)}, {position}, 1), '0123456789', '{alphabet}')"


def first_name(key: str) -> str:
    return (
        f"upper({_letters(key, 1, 'bcdfghklmn')}) || {_letters(key, 2, 'aeiouyrsln')} || {_letters(key, 3, 'bcdfghklmn')}"
        f" || 'a' || {_letters(key, 4, 'bcdfghklmn')} || {_letters(key, 5, 'aeiouyrsln')} || {_letters(key, 6, 'bcdfghklmn')}"
    )


def last_name(key: str) -> str:
    return (
        f"upper({_letters(key, 7, 'bcdfghklmn')}) || 'o' || {_letters(key, 8, 'rstvwprstv')}"
        f" || 'e' || {_letters(key, 9, 'bcdfghklmn')}"
    )


SEGMENT_POSITION = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR'"
    " WHEN 'HOUSEHOLD' THEN 'TE' ELSE 'DST' END"
)

VIEWS: dict[str, str] = {
    "v_parts": f"""
        SELECT p_partkey, p_name, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no,
               CAST(floor(p_partkey / {SLATE_SIZE}) AS BIGINT) AS slate_id,
               CASE p_type WHEN 'ECONOMY' THEN 'QB' WHEN 'PROMO' THEN 'RB' WHEN 'LARGE' THEN 'WR'
                           WHEN 'MEDIUM' THEN 'WR' WHEN 'STANDARD' THEN 'TE' ELSE 'DST' END AS pos,
               CAST(2000 + 100 * ((p_partkey * 37) % 62) AS BIGINT) AS salary,
               CAST(CAST((p_partkey * 7919) % 3000 AS DECIMAL(12, 2)) / 100 AS DECIMAL(12, 2)) AS proj_points
        FROM part""",
    "v_pool": f"""
        SELECT slate_id, p_partkey AS player_id, p_name || ' ' || CAST(p_partkey AS STRING) AS name, pos,
               {_team('brand_no')} AS team,
               CASE WHEN brand_no = 25 THEN NULL ELSE {_team('(' + _opponent_number('brand_no') + ')')} END AS opp,
               salary, proj_points
        FROM v_parts""",
    "v_raw_salary": f"""
        SELECT slate_id, p_partkey AS file_seq, CAST(p_partkey AS STRING) AS id,
               CASE WHEN pos = 'DST' AND p_partkey % 2 = 0 THEN p_name || ' D/ST'
                    WHEN pos = 'DST' THEN p_name || ' Defense ' || CAST(p_partkey AS STRING)
                    WHEN p_partkey % 7 = 0 THEN p_name || ' ' || CAST(p_partkey AS STRING) || ' Jr.'
                    WHEN p_partkey % 11 = 0 THEN p_name || ' ' || CAST(p_partkey AS STRING) || ' III '
                    WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'é') || '-' || CAST(p_partkey AS STRING)
                    WHEN p_partkey % 5 = 0 THEN p_name || '  ' || CAST(p_partkey AS STRING) || ' '
                    ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS name_text,
               CASE WHEN p_partkey % 10 = 9 THEN NULL
                    WHEN pos = 'DST' AND p_partkey % 4 = 0 THEN 'D/ST'
                    WHEN p_partkey % 6 = 1 THEN lower(pos) || ' ' ELSE pos END AS position_text,
               CASE WHEN pos IN ('RB', 'WR', 'TE') THEN pos || '/FLEX' ELSE pos END AS roster_position,
               CASE WHEN p_partkey % 2 = 0 THEN {_team('brand_no', TEAM_SPELLINGS)}
                    WHEN p_partkey % 9 = 1 THEN lower({_team('brand_no')}) || ' '
                    ELSE {_team('brand_no')} END AS team_text,
               CASE WHEN p_partkey % 8 = 3 AND brand_no <> 25
                    THEN {_team('(' + _opponent_number('brand_no') + ')', TEAM_SPELLINGS)} END AS opponent_text,
               CASE WHEN brand_no = 25 THEN CASE WHEN p_partkey % 2 = 0 THEN 'TBD' END
                    WHEN p_partkey % 4 = 0 THEN away || '@' || home || ' 09/07/2025 01:00PM ET'
                    WHEN p_partkey % 4 = 1 THEN away || ' @ ' || home
                    WHEN p_partkey % 4 = 2 THEN away || '@' || home || ' 13/45/2025 01:00PM ET'
                    ELSE away || '@' || home || ' 10/12/2025 04:25PM ET' END AS game_text,
               CASE WHEN p_partkey % 29 = 0 THEN 'n/a' WHEN p_partkey % 31 = 0 THEN '0'
                    WHEN p_partkey % 37 = 0 THEN '-100' WHEN p_partkey % 41 = 0 THEN NULL
                    ELSE CAST(salary AS STRING) END AS salary_text
        FROM (SELECT *, {_team('(brand_no + brand_no % 2 - 1)', TEAM_SPELLINGS)} AS away,
                     {_team('(brand_no + brand_no % 2)', TEAM_SPELLINGS)} AS home
              FROM v_parts)""",
    "v_quality_pool": """
        SELECT slate_id, p_partkey AS player_id, p_name || ' ' || CAST(p_partkey AS STRING) AS name,
               CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE pos END AS pos,
               CASE WHEN p_partkey % 29 = 0 THEN 'n/a' WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(salary AS STRING) END AS salary,
               CASE WHEN p_partkey % 19 = 0 THEN 100001 + p_partkey ELSE 100000 + p_partkey END AS entity_id,
               CASE WHEN slate_id % 3 = 1 THEN proj_points WHEN p_partkey % 53 = 0 THEN NULL WHEN slate_id % 3 = 2 AND p_partkey % 5 = 0 THEN 0
                    WHEN p_partkey % 61 = 0 THEN -1 ELSE proj_points END AS proj_points
        FROM v_parts""",
    "v_crosswalk": f"""
        SELECT CASE WHEN p_partkey % 13 = 0 THEN 'other_site' ELSE 'draftkings' END AS source_name,
               CAST(p_partkey AS STRING) AS external_id,
               CASE WHEN p_partkey % 19 = 0 THEN 100001 + p_partkey ELSE 100000 + p_partkey END AS entity_id,
               p_name AS external_name, CAST(1.0 AS DOUBLE) AS confidence_score, p_partkey * 2 AS seq
        FROM v_parts
        UNION ALL
        SELECT CASE WHEN p_partkey % 17 = 0 THEN 'draftkings' ELSE 'nfl_api' END,
               CASE WHEN p_partkey % 17 = 0 THEN CAST(p_partkey AS STRING) ELSE '00-' || lpad(CAST(p_partkey AS STRING), 7, '0') END,
               100000 + p_partkey, p_name, CAST(0.9 AS DOUBLE), p_partkey * 2 + 1
        FROM v_parts""",
    "v_projection_feed": f"""
        SELECT floor_slate AS slate_id,
               CASE WHEN floor_slate % 4 = 3 OR l_partkey % 23 = 0 THEN NULL ELSE 100000 + l_partkey END AS player_id,
               l_partkey AS part_id, l_orderkey * 10 + l_linenumber AS feed_seq,
               CASE WHEN l_suppkey % 50 = 7 THEN 'n/a'
                    ELSE CAST(CAST(l_quantity AS INT) AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN '.25' ELSE '.5' END
               END AS points_text,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'OPP' END AS opp
        FROM (SELECT *, CAST(floor(l_partkey / {SLATE_SIZE}) AS BIGINT) AS floor_slate FROM lineitem)""",
    "v_slot_pool": """
        SELECT slate_id, pos, row_number() OVER (PARTITION BY slate_id, pos ORDER BY player_id) - 1 AS idx,
               count(*) OVER (PARTITION BY slate_id, pos) AS n,
               player_id, name, team, opp, salary, proj_points
        FROM v_pool""",
    "v_slot_counts": "SELECT slate_id, pos, count(*) AS n FROM v_pool GROUP BY slate_id, pos",
    "v_slates": f"SELECT CAST(floor(max(p_partkey) / {SLATE_SIZE}) AS BIGINT) + 1 AS n_slates FROM part",
    "v_lineup_slots": """
        SELECT o_custkey AS contest_id, o_orderkey AS lineup, o_custkey % n_slates AS slate_id,
               CASE k WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'RB' WHEN 3 THEN 'WR' WHEN 4 THEN 'WR'
                      WHEN 5 THEN 'WR' WHEN 6 THEN 'TE' WHEN 7 THEN 'FLEX' ELSE 'DST' END AS slot,
               CASE k WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'RB' WHEN 3 THEN 'WR' WHEN 4 THEN 'WR'
                      WHEN 5 THEN 'WR' WHEN 6 THEN 'TE' WHEN 8 THEN 'DST'
                      ELSE CASE o_orderkey % 3 WHEN 0 THEN 'RB' WHEN 1 THEN 'WR' ELSE 'TE' END END AS pos,
               CASE k WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2
                      WHEN 7 THEN CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END ELSE 0 END AS j, k
        FROM (SELECT o_custkey, o_orderkey, (SELECT n_slates FROM v_slates) AS n_slates, @EACH9@ AS k FROM orders)""",
    "v_lineups": """
        SELECT s.contest_id, s.lineup, s.slate_id, s.slot, p.pos, p.player_id, p.name, p.team, p.opp, p.salary, p.proj_points
        FROM (SELECT l.*, (l.lineup * 3 + l.j) % c.n AS idx
              FROM v_lineup_slots l JOIN v_slot_counts c ON l.slate_id = c.slate_id AND l.pos = c.pos) s
        JOIN v_slot_pool p ON s.slate_id = p.slate_id AND s.pos = p.pos AND s.idx = p.idx""",
    "v_broken_lineups": """
        SELECT contest_id, lineup, slate_id,
               CASE WHEN copy = 1 AND NOT (lineup % 7 = 2 AND slot = 'FLEX') THEN 'TOTAL'
                    WHEN copy = 1 THEN 'FLEX'
                    WHEN lineup % 7 = 1 AND slot = 'DST' THEN 'total'
                    WHEN lineup % 7 = 3 AND slot = 'FLEX' THEN 'WR'
                    WHEN lineup % 7 = 5 AND slot = 'DST' THEN 'WR'
                    WHEN lineup % 7 = 6 AND slot = 'TE' THEN 'BENCH' ELSE slot END AS slot,
               CASE WHEN lineup % 7 = 4 AND slot = 'FLEX' THEN 'QB'
                    WHEN lineup % 7 = 5 AND slot = 'DST' THEN 'WR' ELSE pos END AS pos,
               player_id, name, team, opp, CAST(salary AS STRING) AS salary, CAST(proj_points AS STRING) AS proj_points
        FROM (SELECT *, @EACH2@ AS copy FROM v_lineups)""",
    "v_weekly": """
        SELECT user_id AS player_id, CAST(2022 + floor((day(ts) - 1) / 10) AS BIGINT) AS season,
               CAST((day(ts) - 1) % 10 + 1 AS BIGINT) AS week, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'QB' WHEN 'view' THEN 'RB' WHEN 'purchase' THEN 'WR'
                    WHEN 'signup' THEN 'TE' ELSE CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'DST' END END AS pos,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS fantasy_points_ppr,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(k * 3 AS DOUBLE) END AS passing_yards,
               CAST(k * 2 AS DOUBLE) AS rushing_yards, CAST(k % 12 AS DOUBLE) AS targets,
               CAST(k % 9 AS DOUBLE) AS receptions, CAST(k AS DOUBLE) AS receiving_yards,
               CAST(k % 5 AS DOUBLE) AS sacks, CAST(k % 3 AS DOUBLE) AS interceptions,
               CAST(k % 2 AS DOUBLE) AS sack_fumbles_lost,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(k % 4 AS DOUBLE) END AS rushing_fumbles_lost,
               CAST((k + 1) % 2 AS DOUBLE) AS receiving_fumbles_lost,
               CAST(k % 6 AS DOUBLE) AS passing_tds, CAST(k % 7 AS DOUBLE) AS rushing_tds,
               CAST(k % 8 AS DOUBLE) AS receiving_tds, CAST(k % 2 AS DOUBLE) AS special_teams_tds
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "v_source_a": f"""
        SELECT 'A' || CAST(c_custkey AS STRING) AS a_id,
               CASE c_custkey % 6 WHEN 0 THEN first_name || ' ' || last_name
                    WHEN 1 THEN first_name || ' ' || last_name || ' Jr.'
                    WHEN 2 THEN upper(first_name) || ' ' || last_name
                    WHEN 3 THEN substr(first_name, 1, 1) || '. ' || last_name
                    WHEN 4 THEN replace(first_name, 'a', 'á') || ' ' || last_name || ' '
                    ELSE first_name || ' ' || substr(last_name, 1, 4) END AS name, pos, team, c_custkey AS seq
        FROM (SELECT c_custkey, {first_name('c_custkey')} AS first_name, {last_name('c_custkey')} AS last_name,
                     {SEGMENT_POSITION} AS pos, {_team('(c_nationkey + 1)')} AS team FROM customer)""",
    "v_source_b": f"""
        SELECT 'N' || CAST(c_custkey AS STRING) AS b_id, first_name || ' ' || last_name AS name, pos,
               CASE WHEN c_custkey % 9 = 0 THEN 'FA' ELSE team END AS team, c_custkey AS seq
        FROM (SELECT c_custkey,
                     CASE WHEN c_custkey % 11 = 0 THEN {first_name('(c_custkey + 1)')} ELSE {first_name('c_custkey')} END AS first_name,
                     {last_name('c_custkey')} AS last_name,
                     {SEGMENT_POSITION} AS pos, {_team('(c_nationkey + 1)')} AS team FROM customer)""",
    "v_players": f"""
        SELECT c_custkey + 1 AS id, {first_name('c_custkey')} || ' ' || {last_name('c_custkey')} AS canonical_name,
               {first_name('c_custkey')} AS first_name, {last_name('c_custkey')} AS last_name,
               {SEGMENT_POSITION} AS position, {_team('(c_nationkey + 1)')} AS team,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '00-' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS nfl_id,
               CAST(0 AS BIGINT) AS updated_seq
        FROM customer""",
    "v_external_ids": """
        SELECT id AS player_id, CASE WHEN j = 0 THEN 'draftkings' ELSE 'nfl_api' END AS source_name,
               CASE WHEN j = 0 THEN CAST(39000000 + id AS STRING) WHEN nfl_id IS NULL THEN 'X' || CAST(id AS STRING) ELSE nfl_id END AS external_id,
               canonical_name AS external_name,
               CASE WHEN j = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(id % 10 AS DOUBLE) / 10 END AS confidence_score
        FROM (SELECT *, @EACH2@ AS j FROM v_players)""",
    "v_aliases": """
        SELECT player_id, alias_name, CASE WHEN row_number() OVER (PARTITION BY alias_name, source_name ORDER BY player_id) = 1
               THEN source_name END AS source_name, confidence_score
        FROM (SELECT id AS player_id,
                     CASE j WHEN 0 THEN substr(first_name, 1, 1) || '.' || last_name WHEN 1 THEN upper(canonical_name)
                            ELSE last_name || ', ' || first_name END AS alias_name,
                     CASE j WHEN 0 THEN 'nfl_api' WHEN 1 THEN NULL ELSE 'draftkings' END AS source_name,
                     CASE j WHEN 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST((id + j) % 10 AS DOUBLE) / 10 END AS confidence_score
              FROM (SELECT *, @EACH3@ AS j FROM v_players))""",
    "v_player_batch": f"""
        SELECT first_name || ' ' || last_name AS canonical_name, first_name, last_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'QB' WHEN '2-HIGH' THEN 'RB' WHEN '3-MEDIUM' THEN 'WR'
                    WHEN '5-LOW' THEN 'TE' ELSE 'DST' END AS position,
               {_team('(o_orderkey % 25 + 1)')} AS team, CAST(o_orderkey AS STRING) AS nfl_id, o_orderkey AS seq, person
        FROM (SELECT *, {first_name('person')} AS first_name, {last_name('person')} AS last_name
              FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 500000000 ELSE o_custkey END AS person FROM orders))""",
    "v_id_requests": """
        SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 3 THEN 'nfl_api' ELSE 'draftkings' END AS source_name,
               CASE WHEN o_orderkey % 4 = 3 THEN '00-' || lpad(CAST(o_custkey AS STRING), 7, '0')
                    ELSE CAST(39000000 + o_custkey + o_orderkey % 3 AS STRING) END AS external_id
        FROM orders""",
    "v_name_requests": f"""
        SELECT o_orderkey AS request_id,
               CASE o_orderkey % 5 WHEN 0 THEN first_name || ' ' || last_name WHEN 1 THEN substr(first_name, 1, 1) || '.' || last_name
                    WHEN 2 THEN upper(first_name || ' ' || last_name) WHEN 3 THEN last_name || ', ' || first_name ELSE last_name END AS name,
               CASE o_orderkey % 3 WHEN 0 THEN 'draftkings' WHEN 1 THEN 'nfl_api' ELSE NULL END AS source_name
        FROM (SELECT o_orderkey, {first_name('o_custkey')} AS first_name, {last_name('o_custkey')} AS last_name FROM orders)""",
    "v_name_queries": f"""
        SELECT DISTINCT lower({last_name('s_suppkey')}) AS query FROM supplier""",
}

_DEPENDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)] for name, sql in VIEWS.items()}


def _closure(names: list[str], given: tuple[str, ...] = ()) -> list[str]:
    """The views behind ``names`` in the order of their use; ``given`` ones are tables already."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in given:
            return
        for dep in _DEPENDS[name]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _render(sql: str, dialect: str) -> str:
    spark_each, duck_each = r"explode(sequence(0, \1 - 1))", r"unnest(range(0, \1))"
    return re.sub(r"@EACH(\d+)@", spark_each if dialect == "spark" else duck_each, sql)


def with_views(body: str, dialect: str = "duckdb", given: tuple[str, ...] = ()) -> str:
    """Prefix ``body`` with the CTEs of every view it mentions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ",\n".join(f"{name} AS ({_render(VIEWS[name], dialect)})" for name in _closure(used, given))
    if not ctes:
        return body
    own = re.match(r"\s*WITH\s+", body)
    return f"WITH {ctes},\n{body[own.end():]}" if own else f"WITH {ctes}\n{body}"


ORDERS_A_TASK = 200_000

# Slot, position and running number within the position of a lineup's places; the FLEX's follow from the lineup's number.
PLACES = [
    ("QB", "QB", 0), ("RB", "RB", 0), ("RB", "RB", 1), ("WR", "WR", 0), ("WR", "WR", 1), ("WR", "WR", 2), ("TE", "TE", 0),
    ("FLEX", None, None), ("DST", "DST", 0),
]


def _lineups(spark: SparkSession) -> DataFrame:
    """The rows of v_lineups with one join row per order instead of one per order and place.

    A slate's players, at most SLATE_SIZE part keys, are one row with an array per position.
    """
    pool = spark.sql(with_views("SELECT * FROM v_slot_pool", "spark"))
    player = ("player_id", "name", "team", "opp", "salary", "proj_points")
    positions = sorted({p for _, p, _ in PLACES if p})
    slates = pool.groupBy("slate_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("pos") == p, F.struct("idx", *player)))).alias(f"_{p}") for p in positions]
    )
    orders = spark.sql(
        with_views("SELECT o_custkey AS contest_id, o_orderkey AS lineup, o_custkey % n_slates AS slate_id"
                   " FROM (SELECT *, (SELECT n_slates FROM v_slates) AS n_slates FROM orders)", "spark")
    )
    # The tasks follow from the orders, because nine wide rows come out of each narrow one.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-spark.table("orders").count() // ORDERS_A_TASK))
    held = orders.filter("contest_id IS NOT NULL").repartition(tasks, "slate_id").join(slates, "slate_id")

    def pick(position: str, j: int) -> Column:
        n = F.size(f"_{position}")
        return F.when(n > 0, F.get(f"_{position}", ((F.col("lineup") * 3 + j) % n).cast("int")))

    turn = F.col("lineup") % 3
    flex = F.when(turn == 0, pick("RB", 2)).when(turn == 1, pick("WR", 3)).otherwise(pick("TE", 1))
    flex_position = F.when(turn == 0, F.lit("RB")).when(turn == 1, F.lit("WR")).otherwise(F.lit("TE"))
    places = F.array(*[flex if position is None else pick(position, j) for _, position, j in PLACES])
    rows = held.select("contest_id", "lineup", "slate_id", F.posexplode(places).alias("_k", "_p")).filter("_p IS NOT NULL")
    named = lambda names: F.get(F.array(*[F.lit(n) for n in names]), F.col("_k"))
    return rows.select(
        "contest_id", "lineup", "slate_id", named([slot for slot, _, _ in PLACES]).alias("slot"),
        F.coalesce(named([position for _, position, _ in PLACES]), flex_position).alias("pos"), *[f"_p.{c}" for c in player],
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame over the tables in ``sf_dir``."""
    needed = " ".join(VIEWS[v] for v in _closure([name]))
    for table in BASE_TABLES:
        if re.search(rf"\b{table}\b", needed):
            spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").createOrReplaceTempView(table)
    if "v_lineups" not in _closure([name]):
        return spark.sql(with_views(f"SELECT * FROM {name}", "spark"))
    _lineups(spark).createOrReplaceTempView("v_lineups")
    return spark.sql(with_views(f"SELECT * FROM {name}", "spark", given=("v_lineups",)))
