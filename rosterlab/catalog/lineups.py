"""Finished-lineup reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlab.catalog.registry import register
from rosterlab.fixtures import view
from rosterlab.operators import lineups as L

REQUESTED = 20

_CLEAN = """(SELECT contest_id, lineup, slate_id, slot, pos, player_id, name, team, opp, CAST(TRY_CAST(salary AS DOUBLE) AS BIGINT) AS salary,
                    CAST(proj_points AS DECIMAL(18, 4)) AS proj_points FROM v_broken_lineups WHERE upper(slot) <> 'TOTAL')"""


def _lineups(spark, d):
    return view(spark, d, "v_lineups")


def _clean(spark, d):
    return L.drop_total_rows(view(spark, d, "v_broken_lineups"))


@register("drop_total_rows", f"SELECT contest_id, lineup, slot, player_id, salary, CAST(proj_points AS DOUBLE) AS proj_points FROM {_CLEAN}")
def drop_total_rows(spark, d):
    return _clean(spark, d).select("contest_id", "lineup", "slot", "player_id", "salary", F.col("proj_points").cast("double").alias("proj_points"))


@register(
    "total_rows",
    """SELECT contest_id, lineup, slot, name, pos, team, salary, CAST(proj_points AS DOUBLE) AS proj_points FROM v_lineups
       UNION ALL SELECT contest_id, lineup, 'TOTAL', NULL, NULL, NULL, CAST(sum(salary) AS BIGINT), CAST(sum(proj_points) AS DOUBLE)
       FROM v_lineups GROUP BY 1, 2""",
)
def total_rows(spark, d):
    return L.total_rows(_lineups(spark, d)).withColumn("proj_points", F.col("proj_points").cast("double"))


@register(
    "lineup_totals",
    """SELECT contest_id, lineup, CAST(sum(salary) AS BIGINT) AS total_salary, CAST(sum(proj_points) AS DOUBLE) AS total_points,
              round(avg(CAST(proj_points AS DOUBLE) / (salary / 1000.0::DOUBLE)), 4) AS mean_value, CAST(50000 - sum(salary) AS BIGINT) AS remaining,
              round(CAST(sum(proj_points) AS DOUBLE) / (sum(salary) / 1000.0::DOUBLE), 4) AS value
       FROM v_lineups GROUP BY 1, 2""",
)
def lineup_totals(spark, d):
    totals = L.lineup_totals(_lineups(spark, d))
    return totals.withColumns({
        "total_points": F.col("total_points").cast("double"), "mean_value": F.round("mean_value", 4), "value": F.round("value", 4),
    })


@register(
    "player_exposure",
    """WITH n AS (SELECT contest_id, count(DISTINCT lineup) AS n FROM v_lineups GROUP BY 1)
       SELECT l.contest_id, name, pos, team, count(*) AS appearances, floor((count(*) * 20000 + n) / (2 * n)) / 100 AS exposure_pct,
              floor((sum(salary)::BIGINT * 200 + count(*)) / (2 * count(*))) / 100 AS avg_salary,
              floor((CAST(sum(proj_points) * 1000 AS BIGINT) * 2 + count(*)) / (2 * count(*))) / 1000 AS avg_proj
       FROM v_lineups l JOIN n ON n.contest_id = l.contest_id GROUP BY l.contest_id, name, pos, team, n""",
)
def player_exposure(spark, d):
    return L.player_exposure(_lineups(spark, d))


@register(
    "player_exposure_requested",
    f"""SELECT contest_id, name, pos, team, count(*) AS exposure_count, count(*)::DOUBLE / {REQUESTED}::DOUBLE * 100::DOUBLE AS exposure_pct
        FROM v_lineups GROUP BY 1, 2, 3, 4""",
)
def player_exposure_requested(spark, d):
    return L.player_exposure_requested(_lineups(spark, d), REQUESTED)


@register("team_exposure", "SELECT contest_id, team, count(*) AS total_exposure FROM v_lineups GROUP BY 1, 2")
def team_exposure(spark, d):
    return L.team_exposure(_lineups(spark, d))


@register(
    "team_position_exposure",
    """WITH n AS (SELECT contest_id, count(DISTINCT lineup) AS n FROM v_lineups GROUP BY 1)
       SELECT l.contest_id, team, pos, count(*) AS appearances, floor((count(*) * 20000 + n) / (2 * n)) / 100 AS exposure_pct
       FROM v_lineups l JOIN n ON n.contest_id = l.contest_id GROUP BY l.contest_id, team, pos, n""",
)
def team_position_exposure(spark, d):
    return L.team_position_exposure(_lineups(spark, d))


@register(
    "exposure_alerts",
    """WITH n AS (SELECT contest_id, count(DISTINCT lineup) AS n FROM v_lineups GROUP BY 1),
            c AS (SELECT contest_id, player_id, name, count(*) AS exposure_count FROM v_lineups GROUP BY 1, 2, 3),
            j AS (SELECT c.*, greatest(1, CAST(floor(n * 0.35::DOUBLE) AS BIGINT)) AS limit_count FROM c JOIN n ON n.contest_id = c.contest_id)
       SELECT *, exposure_count >= limit_count AS at_limit FROM j WHERE exposure_count >= limit_count * 0.8""",
)
def exposure_alerts(spark, d):
    return L.exposure_alerts(_lineups(spark, d))


@register(
    "top_exposure",
    """SELECT player_id, name, exposure_count, round(exposure_count * 100.0::DOUBLE / (SELECT count(*) FROM orders), 4) AS exposure_pct
       FROM (SELECT player_id, name, count(*) AS exposure_count FROM v_lineups GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
)
def top_exposure(spark, d):
    requested = spark.read.parquet(f"{d}/orders.parquet").agg(F.count("*")).scalar()
    return L.top_exposure(_lineups(spark, d), requested)


_NEEDS = ("QB", 1), ("RB", 2), ("WR", 3), ("TE", 1), ("DST", 1)
_MINIMUM_ERRORS = ", ".join(f"CASE WHEN n_{p} < {n} THEN 'Needs at least {n} {p}, has ' || n_{p} END" for p, n in _NEEDS)
_SQL_ERRORS = f"""
    counts AS (SELECT contest_id, lineup, count(*) AS n, sum(salary)::BIGINT AS s,
                      {", ".join(f"count(*) FILTER (pos = '{p}') AS n_{p}" for p, _ in _NEEDS)},
                      count(*) FILTER (upper(slot) = 'FLEX') AS f, max(pos) FILTER (upper(slot) = 'FLEX') AS fp
               FROM {_CLEAN} GROUP BY 1, 2),
    verdicts AS (SELECT contest_id, lineup, CASE WHEN n <> 9 THEN ['Expected 9 players, got ' || n] ELSE list_filter([
                   CASE WHEN s > 50000 THEN 'Salary ' || s || ' exceeds cap 50000' END, {_MINIMUM_ERRORS},
                   CASE WHEN f <> 1 THEN 'Expected exactly 1 FLEX, found ' || f WHEN fp NOT IN ('RB', 'WR', 'TE') THEN 'FLEX must be RB/WR/TE, got ' || fp END],
                   lambda x: x IS NOT NULL) END AS errors FROM counts)"""


@register(
    "validate_lineups",
    f"WITH {_SQL_ERRORS} SELECT contest_id, lineup, array_to_string(errors, '; ') AS errors, len(errors) AS n_errors FROM verdicts",
)
def validate_lineups(spark, d):
    return L.validate_lineups(_clean(spark, d)).withColumn("errors", F.array_join("errors", "; "))


@register(
    "validation_errors",
    f"""WITH {_SQL_ERRORS} SELECT contest_id, lineup, CAST(unnest(range(0, len(errors))) AS INT) AS error_no, unnest(errors) AS error FROM verdicts""",
)
def validation_errors(spark, d):
    return L.validation_errors(_clean(spark, d))


_SLOT_CHECKS = " ".join(f"WHEN s_{p} <> {n} THEN 'Need {n} {p}, found ' || s_{p}" for p, n in _NEEDS)


@register(
    "check_slots",
    f"""SELECT contest_id, lineup, CASE WHEN n <> 9 THEN 'Expected 9 rows, got ' || n WHEN bad > 0 THEN 'Invalid slot(s)' {_SLOT_CHECKS}
               WHEN s_FLEX <> 1 THEN 'Need 1 FLEX, found ' || s_FLEX WHEN badflex > 0 THEN 'FLEX must be RB/WR/TE'
               WHEN total > 50000 THEN 'Salary cap exceeded: ' || total || ' > 50000' ELSE 'OK' END AS result
        FROM (SELECT contest_id, lineup, count(*) AS n, sum(salary)::BIGINT AS total,
                     {", ".join(f"count(*) FILTER (slot = '{p}') AS s_{p}" for p in ("QB", "RB", "WR", "TE", "DST", "FLEX"))},
                     count(*) FILTER (slot NOT IN ('QB', 'RB', 'WR', 'TE', 'DST', 'FLEX')) AS bad,
                     count(*) FILTER (slot = 'FLEX' AND pos NOT IN ('RB', 'WR', 'TE')) AS badflex
              FROM {_CLEAN} GROUP BY 1, 2)""",
)
def check_slots(spark, d):
    return L.check_slots(_clean(spark, d))


_SQL_PAIRS = """
    ids AS (SELECT DISTINCT contest_id, lineup FROM v_lineups),
    members AS (SELECT DISTINCT contest_id, lineup, player_id FROM v_lineups),
    pairs AS (SELECT a.contest_id, a.lineup AS la, b.lineup AS lb,
                     (SELECT count(*) FROM members x JOIN members y ON x.player_id = y.player_id
                      WHERE x.contest_id = a.contest_id AND x.lineup = a.lineup AND y.contest_id = b.contest_id AND y.lineup = b.lineup) AS shared
              FROM ids a JOIN ids b ON a.contest_id = b.contest_id AND a.lineup < b.lineup),
    overlap AS (SELECT c.contest_id, coalesce(min(shared), 0) AS min_pair_overlap, coalesce(18 - 2 * max(shared), 9) AS min_pair_uniques
                FROM (SELECT DISTINCT contest_id FROM ids) c LEFT JOIN pairs p ON p.contest_id = c.contest_id GROUP BY 1),
    worst AS (SELECT contest_id, la AS worst_a, lb AS worst_b FROM pairs QUALIFY row_number() OVER (PARTITION BY contest_id ORDER BY shared, la, lb) = 1)"""


@register(
    "lineup_overlap",
    f"WITH {_SQL_PAIRS} SELECT contest_id, shared, count(*) AS pairs, 18 - 2 * shared AS uniques FROM pairs GROUP BY 1, 2",
)
def lineup_overlap(spark, d):
    return L.lineup_overlap(_lineups(spark, d))


@register(
    "overlap_summary",
    f"""WITH {_SQL_PAIRS} SELECT o.contest_id, min_pair_overlap, min_pair_uniques, w.worst_a, w.worst_b
        FROM overlap o LEFT JOIN worst w ON w.contest_id = o.contest_id""",
)
def overlap_summary(spark, d):
    return L.overlap_summary(_lineups(spark, d))


@register(
    "validation_summary",
    f"""WITH {_SQL_PAIRS.replace('v_lineups', _CLEAN)}, {_SQL_ERRORS},
        v AS (SELECT contest_id, count(*) AS total_lineups, count(*) FILTER (len(errors) > 0) AS lineups_with_errors,
                     list((coalesce(CAST(lineup AS VARCHAR), 'null'), errors) ORDER BY lineup) FILTER (len(errors) > 0) AS wrong FROM verdicts GROUP BY 1)
        SELECT v.contest_id, total_lineups, lineups_with_errors, coalesce(CAST(to_json(map_from_entries(wrong)) AS VARCHAR), '{{}}') AS errors,
               CAST(to_json(struct_pack(min_pair_overlap := min_pair_overlap, min_pair_uniques := min_pair_uniques, worst_a := w.worst_a, worst_b := w.worst_b)) AS VARCHAR) AS pairwise_uniqueness,
               min_pair_overlap, min_pair_uniques, w.worst_a, w.worst_b
        FROM v JOIN overlap o ON o.contest_id = v.contest_id LEFT JOIN worst w ON w.contest_id = v.contest_id""",
)
def validation_summary(spark, d):
    """The error map and the overlap struct as JSON text, and the struct's fields."""
    summary = L.validation_summary(_clean(spark, d))
    return summary.select(
        "contest_id", "total_lineups", "lineups_with_errors", F.to_json("errors").alias("errors"),
        F.to_json("pairwise_uniqueness", {"ignoreNullFields": "false"}).alias("pairwise_uniqueness"), "pairwise_uniqueness.*",
    )


@register(
    "assign_slots",
    """SELECT lineup, player_id, CASE WHEN r <= CASE pos WHEN 'RB' THEN 2 WHEN 'WR' THEN 3 ELSE 1 END THEN pos
              WHEN pos IN ('RB', 'WR', 'TE') THEN 'FLEX' END AS slot
       FROM (SELECT *, row_number() OVER (PARTITION BY lineup, pos ORDER BY player_id) AS r FROM v_lineups)""",
)
def assign_slots(spark, d):
    return L.assign_slots(_lineups(spark, d).drop("slot")).select("lineup", "player_id", "slot")


@register("lineup_display_order", "SELECT contest_id, lineup, slot, player_id, salary FROM v_lineups ORDER BY 1, 2, 3, salary DESC, player_id")
def lineup_display_order(spark, d):
    return L.lineup_display_order(_lineups(spark, d).select("contest_id", "lineup", "slot", "player_id", "salary"))


_SQL_STACKS = """(SELECT q.contest_id, q.lineup, q.player_id AS qb_id, q.name AS qb, q.team AS qb_team,
       string_agg(r.name, '; ' ORDER BY r.player_id) AS receivers, count(*) AS stack_size
    FROM v_lineups q JOIN v_lineups r ON r.contest_id = q.contest_id AND r.lineup = q.lineup AND r.team = q.team AND r.pos IN ('WR', 'TE')
    WHERE q.pos = 'QB' GROUP BY 1, 2, 3, 4, 5)"""


@register("qb_stack_join", f"SELECT * FROM {_SQL_STACKS}")
def qb_stack_join(spark, d):
    return L.qb_stack_join(_lineups(spark, d))


@register("stack_sequence", f"SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY lineup) AS stack_no FROM {_SQL_STACKS}")
def stack_sequence(spark, d):
    return L.stack_sequence(_lineups(spark, d))


@register(
    "bring_back",
    f"""SELECT l.contest_id, l.lineup, coalesce(any_value(q.name), 'Unknown') AS qb, coalesce(any_value(q.team), 'Unknown') AS qb_team,
               coalesce(bool_or(l.pos IN ('WR', 'TE') AND l.team = q.team), false) AS has_stack,
               coalesce(bool_or(l.pos IN ('WR', 'TE') AND l.team = q.opp), false) AS bring_back
        FROM {_CLEAN} l LEFT JOIN (SELECT * FROM {_CLEAN} WHERE pos = 'QB' QUALIFY row_number() OVER (PARTITION BY contest_id, lineup ORDER BY player_id, name) = 1) q
        ON q.contest_id = l.contest_id AND q.lineup = l.lineup GROUP BY 1, 2""",
)
def bring_back(spark, d):
    return L.bring_back(_clean(spark, d))


# Backs and defenses are narrowed first: a join of the whole table with itself took the checker minutes.
_SQL_CONFLICTS = """(WITH backs AS MATERIALIZED (SELECT contest_id, lineup, player_id, opp FROM v_lineups WHERE pos = 'RB' AND opp IS NOT NULL),
        defenses AS MATERIALIZED (SELECT contest_id, lineup, player_id, team FROM v_lineups WHERE pos = 'DST')
    SELECT r.contest_id, r.lineup, r.player_id AS rb_id, x.player_id AS dst_id, x.team AS dst_team
    FROM backs r JOIN defenses x ON x.contest_id = r.contest_id AND x.lineup = r.lineup AND x.team = r.opp)"""


@register("rb_vs_dst_conflicts", f"SELECT * FROM {_SQL_CONFLICTS}")
def rb_vs_dst_conflicts(spark, d):
    return L.rb_vs_dst_conflicts(_lineups(spark, d))


_SQL_TEAMS = """(SELECT contest_id, lineup, max(n) AS largest_team FROM (SELECT contest_id, lineup, team, count(*) AS n FROM v_lineups GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@register("team_cap_check", f"SELECT *, largest_team <= 2 AS team_ok FROM {_SQL_TEAMS}")
def team_cap_check(spark, d):
    return L.team_cap_check(_lineups(spark, d), max_team=2)


@register(
    "lineup_rule_audit",
    f"""WITH c AS (SELECT contest_id, lineup, slate_id, count(*) AS n, sum(salary) AS s, count(*) FILTER (pos = 'QB') AS qb, count(*) FILTER (pos = 'RB') AS rb,
                          count(*) FILTER (pos = 'WR') AS wr, count(*) FILTER (pos = 'TE') AS te, count(*) FILTER (pos = 'DST') AS dst,
                          any_value(team) FILTER (pos = 'QB') AS qb_team
                   FROM v_lineups GROUP BY 1, 2, 3)
        SELECT c.contest_id, c.lineup, c.n = 9 AS size_ok, c.qb = 1 AND c.dst = 1 AS single_slots_ok, rb >= 2 AND wr >= 3 AND te >= 1 AS minimums_ok,
               rb + wr + te = 7 AS skill_ok, s <= 50000 AS cap_ok, s >= 45000 AS floor_ok,
               coalesce(k.stack_size, 0) >= 1 OR NOT EXISTS (SELECT 1 FROM v_pool p WHERE p.slate_id = c.slate_id AND p.team = c.qb_team AND p.pos IN ('WR', 'TE')) AS stack_ok,
               t.largest_team <= 2 AS team_ok,
               NOT EXISTS (SELECT 1 FROM {_SQL_CONFLICTS} x WHERE x.contest_id = c.contest_id AND x.lineup = c.lineup) AS no_rb_vs_dst
        FROM c JOIN {_SQL_TEAMS} t ON t.contest_id = c.contest_id AND t.lineup = c.lineup
        LEFT JOIN {_SQL_STACKS} k ON k.contest_id = c.contest_id AND k.lineup = c.lineup""",
)
def lineup_rule_audit(spark, d):
    return L.lineup_rule_audit(_lineups(spark, d), view(spark, d, "v_pool"), floor=45000, max_team=2)
