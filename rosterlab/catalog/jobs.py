"""End-to-end jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.catalog.identity import SQL_BY_ID, SQL_BY_NAME
from rosterlab.catalog.inputs import SQL_SALARIES, projection_feed, raw_salaries, salary_table
from rosterlab.catalog.pool import SQL_OPPONENTS
from rosterlab.catalog.registry import register
from rosterlab.fixtures import view
from rosterlab.plans.optimize import build_player_pool, optimize
from rosterlab.plans.project import project
from rosterlab.plans.report import lineup_report

_TIERS = ", ".join(
    f"('{pos}', {low or 'NULL'}, {high or 'NULL'}, {', '.join(f'{m}::DOUBLE' for m in means)})"
    for pos, tiers in C.SALARY_TIERS.items()
    for (low, *means), high in zip(tiers, [None] + [t[0] for t in tiers], strict=False)
)


@register(
    "projection_job",
    f"""SELECT s.slate_id, s.id, s.name, s.pos, s.team, s.opp, s.is_home, s.salary, s.game_date,
               round(CASE WHEN s.pos = 'DST' THEN 10.0::DOUBLE ELSE (t.fp + CASE s.pos WHEN 'QB' THEN t.py WHEN 'RB' THEN t.ry ELSE t.tg END) * 0.01::DOUBLE END, 6) AS proj_points
        FROM ({SQL_SALARIES}) s LEFT JOIN (VALUES {_TIERS}) t(pos, lo, hi, fp, py, ry, tg)
        ON t.pos = s.pos AND (t.lo IS NULL OR s.salary >= t.lo) AND (t.hi IS NULL OR s.salary < t.hi)""",
)
def projection_job(spark, d):
    projections, _ = project(salary_table(spark, d))
    return projections.withColumn("proj_points", F.round("proj_points", 6))


def _inputs(spark, d):
    feed = projection_feed(spark, d).drop("pos", "team")
    return raw_salaries(spark, d), view(spark, d, "v_crosswalk"), feed


@register(
    "pool_job",
    f"""WITH {SQL_OPPONENTS}, joined AS (({SQL_BY_ID}) UNION ALL ({SQL_BY_NAME})),
        single AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY slate_id, entity_id ORDER BY salary DESC, dk_id) = 1)
        SELECT j.slate_id, j.name, j.pos, j.team, j.salary, j.proj_points, j.dk_id, j.entity_id, j.match_method, j.value,
               CASE WHEN upper(j.opp) IN ('', 'UNK') THEN coalesce(m.o, 'UNK') ELSE j.opp END AS opp, j.entity_id AS player_id
        FROM single j LEFT JOIN m ON m.slate_id = j.slate_id AND m.team = j.team""",
)
def pool_job(spark, d):
    pool, _ = build_player_pool(*_inputs(spark, d))
    return pool.withColumn("salary", F.col("salary").cast("bigint")).withColumn("value", F.round("value", 6))


@register("optimizer_job")
def optimizer_job(spark, d):
    """One best lineup per slate from the raw feeds, with its rule audit."""
    return optimize(*_inputs(spark, d)).audit


@register(
    "report_job",
    """WITH n AS (SELECT contest_id, count(DISTINCT lineup) AS n FROM v_lineups GROUP BY 1)
       SELECT l.contest_id, team, pos, count(*) AS appearances, floor((count(*) * 20000 + n) / (2 * n)) / 100 AS exposure_pct
       FROM v_lineups l JOIN n ON n.contest_id = l.contest_id GROUP BY l.contest_id, team, pos, n""",
)
def report_job(spark, d):
    from rosterlab.operators.lineups import total_rows

    rows = view(spark, d, "v_lineups")
    with_totals = total_rows(rows).withColumn("opp", F.lit(None).cast("string"))
    return lineup_report(with_totals)["team_exposure"]
