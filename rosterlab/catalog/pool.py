"""Pool joins, pool checks and feature jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.catalog.inputs import SQL_SALARIES, salary_table, sql_team
from rosterlab.catalog.registry import register
from rosterlab.fixtures import view
from rosterlab.operators import audit as A
from rosterlab.operators import features as W
from rosterlab.operators import pool as P
from rosterlab.operators.normalise import union_positions as union_by_position

_TOKEN = "split_part(trim(game_text), ' ', 1)"


SQL_OPPONENTS = f"""
    sides AS (SELECT slate_id, file_seq, {sql_team(f"split_part({_TOKEN}, '@', 1)")} AS away,
                     {sql_team(f"substr({_TOKEN}, strpos({_TOKEN}, '@') + 1)")} AS home
              FROM v_raw_salary WHERE contains({_TOKEN}, '@')),
    both_ways AS (SELECT slate_id, file_seq, away AS team, home AS o FROM sides UNION ALL SELECT slate_id, file_seq, home, away FROM sides),
    m AS (SELECT slate_id, team, o FROM both_ways QUALIFY row_number() OVER (PARTITION BY slate_id, team ORDER BY file_seq DESC, o DESC) = 1)"""


@register(
    "opponent_map_join",
    f"""WITH {SQL_OPPONENTS},
        p AS (SELECT slate_id, id, {sql_team('team_text')} AS team, coalesce(opponent_text, 'UNK') AS opp FROM v_raw_salary)
        SELECT p.slate_id, p.id, p.team, CASE WHEN p.opp = 'UNK' THEN coalesce(m.o, 'UNK') ELSE p.opp END AS opp
        FROM p LEFT JOIN m ON m.slate_id = p.slate_id AND m.team = p.team""",
)
def opponent_map_join(spark, d):
    raw = view(spark, d, "v_raw_salary")
    pool = raw.select("slate_id", "id", F.col("team_text").alias("team"), F.coalesce("opponent_text", F.lit("UNK")).alias("opp"))
    games = raw.select("slate_id", "game_text", F.col("file_seq").alias("seq"))
    return P.opponent_map_join(pool, games)


_PROJECTIONS = """(SELECT slate_id, player_id, pos, proj_points, CASE WHEN player_id % 4 = 0 THEN upper(name) WHEN player_id % 9 = 0 THEN name || ' x' ELSE name END AS name,
                          CAST(3000 AS BIGINT) AS salary FROM v_pool)"""
_SALARIES = "(SELECT slate_id, CASE WHEN player_id % 6 = 1 THEN lower(name) ELSE name END AS name, pos, salary + 100 * j AS salary, player_id * 10 + j AS seq FROM (SELECT *, unnest(range(0, 2)) AS j FROM v_pool))"


def _projections(spark, d):
    n = F.col("name")
    name = F.when(F.col("player_id") % 4 == 0, F.upper(n)).when(F.col("player_id") % 9 == 0, F.concat(n, F.lit(" x"))).otherwise(n)
    return view(spark, d, "v_pool").select("slate_id", "player_id", "pos", "proj_points", name.alias("name"), F.lit(3000).cast("bigint").alias("salary"))


def _duplicated_salaries(spark, d):
    rows = view(spark, d, "v_pool").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    name = F.when(F.col("player_id") % 6 == 1, F.lower("name")).otherwise(F.col("name"))
    return rows.select("slate_id", name.alias("name"), "pos", (F.col("salary") + 100 * F.col("j")).alias("salary"), (F.col("player_id") * 10 + F.col("j")).alias("seq"))


@register(
    "two_pass_salary_join",
    f"""WITH p AS {_PROJECTIONS}, s AS {_SALARIES},
        e AS (SELECT slate_id, name, pos, arg_min(salary, seq) AS salary FROM s GROUP BY 1, 2, 3),
        l AS (SELECT slate_id, lower(name) AS name, pos, arg_min(salary, seq) AS salary FROM s GROUP BY 1, 2, 3)
        SELECT p.slate_id, p.player_id, coalesce(e.salary, l.salary, 2500) AS salary,
               CASE WHEN e.salary IS NOT NULL THEN 'exact' WHEN l.salary IS NOT NULL THEN 'case_insensitive' ELSE 'none' END AS salary_match,
               CASE WHEN coalesce(e.salary, l.salary, 2500) <> 2500 THEN 'REAL' ELSE 'PLACEHOLDER' END AS salary_kind
        FROM p LEFT JOIN e ON e.slate_id = p.slate_id AND e.name = p.name AND e.pos = p.pos
        LEFT JOIN l ON l.slate_id = p.slate_id AND l.name = lower(p.name) AND l.pos = p.pos""",
)
def two_pass_salary_join(spark, d):
    joined = P.two_pass_salary_join(_projections(spark, d), _duplicated_salaries(spark, d))
    return joined.select("slate_id", "player_id", F.col("salary").cast("bigint").alias("salary"), "salary_match", "salary_kind")


@register(
    "last_wins_lookup",
    f"""WITH p AS {_PROJECTIONS}, s AS {_SALARIES},
        l AS (SELECT slate_id, lower(name) AS name, pos, arg_max(salary, seq) AS salary FROM s GROUP BY 1, 2, 3)
        SELECT p.slate_id, p.player_id, coalesce(l.salary, p.salary) AS salary
        FROM p LEFT JOIN l ON l.slate_id = p.slate_id AND l.name = lower(p.name) AND l.pos = p.pos""",
)
def last_wins_lookup(spark, d):
    return P.last_wins_lookup(_projections(spark, d), _duplicated_salaries(spark, d)).select("slate_id", "player_id", "salary")


def _tier_values() -> str:
    rows = []
    for pos, tiers in C.SALARY_TIERS.items():
        high = "NULL"
        for (low, *means), label in zip(tiers, C.TIER_LABELS, strict=True):
            rows.append(f"('{pos}', {'NULL' if low is None else low}, {high}, '{label}', {', '.join(f'{m}::DOUBLE' for m in means)})")
            high = str(low)
    return ", ".join(rows)


@register(
    "salary_tier_join",
    f"""SELECT p.player_id, t.tier, t.fp AS fp_avg_3, t.py AS passing_yards_avg, t.ry AS rush_yards_avg, t.tg AS targets_avg
        FROM v_pool p LEFT JOIN (VALUES {_tier_values()}) t(pos, lo, hi, tier, fp, py, ry, tg)
        ON t.pos = p.pos AND (t.lo IS NULL OR p.salary >= t.lo) AND (t.hi IS NULL OR p.salary < t.hi)""",
)
def salary_tier_join(spark, d):
    return P.salary_tier_join(view(spark, d, "v_pool")).select(
        "player_id", "tier", "fp_avg_3", "passing_yards_avg", "rush_yards_avg", "targets_avg"
    )


@register("position_counts", "SELECT slate_id, pos, count(*) AS players FROM v_pool GROUP BY 1, 2")
def position_counts(spark, d):
    return P.position_counts(view(spark, d, "v_pool"))


_COUNTS = """(SELECT slate_id, count(*) FILTER (pos = 'QB') AS n_qb, count(*) FILTER (pos = 'RB') AS n_rb, count(*) FILTER (pos = 'WR') AS n_wr,
                     count(*) FILTER (pos = 'TE') AS n_te, count(*) FILTER (pos = 'DST') AS n_dst FROM {table} GROUP BY 1)"""


@register(
    "pool_preflight",
    f"""SELECT *, reason IS NULL AS ok FROM (SELECT *, n_rb + n_wr + n_te AS skill,
          CASE WHEN n_qb < 1 THEN 'needs 1 QB' WHEN n_rb < 2 THEN 'needs 2 RB' WHEN n_wr < 3 THEN 'needs 3 WR' WHEN n_te < 1 THEN 'needs 1 TE'
               WHEN n_dst < 1 THEN 'needs 1 DST' WHEN n_rb + n_wr + n_te < 7 THEN 'needs 7 skill players' END AS reason
        FROM {_COUNTS.format(table='v_pool')})""",
)
def pool_preflight(spark, d):
    return P.pool_preflight(view(spark, d, "v_pool"))


@register(
    "position_availability",
    f"""SELECT slate_id, pos, required, available, available >= required AS sufficient FROM (
          SELECT slate_id, unnest(['QB', 'RB', 'WR', 'TE', 'DST', 'FLEX']) AS pos, unnest([1, 2, 3, 1, 1, 1]) AS required,
                 unnest([n_qb, n_rb, n_wr, n_te, n_dst, greatest(0, n_rb + n_wr + n_te - 6)]) AS available
          FROM {_COUNTS.format(table='v_pool')})""",
)
def position_availability(spark, d):
    return P.position_availability(view(spark, d, "v_pool"))


@register(
    "salary_stats",
    """SELECT slate_id, count(s) AS valid_count, count(*) - count(s) AS invalid_count, round(avg(s), 4) AS mean_salary,
              round(stddev_samp(s), 4) AS std_salary, min(s) AS min_salary, quantile_cont(s, 0.25) AS q25, quantile_cont(s, 0.5) AS q50,
              quantile_cont(s, 0.75) AS q75, max(s) AS max_salary
       FROM (SELECT slate_id, TRY_CAST(salary AS DOUBLE) AS s FROM v_quality_pool) GROUP BY 1""",
)
def salary_stats(spark, d):
    stats = P.salary_stats(view(spark, d, "v_quality_pool"))
    return stats.withColumn("mean_salary", F.round("mean_salary", 4)).withColumn("std_salary", F.round("std_salary", 4))


@register(
    "column_quality",
    """SELECT slate_id, 'proj_points' AS column_name, count(*) AS total, count(*) FILTER (proj_points IS NULL) AS nulls,
              count(*) FILTER (proj_points = 0) AS zeros, count(*) FILTER (proj_points < 0) AS negatives,
              count(*) FILTER (pos = 'DST' AND proj_points IS NOT NULL) AS dst_with_projection,
              count(*) FILTER (proj_points = 0) * 10 > count(*) AS many_zeros
       FROM v_quality_pool GROUP BY 1""",
)
def column_quality(spark, d):
    return P.column_quality(view(spark, d, "v_quality_pool"))


@register(
    "pool_quality",
    """SELECT slate_id, count(*) AS total_players, count(*) FILTER (pos IS NULL) AS null_pos, count(*) FILTER (salary IS NULL) AS null_salary,
              count(*) FILTER (salary IS NOT NULL AND TRY_CAST(salary AS DOUBLE) IS NULL) AS non_numeric_salary,
              count(*) - count(DISTINCT entity_id) AS duplicate_entities, '' AS missing_columns
       FROM v_quality_pool GROUP BY 1""",
)
def pool_quality(spark, d):
    return P.pool_quality(view(spark, d, "v_quality_pool"))


_RANKED = """(SELECT *, row_number() OVER (PARTITION BY slate_id, pos ORDER BY salary {direction}, player_id) AS r,
                     CASE pos WHEN 'RB' THEN 2 WHEN 'WR' THEN 3 ELSE 1 END AS need
              FROM (SELECT slate_id, player_id, pos, CAST(TRY_CAST(salary AS DOUBLE) AS BIGINT) AS salary FROM v_quality_pool)
              WHERE salary IS NOT NULL AND pos IS NOT NULL)"""


@register(
    "rank_in_position",
    f"SELECT slate_id, pos, player_id, salary, CAST(r AS INT) AS rank_in_pos FROM {_RANKED.format(direction='ASC')} WHERE r <= 3",
)
def rank_in_position(spark, d):
    pool = view(spark, d, "v_quality_pool").withColumn("salary", F.col("salary").try_cast("double").cast("bigint"))
    ranked = P.rank_in_position(pool.filter(F.col("salary").isNotNull() & F.col("pos").isNotNull()))
    return ranked.select("slate_id", "pos", "player_id", "salary", "rank_in_pos")


def _extreme_sql(direction: str, pick: str, name: str) -> str:
    return f"""SELECT slate_id, sum(salary) FILTER (r <= need)::BIGINT + {pick}(salary) FILTER (pos IN ('RB', 'WR', 'TE') AND r = need + 1) AS {name}
        FROM {_RANKED.format(direction=direction)} GROUP BY 1"""


@register("cheapest_lineup", _extreme_sql("ASC", "min", "cheapest"))
def cheapest_lineup(spark, d):
    return P.cheapest_lineup(view(spark, d, "v_quality_pool"))


@register("dearest_lineup", _extreme_sql("DESC", "max", "dearest"))
def dearest_lineup(spark, d):
    return P.dearest_lineup(view(spark, d, "v_quality_pool"))


@register(
    "greedy_lineup",
    f"""WITH r AS (SELECT * FROM {_RANKED.format(direction='ASC')}),
        picks AS (SELECT slate_id, pos AS slot, r, player_id, pos, salary FROM r WHERE r <= need
                  UNION ALL (SELECT slate_id, 'FLEX', r, player_id, pos, salary FROM r WHERE pos IN ('RB', 'WR', 'TE') AND r = need + 1
                             QUALIFY row_number() OVER (PARTITION BY slate_id ORDER BY salary, player_id) = 1))
        SELECT slate_id, slot, CAST(r AS INT) AS rank_in_pos, player_id, pos, salary, total_salary, total_salary <= 50000 AS under_cap,
               50000 - total_salary AS remaining, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, CAST(sum(salary) OVER (PARTITION BY slate_id) AS BIGINT) AS total_salary FROM picks)""",
)
def greedy_lineup(spark, d):
    return P.greedy_lineup(view(spark, d, "v_quality_pool"))


@register(
    "feasibility",
    f"""WITH c AS ({_extreme_sql('ASC', 'min', 'cheapest')}),
        q AS (SELECT slate_id, count(*) FILTER (salary IS NULL) = 0 AS data_ok,
                     count(*) FILTER (pos = 'QB') >= 1 AND count(*) FILTER (pos = 'RB') >= 2 AND count(*) FILTER (pos = 'WR') >= 3
                       AND count(*) FILTER (pos = 'TE') >= 1 AND count(*) FILTER (pos = 'DST') >= 1
                       AND count(*) FILTER (pos IN ('RB', 'WR', 'TE')) >= 7 AS positions_ok,
                     count(*) FILTER (proj_points IS NULL) = 0 AND count(*) FILTER (proj_points < 0) = 0
                       AND count(*) FILTER (proj_points = 0) * 10 <= count(*) AS projections_ok
              FROM v_quality_pool GROUP BY 1),
        j AS (SELECT q.*, c.cheapest, coalesce(c.cheapest <= 50000, false) AS salary_ok FROM q LEFT JOIN c ON c.slate_id = q.slate_id)
        SELECT *, concat_ws('; ', CASE WHEN NOT data_ok THEN 'Basic Data' END, CASE WHEN NOT positions_ok THEN 'Position Counts' END,
                            CASE WHEN NOT salary_ok THEN 'Salary Constraints' END) AS critical_issues,
               data_ok AND positions_ok AND salary_ok AS feasible FROM j""",
)
def feasibility(spark, d):
    return P.feasibility(view(spark, d, "v_quality_pool"))


# --- features --------------------------------------------------------------------------------------------------

_FRAME = "OVER (PARTITION BY player_id ORDER BY season, week, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@register(
    "rolling_features",
    "SELECT player_id, season, week, seq, "
    + ", ".join(f"round(avg({c}) {_FRAME}, 4) AS {f}" for f, c in W.ROLLING_COLUMNS.items())
    + ", CAST(NULL AS DOUBLE) AS \"aDOT_avg\", CAST(NULL AS DOUBLE) AS redzone_tgt_rate FROM v_weekly",
)
def rolling_features(spark, d):
    features = W.rolling_features(view(spark, d, "v_weekly"))
    return features.select(
        "player_id", "season", "week", "seq", *[F.round(f, 4).alias(f) for f in W.ROLLING_COLUMNS], *W.NULL_FEATURES
    )


@register(
    "rolling_sums_of_columns",
    "SELECT player_id, seq, "
    + ", ".join(f"round(avg({' + '.join(cs)}) {_FRAME}, 4) AS {f}" for f, cs in W.ROLLING_SUMS.items())
    + " FROM v_weekly",
)
def rolling_sums_of_columns(spark, d):
    sums = W.rolling_sums_of_columns(view(spark, d, "v_weekly"))
    return sums.select("player_id", "seq", *[F.round(f, 4).alias(f) for f in W.ROLLING_SUMS])


@register(
    "feature_summary",
    f"""SELECT pos, count(*) AS players, count(DISTINCT fp) AS fp_avg_3_distinct, min(fp) AS fp_avg_3_min, max(fp) AS fp_avg_3_max,
               count(DISTINCT py) AS passing_yards_avg_distinct, min(py) AS passing_yards_avg_min, max(py) AS passing_yards_avg_max
        FROM (SELECT pos, round(avg(fantasy_points_ppr) {_FRAME}, 4) AS fp, round(avg(passing_yards) {_FRAME}, 4) AS py FROM v_weekly) GROUP BY 1""",
)
def feature_summary(spark, d):
    columns = {f: W.ROLLING_COLUMNS[f] for f in ("fp_avg_3", "passing_yards_avg")}
    features = W.rolling_features(view(spark, d, "v_weekly"), columns)
    return W.feature_summary(features.withColumns({f: F.round(f, 4) for f in columns}))


@register(
    "issues_report",
    """WITH s AS (SELECT slate_id, pos, CASE WHEN pos = 'TE' AND slate_id % 2 = 1 THEN NULL ELSE proj_points END AS p FROM v_quality_pool
                  WHERE NOT (coalesce(pos, '') = 'DST' AND slate_id % 4 = 1))
       SELECT e.slate_id, e.pos, 'empty_position' AS issue, CAST(0 AS BIGINT) AS players
       FROM (SELECT slate_id, unnest(['QB', 'RB', 'WR', 'TE', 'DST']) AS pos FROM (SELECT DISTINCT slate_id FROM v_pool)) e
       LEFT JOIN (SELECT DISTINCT slate_id, pos FROM s) h ON h.slate_id = e.slate_id AND h.pos = e.pos WHERE h.pos IS NULL
       UNION ALL SELECT slate_id, pos, 'prediction_error', count(*) FROM s WHERE p IS NULL GROUP BY 1, 2""",
)
def issues_report(spark, d):
    pool = view(spark, d, "v_quality_pool")
    lost = F.when((F.col("pos") == "TE") & (F.col("slate_id") % 2 == 1), F.lit(None)).otherwise(F.col("proj_points"))
    scored = pool.withColumn("proj_points", lost).filter(~((F.coalesce("pos", F.lit("")) == "DST") & (F.col("slate_id") % 4 == 1)))
    return A.issues_report(scored, view(spark, d, "v_pool"))


@register("union_positions", f"SELECT slate_id, id, pos FROM ({SQL_SALARIES}) WHERE pos IN ('QB', 'RB', 'WR', 'TE', 'DST')")
def union_positions(spark, d):
    rows = salary_table(spark, d).select("slate_id", "id", "pos")
    return union_by_position({p: rows.filter(F.col("pos") == p) for p in C.POSITIONS}, rows)
