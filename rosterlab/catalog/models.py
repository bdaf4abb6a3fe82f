"""Training sets, models and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.catalog.registry import register
from rosterlab.fixtures import view
from rosterlab.operators import features as W
from rosterlab.operators import models as M
from rosterlab.operators.pool import salary_tier_join
from rosterlab.session import scratch_path
from rosterlab.sources.salaries import scan_weekly

KEYS = ["player_id", "seq"]
_FRAME = "OVER (PARTITION BY player_id ORDER BY season, week, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_SQL_FEATURES = f"""(SELECT *, avg(fantasy_points_ppr) {_FRAME} AS fp_avg_3, avg(passing_yards) {_FRAME} AS passing_yards_avg
    FROM v_weekly WHERE pos IS NOT NULL AND fantasy_points_ppr IS NOT NULL)"""


def weekly_features(spark, d):
    weekly = scan_weekly(view(spark, d, "v_weekly").withColumnRenamed("pos", "position"), keep=("seq",))
    return W.rolling_sums_of_columns(W.rolling_features(weekly))


_SQL_ALL_FEATURES = "(SELECT *, {} FROM v_weekly WHERE pos IS NOT NULL AND fantasy_points_ppr IS NOT NULL)".format(
    ", ".join(f"avg({source}) {_FRAME} AS {name}" for name, source in {**W.ROLLING_COLUMNS, **{n: " + ".join(c) for n, c in W.ROLLING_SUMS.items()}}.items())
)


def _sql_training(pos: str, rule: str) -> str:
    columns = C.TRAINING_FEATURES[pos]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns) if rule == "drop" else "true"
    return " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, pos, player_id, seq, fantasy_points_ppr, '{c}' AS feature, round(coalesce({c}, 0), 4) AS value
            FROM all_features WHERE pos = '{pos}' AND {complete}"""
        for c in columns
    )


@register("training_set", f"WITH all_features AS MATERIALIZED {_SQL_ALL_FEATURES} " + " UNION ALL ".join(_sql_training(p, r) for p in C.POSITIONS for r in ("fill", "drop")))
def training_set(spark, d):
    """The training rows of every position under both rules, a row for each feature."""
    features = weekly_features(spark, d)
    sets = []
    for pos in C.POSITIONS:
        values = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 4).alias("value")) for c in C.TRAINING_FEATURES[pos]])
        sets += [M.training_set(features, pos, rule).select(F.lit(rule).alias("rule"), "pos", *KEYS, M.TARGET, F.inline(values)) for rule in ("fill", "drop")]
    return reduce(DataFrame.unionByName, sets)


@register(
    "min_rows_gate",
    """SELECT pos, count(*) AS training_rows, CASE pos WHEN 'DST' THEN 100 ELSE 500 END AS required_rows,
              count(*) >= CASE pos WHEN 'DST' THEN 100 ELSE 500 END AS trainable
       FROM v_weekly WHERE pos IS NOT NULL AND fantasy_points_ppr IS NOT NULL GROUP BY 1""",
)
def min_rows_gate(spark, d):
    return M.min_rows_gate(view(spark, d, "v_weekly"))


@register(
    "split_80_20",
    """SELECT player_id, seq, CAST('0x' || substr(md5(concat_ws('|', 42, player_id, seq)), 1, 13) AS BIGINT) % 100 < 80 AS is_train FROM v_weekly""",
)
def split_80_20(spark, d):
    return M.split_80_20(view(spark, d, "v_weekly").select(*KEYS), KEYS)


@register("train_position_models")
def train_position_models(spark, d):
    _, predictions = M.train_position_models(weekly_features(spark, d), KEYS)
    return M.model_metrics(predictions) if predictions is not None else M.min_rows_gate(view(spark, d, "v_weekly"))


_SQL_GIVEN = f"""(SELECT pos, fantasy_points_ppr AS y, coalesce(fp_avg_3, 0) AS p, seq % 5 <> 0 AS is_train FROM {_SQL_FEATURES})"""


@register(
    "model_metrics",
    f"""SELECT pos, round(avg(abs(y - p)) FILTER (NOT is_train), 4) AS mae,
               round(1 - sum((y - p) * (y - p)) FILTER (NOT is_train) / (var_pop(y) FILTER (NOT is_train) * count(*) FILTER (NOT is_train)), 4) AS r2,
               count(*) FILTER (is_train) AS train_rows, count(*) FILTER (NOT is_train) AS validation_rows
        FROM {_SQL_GIVEN} GROUP BY 1""",
)
def model_metrics(spark, d):
    given = weekly_features(spark, d).select(
        "pos", M.TARGET, F.coalesce("fp_avg_3", F.lit(0.0)).alias("prediction"), (F.col("seq") % 5 != 0).alias("is_train")
    )
    return M.model_metrics(given).withColumns({c: F.round(c, 4) for c in ("mae", "r2")})


@register(
    "score_players",
    f"""SELECT player_id, pos, round(CASE WHEN pos = 'DST' THEN 10.0::DOUBLE ELSE (a + b) * 0.01::DOUBLE END, 6) AS proj_points
        FROM (SELECT p.player_id, p.pos, coalesce(t.fp, 0) AS a, CASE p.pos WHEN 'QB' THEN t.py WHEN 'RB' THEN t.ry ELSE t.tg END AS b
              FROM v_pool p LEFT JOIN (VALUES {{tiers}}) t(pos, lo, hi, fp, py, ry, tg)
              ON t.pos = p.pos AND (t.lo IS NULL OR p.salary >= t.lo) AND (t.hi IS NULL OR p.salary < t.hi))""".format(
        tiers=", ".join(
            f"('{pos}', {low or 'NULL'}, {high or 'NULL'}, {', '.join(f'{m}::DOUBLE' for m in means)})"
            for pos, tiers in C.SALARY_TIERS.items()
            for (low, *means), high in zip(tiers, [None] + [t[0] for t in tiers], strict=False)
        )
    ),
)
def score_players(spark, d):
    scored = M.score_players(salary_tier_join(view(spark, d, "v_pool")))
    return scored.select("player_id", "pos", F.round("proj_points", 6).alias("proj_points"))


@register("save_load_models")
def save_load_models(spark, d):
    """A smaller forest per position, saved, loaded again and applied to the whole pool."""
    models, _ = M.train_position_models(weekly_features(spark, d), KEYS, positions=("QB", "RB", "WR", "TE"), trees=20, depth=5)
    path = scratch_path(spark, "models")
    M.save_models(models, path)
    scored = M.score_players(salary_tier_join(view(spark, d, "v_pool")), M.load_models(path))
    return scored.select("player_id", "pos", "proj_points")
