"""Salary feed, crosswalk and projections to audited lineups, for every slate at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.functions import names as N
from rosterlab.operators import identity, lineups, pool, search
from rosterlab.operators.normalise import coerce_projections, min_salary_filter, normalise_salaries, valid_salaries
from rosterlab.session import cut_lineage


@dataclass(frozen=True)
class OptimizerResult:
    pool: DataFrame
    preflight: DataFrame
    unmatched: DataFrame
    lineups: DataFrame
    audit: DataFrame


def build_player_pool(raw: DataFrame, crosswalk: DataFrame, projections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool, unmatched salary rows).

    ``raw`` is a salary feed with slate_id, id and file_seq next to its own headers; ``projections`` carry slate_id,
    player_id, name, proj_points, opp and feed_seq.
    """
    normal = normalise_salaries(raw, keep=("slate_id", "id", "file_seq"))
    salaries = valid_salaries(normal.withColumn("pos", N.canon_position(F.col("pos"))))
    usable = coerce_projections(projections)
    joined = identity.build_pool(salaries, crosswalk, usable)
    game = "GameInfo" if "GameInfo" in raw.columns else "Game Info"
    games = raw.select("slate_id", F.col(f"`{game}`").alias("game_text"), F.col("file_seq").alias("seq"))
    filled = pool.opponent_map_join(joined, games)
    # Two salary rows may resolve to one entity; the roster search needs a player once, so the dearest row stands for it.
    single = search.top_per_key(filled, ["slate_id", "entity_id"], [F.col("salary").desc(), F.col("dk_id")], 1)
    return single.withColumn("player_id", F.col("entity_id")), identity.unmatched_report(salaries, crosswalk, usable)


def optimize(
    raw: DataFrame, crosswalk: DataFrame, projections: DataFrame, n: int = 1, cap: int = C.SALARY_CAP, min_player_salary: int = 0,
    min_total_salary: int = 0, seed: int = 42, alpha: float = C.NOISE_BASE_ALPHA, max_exposure: float = 0.35, uniq_shared: int = 7,
    qb_stack: int = 1, max_team: int = 4, no_rb_vs_dst: bool = False,
) -> OptimizerResult:
    """One best lineup per slate, or n varied ones, and their rule audit.  Slates that fail the preflight have none."""
    players, unmatched = build_player_pool(raw, crosswalk, projections)
    players = cut_lineage(min_salary_filter(players, min_player_salary))  # read by the preflight, the search and the audit
    preflight = pool.pool_preflight(players)
    ready = players.join(preflight.filter("ok").select("slate_id"), "slate_id", "left_semi")
    rules = {"cap": cap, "floor": min_total_salary, "stack": qb_stack, "max_team": max_team, "no_rb_vs_dst": no_rb_vs_dst}
    if n == 1:
        rosters = search.best_lineups(ready, **rules).withColumn("lineup", F.lit(1).cast("bigint"))
    else:
        rosters = search.generate_lineups(ready, n, seed, alpha, max_exposure, uniq_shared, **rules)
    chosen = cut_lineage(lineups.assign_slots(search.lineup_rows(rosters, ready)))
    audit = lineups.lineup_rule_audit(chosen, ready, cap, min_total_salary, qb_stack, max_team)
    return OptimizerResult(players, preflight, unmatched, chosen, audit)
