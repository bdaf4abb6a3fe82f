"""Finished-lineup operators: totals, exposures, validation, stacks and pairwise overlap.

Lineups are long tables: contest_id, lineup, slot, player_id, name, pos, team, opp, salary, proj_points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.functions.values import exact_ratio, points_per_k, to_number
from rosterlab.operators.keyed import running_number, top_per_key
from rosterlab.session import cut_lineage

LINEUP_KEY = ["contest_id", "lineup"]
RECEIVERS = ("WR", "TE")


def drop_total_rows(lineups: DataFrame) -> DataFrame:
    """Player rows only: TOTAL rows removed, salary and points numeric with zero for text that does not parse."""
    rows = lineups.filter(F.coalesce(F.upper("slot"), F.lit("")) != "TOTAL")
    return rows.withColumn("salary", F.coalesce(to_number(F.col("salary")), F.lit(0.0)).cast("bigint")).withColumn(
        "proj_points", F.coalesce(F.col("proj_points").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    )


def total_rows(lineups: DataFrame) -> DataFrame:
    """Lineup rows plus one TOTAL row per lineup."""
    totals = lineups.groupBy(*LINEUP_KEY).agg(F.sum("salary").alias("salary"), F.sum("proj_points").alias("proj_points"))
    columns = [*LINEUP_KEY, "slot", "name", "pos", "team", "salary", "proj_points"]
    blank = F.lit(None).cast("string")
    return lineups.select(*columns).unionByName(
        totals.select(
            *LINEUP_KEY, F.lit("TOTAL").alias("slot"), blank.alias("name"), blank.alias("pos"), blank.alias("team"),
            "salary", "proj_points",
        )
    )


def lineup_totals(lineups: DataFrame, cap: int = C.SALARY_CAP) -> DataFrame:
    """Salary, points, remaining cap, value and mean player value per lineup."""
    value = points_per_k(F.col("proj_points").cast("double"), F.col("salary"))
    totals = lineups.groupBy(*LINEUP_KEY).agg(
        F.sum("salary").alias("total_salary"), F.sum("proj_points").alias("total_points"),
        F.avg(value).alias("mean_value"),
    )
    return totals.withColumn("remaining", F.lit(cap) - F.col("total_salary")).withColumn(
        "value", points_per_k(F.col("total_points").cast("double"), F.col("total_salary"))
    )


# --- exposure --------------------------------------------------------------------------------------------------


def contest_columns(lineups: DataFrame, *columns: str) -> list[str]:
    """Those of the columns that have one value throughout each contest of these lineups, counted over all of them.

    Grouped by such a column too, a contest's groups are the same, and rows that lie by it (as by slate) need no shuffle.
    """
    one_value = [(F.count(c) == F.count("*")) & (F.min(c) == F.max(c)) for c in columns]
    held = lineups.groupBy("contest_id").agg(*[v.alias(c) for v, c in zip(one_value, columns, strict=True)])
    found = held.agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def contest_sizes(lineups: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Number of generated lineups per contest, to be merged with tables as large as the lineups, whose size Spark underrates."""
    sizes = lineups.groupBy(*within, *LINEUP_KEY).agg(F.lit(1).alias("_one")).groupBy(*within, "contest_id").agg(F.count("*").alias("n_lineups"))
    return sizes.hint("merge")


def player_exposure(lineups: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Appearances per player with the share of generated lineups and average salary and points.

    ``within``: columns that have one value in each contest (see `contest_columns`).
    """
    counts = lineups.groupBy(*within, "contest_id", "name", "pos", "team").agg(
        F.count("*").alias("appearances"), F.sum("salary").alias("_salary"),
        F.sum(F.round(F.col("proj_points") * 1000).cast("bigint")).alias("_milli"),
    )
    joined = counts.join(contest_sizes(lineups, within), [*within, "contest_id"])
    return joined.select(
        "contest_id", "name", "pos", "team", "appearances",
        exact_ratio(F.col("appearances") * 100, F.col("n_lineups"), 2).alias("exposure_pct"),
        exact_ratio(F.col("_salary"), F.col("appearances"), 2).alias("avg_salary"),
        (exact_ratio(F.col("_milli"), F.col("appearances"), 0) / 1000.0).alias("avg_proj"),
    )


def player_exposure_requested(lineups: DataFrame, requested: int) -> DataFrame:
    """Appearances per player with the share of the requested number of lineups."""
    return lineups.groupBy("contest_id", "name", "pos", "team").agg(F.count("*").alias("exposure_count")).withColumn(
        "exposure_pct", F.col("exposure_count") / F.lit(float(requested)) * 100.0
    )


def team_exposure(lineups: DataFrame) -> DataFrame:
    return lineups.groupBy("contest_id", "team").agg(F.count("*").alias("total_exposure"))


def team_position_exposure(lineups: DataFrame) -> DataFrame:
    counts = lineups.groupBy("contest_id", "team", "pos").agg(F.count("*").alias("appearances"))
    return counts.join(contest_sizes(lineups), "contest_id").select(
        "contest_id", "team", "pos", "appearances",
        exact_ratio(F.col("appearances") * 100, F.col("n_lineups"), 2).alias("exposure_pct"),
    )


def exposure_limit(max_exposure: float, requested: Column) -> Column:
    """Largest number of lineups a player may be in; never below one."""
    return F.greatest(F.lit(1), F.floor(requested * max_exposure)).cast("bigint")


def exposure_alerts(lineups: DataFrame, max_exposure: float = 0.35) -> DataFrame:
    """Players at 80 % of the exposure limit or more, and whether they are at the limit."""
    counts = lineups.groupBy("contest_id", "player_id", "name").agg(F.count("*").alias("exposure_count"))
    limited = counts.join(contest_sizes(lineups), "contest_id").withColumn(
        "limit_count", exposure_limit(max_exposure, F.col("n_lineups"))
    )
    return limited.filter(F.col("exposure_count") * 10 >= F.col("limit_count") * 8).select(
        "contest_id", "player_id", "name", "exposure_count", "limit_count",
        (F.col("exposure_count") >= F.col("limit_count")).alias("at_limit"),
    )


def top_exposure(lineups: DataFrame, requested: int, n: int = 10) -> DataFrame:
    """n most used players over all lineups (ties by name), with the share of the requested lineups."""
    counts = lineups.groupBy("player_id", "name").agg(F.count("*").alias("exposure_count"))
    top = counts.orderBy(F.col("exposure_count").desc(), "name").limit(n)
    return top.withColumn("exposure_pct", F.round(F.col("exposure_count") * 100.0 / requested, 4))


# --- validation ------------------------------------------------------------------------------------------------


def _lineup_counts(lineups: DataFrame) -> DataFrame:
    """One aggregation with everything the validators need."""
    slot = F.upper("slot")
    return lineups.groupBy(*LINEUP_KEY).agg(
        F.count("*").alias("rows"),
        F.sum("salary").alias("total_salary"),
        *[F.count_if(F.col("pos") == p).alias(f"pos_{p}") for p in C.POSITIONS],
        *[F.count_if(F.col("slot") == s).alias(f"slot_{s}") for s in C.SLOT_NAMES],
        F.count_if(slot == "FLEX").alias("flex_rows"),
        F.max(F.when(slot == "FLEX", F.col("pos"))).alias("flex_pos"),
        F.count_if((F.col("slot") == "FLEX") & ~F.coalesce(F.col("pos").isin(*C.FLEX_POSITIONS), F.lit(False))).alias("bad_flex"),
        F.count_if(~F.coalesce(F.col("slot").isin(*C.SLOT_NAMES), F.lit(False))).alias("bad_slots"),
    )


def validate_lineups(lineups: DataFrame, cap: int = C.SALARY_CAP) -> DataFrame:
    """All rule violations of each lineup, in a fixed order; a wrong row count stops the other checks."""
    counts = _lineup_counts(lineups)
    total = F.col("total_salary")
    checks = [
        F.when(total > cap, F.concat(F.lit("Salary "), total.cast("string"), F.lit(f" exceeds cap {cap}")))
    ]
    for p, need in C.POSITION_MINIMUMS.items():
        have = F.col(f"pos_{p}")
        checks.append(F.when(have < need, F.concat(F.lit(f"Needs at least {need} {p}, has "), have.cast("string"))))
    checks.append(
        F.when(F.col("flex_rows") != 1, F.concat(F.lit("Expected exactly 1 FLEX, found "), F.col("flex_rows").cast("string")))
        .when(~F.coalesce(F.col("flex_pos").isin(*C.FLEX_POSITIONS), F.lit(False)), F.concat(F.lit("FLEX must be RB/WR/TE, got "), F.col("flex_pos")))
    )
    wrong_size = F.concat(F.lit(f"Expected {C.ROSTER_SIZE} players, got "), F.col("rows").cast("string"))
    errors = F.when(F.col("rows") != C.ROSTER_SIZE, F.array(wrong_size)).otherwise(F.array_compact(F.array(*checks)))
    return counts.select(*LINEUP_KEY, errors.alias("errors")).withColumn("n_errors", F.size("errors").cast("bigint"))


def check_slots(lineups: DataFrame, cap: int = C.SALARY_CAP) -> DataFrame:
    """Strict form with exact slot counts: the first failure of each lineup, or OK."""
    counts = _lineup_counts(lineups)
    text = lambda c: F.col(c).cast("string")
    checks = [
        F.when(F.col("rows") != C.ROSTER_SIZE, F.concat(F.lit(f"Expected {C.ROSTER_SIZE} rows, got "), text("rows"))),
        F.when(F.col("bad_slots") > 0, F.lit("Invalid slot(s)")),
    ]
    for p, need in C.POSITION_MINIMUMS.items():
        checks.append(F.when(F.col(f"slot_{p}") != need, F.concat(F.lit(f"Need {need} {p}, found "), text(f"slot_{p}"))))
    checks += [
        F.when(F.col("slot_FLEX") != 1, F.concat(F.lit("Need 1 FLEX, found "), text("slot_FLEX"))),
        F.when(F.col("bad_flex") > 0, F.lit("FLEX must be RB/WR/TE")),
        F.when(F.col("total_salary") > cap, F.concat(F.lit("Salary cap exceeded: "), text("total_salary"), F.lit(f" > {cap}"))),
    ]
    return counts.select(*LINEUP_KEY, F.coalesce(*checks, F.lit("OK")).alias("result"))


def validation_errors(lineups: DataFrame, cap: int = C.SALARY_CAP) -> DataFrame:
    """One row per violation: the error map of `validation_summary` as a table, for contests of any size."""
    return validate_lineups(lineups, cap).select(*LINEUP_KEY, F.posexplode("errors").alias("error_no", "error"))


def validation_summary(lineups: DataFrame, cap: int = C.SALARY_CAP) -> DataFrame:
    """Per contest: lineups, lineups with errors, the map from those lineups to their errors, and the overlap summary as a struct.

    The map's keys are the lineups as text, in the lineups' order; a lineup without an id has the key ``null``.
    """
    wrong = F.array_sort(F.collect_list(F.when(F.col("n_errors") > 0, F.struct("lineup", "errors"))))
    verdicts = validate_lineups(lineups, cap).groupBy("contest_id").agg(
        F.count("*").alias("total_lineups"), F.count_if(F.col("n_errors") > 0).alias("lineups_with_errors"), wrong.alias("_wrong")
    )
    entry = lambda e: F.struct(F.coalesce(e["lineup"].cast("string"), F.lit("null")).alias("key"), e["errors"].alias("value"))
    uniqueness = F.struct("min_pair_overlap", "min_pair_uniques", "worst_a", "worst_b")
    return verdicts.join(overlap_summary(lineups).hint("merge"), "contest_id").select(
        "contest_id", "total_lineups", "lineups_with_errors", F.map_from_entries(F.transform("_wrong", entry)).alias("errors"),
        uniqueness.alias("pairwise_uniqueness"),
    )


def assign_slots(lineups: DataFrame) -> DataFrame:
    """Slot of each player by order within its position; the skill player beyond the minimums is the FLEX."""
    within = F.row_number().over(W.partitionBy(*LINEUP_KEY, "pos").orderBy("player_id"))
    ranked = lineups.withColumn("_n", within)
    starter = reduce(lambda a, b: a | b, [(F.col("pos") == p) & (F.col("_n") <= n) for p, n in C.POSITION_MINIMUMS.items()])
    slot = F.when(starter, F.col("pos")).when(F.col("pos").isin(*C.FLEX_POSITIONS), F.lit("FLEX"))
    return ranked.withColumn("slot", slot).drop("_n")


def lineup_display_order(lineups: DataFrame) -> DataFrame:
    """Contest, lineup, slot, then dearest first."""
    return lineups.orderBy(*LINEUP_KEY, "slot", F.col("salary").desc(), "player_id")


# --- stacks and rules ------------------------------------------------------------------------------------------


def qb_stack_join(lineups: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Each QB with the WR/TE of the same lineup and team.  One aggregation by team replaces the self-join.

    ``within``: columns that have one value in each contest (see `contest_columns`); they stay in the rows.
    """
    role = F.col("pos")
    teams = (
        lineups.filter(role.isin("QB", *RECEIVERS) & F.col("team").isNotNull())
        .groupBy(*within, *LINEUP_KEY, "team")
        .agg(
            F.sort_array(F.collect_list(F.when(role == "QB", F.struct("player_id", "name")))).alias("_qbs"),
            F.sort_array(F.collect_list(F.when(role.isin(*RECEIVERS), F.struct("player_id", "name")))).alias("_receivers"),
        )
        .filter((F.size("_qbs") > 0) & (F.size("_receivers") > 0))
    )
    return teams.select(
        *within, *LINEUP_KEY, F.explode("_qbs").alias("_qb"), F.col("team").alias("qb_team"),
        F.array_join("_receivers.name", "; ").alias("receivers"), F.size("_receivers").cast("bigint").alias("stack_size"),
    ).select(*within, *LINEUP_KEY, F.col("_qb.player_id").alias("qb_id"), F.col("_qb.name").alias("qb"), "qb_team", "receivers", "stack_size")


def stack_sequence(lineups: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Stacks with their running number within the contest and the true lineup id.

    They are staged, because numbering them reads them twice.  ``within``: columns that have one value in each contest.
    """
    first = cut_lineage(top_per_key(qb_stack_join(lineups, within), [*within, *LINEUP_KEY], [F.col("qb_id")], 1).drop(*within))
    return running_number(first, ["contest_id"], "lineup", "stack_no")


def bring_back(lineups: DataFrame) -> DataFrame:
    """Per lineup: its QB, whether a WR/TE teammate is in it, and whether one from the QB's opponent is."""
    qb = F.min(F.when(F.col("pos") == "QB", F.struct("player_id", "name", "team", "opp"))).alias("qb")
    receiver_teams = F.collect_set(F.when(F.col("pos").isin(*RECEIVERS), F.col("team"))).alias("_teams")
    per_lineup = lineups.groupBy(*LINEUP_KEY).agg(qb, receiver_teams)
    has = lambda c: F.coalesce(F.array_contains("_teams", F.col(c)), F.lit(False))
    return per_lineup.select(
        *LINEUP_KEY, F.coalesce("qb.name", F.lit("Unknown")).alias("qb"), F.coalesce("qb.team", F.lit("Unknown")).alias("qb_team"),
        has("qb.team").alias("has_stack"), has("qb.opp").alias("bring_back"),
    )


def rb_vs_dst_conflicts(lineups: DataFrame) -> DataFrame:
    """RB and opposing DST in the same lineup."""
    backs = lineups.filter((F.col("pos") == "RB") & F.col("opp").isNotNull() & (F.col("opp") != C.UNKNOWN_OPPONENT)).select(
        *LINEUP_KEY, F.col("player_id").alias("rb_id"), F.col("opp").alias("_side")
    )
    defenses = lineups.filter(F.col("pos") == "DST").select(
        *LINEUP_KEY, F.col("player_id").alias("dst_id"), F.col("team").alias("_side")
    )
    return backs.join(defenses.hint("merge"), [*LINEUP_KEY, "_side"]).withColumnRenamed("_side", "dst_team")


def team_cap_check(lineups: DataFrame, max_team: int = 4) -> DataFrame:
    """Largest number of players of one team per lineup and whether it is within the limit."""
    known = F.col("team").isNotNull() & (F.col("team") != C.UNKNOWN_OPPONENT)
    per_team = lineups.groupBy(*LINEUP_KEY, "team").agg(F.when(known, F.count("*")).otherwise(F.lit(0)).alias("_n"))
    return per_team.groupBy(*LINEUP_KEY).agg(F.max("_n").alias("largest_team")).withColumn(
        "team_ok", F.col("largest_team") <= max_team
    )


def lineup_rule_audit(
    lineups: DataFrame, pool: DataFrame | None = None, cap: int = C.SALARY_CAP, floor: int = 0, stack: int = 1, max_team: int = 4
) -> DataFrame:
    """Every build rule as a boolean per lineup, from one aggregation of each lineup's rows.

    With the player pool (slate_id, pos, team), a QB whose team has no WR/TE in the pool is exempt from the stack rule.
    """
    known = F.col("team").isNotNull() & (F.col("team") != C.UNKNOWN_OPPONENT)
    faced = (F.col("pos") == "RB") & F.col("opp").isNotNull() & (F.col("opp") != C.UNKNOWN_OPPONENT)
    # by team first, so that what a lineup gathers is one row per team and position facts, however many rows it has
    teams = lineups.groupBy(*LINEUP_KEY, "slate_id", "team").agg(
        F.count("*").alias("rows"), F.sum("salary").alias("salary"), F.max(known).alias("_known"),
        *[F.count_if(F.col("pos") == p).alias(f"n_{p}") for p in C.POSITIONS],
        F.min(F.when(F.col("pos") == "QB", F.struct("player_id", "team"))).alias("_qb"),
        F.collect_set(F.when(faced, F.col("opp"))).alias("_faced"),
    )
    joined = teams.groupBy(*LINEUP_KEY, "slate_id").agg(
        F.sum("rows").alias("rows"), F.sum("salary").alias("total_salary"), *[F.sum(f"n_{p}").alias(f"n_{p}") for p in C.POSITIONS],
        F.min("_qb").alias("_qb"), F.max(F.when(F.col("team").isNotNull() & (F.col("n_QB") > 0), F.col("n_WR") + F.col("n_TE"))).alias("_stack"),
        F.max(F.when(F.col("_known"), F.col("rows")).otherwise(F.lit(0))).alias("largest_team"),
        F.arrays_overlap(F.flatten(F.collect_list("_faced")), F.collect_set(F.when(F.col("n_DST") > 0, F.col("team")))).alias("_conflict"),
    )
    exempt = F.lit(False)
    if pool is not None:
        receivers = pool.filter(F.col("pos").isin(*RECEIVERS)).select("slate_id", F.col("team").alias("_team")).distinct()
        joined = joined.withColumn("_team", F.col("_qb.team")).join(
            receivers.withColumn("_has_receivers", F.lit(True)), ["slate_id", "_team"], "left"
        )
        exempt = F.col("_has_receivers").isNull()
    return joined.select(
        *LINEUP_KEY,
        (F.col("rows") == C.ROSTER_SIZE).alias("size_ok"),
        ((F.col("n_QB") == 1) & (F.col("n_DST") == 1)).alias("single_slots_ok"),
        ((F.col("n_RB") >= 2) & (F.col("n_WR") >= 3) & (F.col("n_TE") >= 1)).alias("minimums_ok"),
        (F.col("n_RB") + F.col("n_WR") + F.col("n_TE") == C.SKILL_SLOTS).alias("skill_ok"),
        (F.col("total_salary") <= cap).alias("cap_ok"),
        (F.col("total_salary") >= floor).alias("floor_ok"),
        ((F.coalesce("_stack", F.lit(0)) >= stack) | exempt).alias("stack_ok"),
        (F.col("largest_team") <= max_team).alias("team_ok"),
        (~F.coalesce("_conflict", F.lit(False))).alias("no_rb_vs_dst"),
    )


# --- pairwise overlap ------------------------------------------------------------------------------------------


def _binomial(n: Column, j: Column) -> Column:
    """C(n, j) as a whole number."""
    factors = F.filter(F.sequence(F.lit(0), j), lambda i: i > 0)
    one = F.lit(1).cast("bigint")
    return F.aggregate(factors, one, lambda acc, i: F.call_function("div", acc * (n - j + i), i.cast("bigint")))


def _shared_nodes(members: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of a prefix tree over the lineups' sorted players: (places, nodes) of subsets that two or more lineups hold.

    places: contest_id, lineup, node (the subset), tail (the lineup's larger players); nodes: contest_id, node, n, rest.  A
    node is not grown further where its subtree is known: two lineups share the subsets of their common tail, and lineups
    with one and the same tail share all of its subsets.  `rest` is the size of that tail, null where the node is grown.
    """
    sets = members.groupBy(*LINEUP_KEY).agg(F.array_sort(F.collect_set("player_id")).alias("tail"))
    grown = sets.select(*LINEUP_KEY, F.array().cast(sets.schema["tail"].dataType).alias("node"), "tail")
    levels = []
    while True:
        item = grown.select(*LINEUP_KEY, "node", "tail", F.posexplode("tail").alias("_at", "_player"))
        places = item.select(
            *LINEUP_KEY,
            F.concat("node", F.array("_player")).alias("node"),
            F.slice("tail", F.col("_at") + 2, F.size("tail")).alias("tail"),
        )
        held = places.groupBy("contest_id", "node").agg(F.count("*").alias("n"), F.min("tail").alias("_low"), F.max("tail").alias("_high"))
        known = (F.col("n") == 2) | (F.col("_low") == F.col("_high"))
        rest = F.when(known, F.size(F.array_intersect("_low", "_high")))
        nodes = cut_lineage(held.filter("n > 1").select("contest_id", "node", "n", rest.alias("rest")))
        levels.append((places, nodes))
        unknown = nodes.filter("rest IS NULL").select("contest_id", "node")
        if unknown.isEmpty():
            return levels
        grown = cut_lineage(places.join(unknown, ["contest_id", "node"]).select(*LINEUP_KEY, "node", "tail"))


def _subset_sizes(held: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """(keys, t, b): the weight of a node for itself (t players) and for every subset of its known subtree."""
    rest = F.coalesce("rest", F.lit(0)).cast("bigint")
    alike = held.groupBy(*keys, F.size("node").alias("_depth"), rest.alias("_rest")).agg(F.sum(weight).alias("_w"))
    rows = alike.select("*", F.explode(F.sequence(F.lit(0), F.col("_rest").cast("int"))).alias("_j"))
    return rows.select(*keys, (F.col("_depth") + F.col("_j")).alias("t"), (F.col("_w") * _binomial(F.col("_rest"), F.col("_j"))).alias("b"))


def _exact_counts(moments: DataFrame, *keys: str) -> DataFrame:
    """(keys, shared, n): how many pairs share exactly that many players, from b pairs weighted by C(shared, t).

    Inclusion-exclusion: the sum over t >= shared of (-1)^(t - shared) C(t, shared) b.
    """
    totals = moments.groupBy(*keys, "t").agg(F.sum("b").alias("b"))
    parts = totals.select(*keys, "t", "b", F.explode(F.sequence(F.lit(0), "t")).alias("shared"))
    sign = F.when((F.col("t") - F.col("shared")) % 2 == 0, 1).otherwise(-1)
    term = sign * _binomial(F.col("t").cast("bigint"), F.col("shared")) * F.col("b")
    terms = parts.select(*keys, F.col("shared").cast("bigint").alias("shared"), term.alias("_term"))
    return terms.groupBy(*keys, "shared").agg(F.sum("_term").alias("n")).filter("n > 0")


SMALL_CONTEST = 64  # lineups of a contest whose pairs one row may hold
SMALL_CONTEST_PLAYERS = 2048


def _rosters(lineups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(small, members): contests of a bounded size with their pairs, and the lineups' players of the other contests.

    small: contest_id, pairs, an array of (shared, lineup_a, lineup_b).  A contest of 64 lineups has 2016 pairs, so its pairs
    are no more than 32 times its lineups; in larger contests no pairs are formed.
    """
    rosters = cut_lineage(lineups.groupBy(*LINEUP_KEY).agg(F.array_sort(F.collect_set("player_id")).alias("players")))
    sizes = rosters.groupBy("contest_id").agg(F.count("*").alias("_lineups"), F.sum(F.size("players")).alias("_players"))
    is_small = (F.col("_lineups") <= SMALL_CONTEST) & (F.col("_players") <= SMALL_CONTEST_PLAYERS)
    sized = rosters.alias("r").join(
        sizes.select(F.col("contest_id").alias("_contest"), is_small.alias("_small")).hint("merge"), F.col("contest_id").eqNullSafe(F.col("_contest"))
    ).select("r.*", "_small")
    entered = F.array_sort(F.collect_list(F.struct("lineup", "players")))
    gathered = sized.filter("_small").groupBy("contest_id").agg(entered.alias("_entered"))
    later = lambda i: F.slice("_entered", i + 2, F.size("_entered"))
    pair = lambda a, b: F.struct(
        F.size(F.array_intersect(a["players"], b["players"])).cast("bigint").alias("shared"), a["lineup"].alias("lineup_a"), b["lineup"].alias("lineup_b")
    )
    pairs = F.flatten(F.transform("_entered", lambda a, i: F.transform(later(i), lambda b: pair(a, b))))
    members = sized.filter("NOT _small").select(*LINEUP_KEY, F.explode_outer("players").alias("player_id"))
    return gathered.select("contest_id", pairs.alias("pairs")), members


def lineup_overlap(lineups: DataFrame) -> DataFrame:
    """Per contest, how many lineup pairs share exactly ``shared`` players; uniques = 18 - 2 x shared.

    The pairs of a small contest are counted one by one.  Of larger ones no pairs are formed: a subset of players that n
    lineups hold stands for C(n, 2) pairs, and inclusion-exclusion over the subsets' sizes gives the exact counts, whatever
    the size of a contest or a lineup.  Counts are 64-bit: two different lineups with more than about 50 players in common
    raise an overflow instead of a wrong count.
    """
    small, large = _rosters(lineups)
    counted = small.select("contest_id", F.explode("pairs.shared").alias("shared")).groupBy("contest_id", "shared").agg(F.count("*").alias("pairs"))
    members = cut_lineage(large)
    entered = members.select(*LINEUP_KEY).distinct().groupBy("contest_id").agg(F.count("*").alias("n"))
    pairs = F.expr("n * (n - 1) div 2")
    moments = entered.select("contest_id", F.lit(0).alias("t"), pairs.alias("b"))
    for _, nodes in _shared_nodes(members):
        moments = moments.unionByName(_subset_sizes(nodes, pairs, "contest_id"))
    histogram = _exact_counts(moments, "contest_id").withColumnRenamed("n", "pairs")
    return counted.unionByName(histogram).withColumn("uniques", 2 * C.ROSTER_SIZE - 2 * F.col("shared"))


def _partners(members: DataFrame) -> DataFrame:
    """(contest_id, lineup, shared, n): how many other lineups of the contest share exactly that many players with a lineup."""
    entered = members.select(*LINEUP_KEY).distinct()
    sizes = entered.groupBy("contest_id").agg((F.count("*") - 1).alias("b"))
    moments = entered.join(sizes, "contest_id").select(*LINEUP_KEY, F.lit(0).alias("t"), "b")
    for places, nodes in _shared_nodes(members):
        held = places.select(*LINEUP_KEY, "node", "tail").join(nodes, ["contest_id", "node"])
        moments = moments.unionByName(_subset_sizes(held, F.col("n") - 1, *LINEUP_KEY))
    return _exact_counts(moments, *LINEUP_KEY)


def _partner_of_first(members: DataFrame, first: DataFrame) -> DataFrame:
    """First later lineup whose overlap with the contest's lineup ``first`` is ``wanted``; linear in the contest."""
    chosen = members.join(first.select("contest_id", F.col("first").alias("lineup")), LINEUP_KEY).select("contest_id", "player_id")
    shared = members.join(chosen, ["contest_id", "player_id"]).groupBy(*LINEUP_KEY).agg(F.count("*").alias("shared"))
    later = members.select(*LINEUP_KEY).distinct().join(first, "contest_id").filter(F.col("lineup") > F.col("first"))
    hits = later.join(shared, LINEUP_KEY, "left").filter(F.coalesce("shared", F.lit(0)) == F.col("wanted"))
    return hits.groupBy("contest_id").agg(
        F.min(F.struct(F.col("first").alias("lineup_a"), F.col("lineup").alias("lineup_b"))).alias("pair")
    )


def overlap_summary(lineups: DataFrame) -> DataFrame:
    """Per contest the least overlap, the least uniques and the first pair with the least overlap.

    The first lineup with a partner at the least overlap starts that pair.  A contest with one lineup gives 0, 9 and no pair.
    """
    small, large = _rosters(lineups)
    members = cut_lineage(large)
    partners = cut_lineage(_partners(members))
    extremes = partners.groupBy("contest_id").agg(
        F.min(F.struct("shared", "lineup")).alias("least"), F.max("shared").alias("max_shared")
    )
    first = extremes.select("contest_id", F.col("least.lineup").alias("first"), F.col("least.shared").alias("wanted"))
    of_large = extremes.join(_partner_of_first(members, first), "contest_id", "left").select(
        "contest_id", F.col("least.shared").alias("min_shared"), "max_shared", "pair.lineup_a", "pair.lineup_b"
    )
    least = F.array_min("pairs")
    of_small = small.select(
        "contest_id", least["shared"].alias("min_shared"), F.array_max("pairs.shared").alias("max_shared"),
        least["lineup_a"].alias("lineup_a"), least["lineup_b"].alias("lineup_b"),
    )
    return of_small.unionByName(of_large).select(
        "contest_id",
        F.coalesce("min_shared", F.lit(0)).cast("bigint").alias("min_pair_overlap"),
        F.coalesce(2 * C.ROSTER_SIZE - 2 * F.col("max_shared"), F.lit(C.ROSTER_SIZE)).cast("bigint").alias("min_pair_uniques"),
        F.col("lineup_a").alias("worst_a"),
        F.col("lineup_b").alias("worst_b"),
    )
