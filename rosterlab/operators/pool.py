"""Player-pool operators: opponents, salaries, feasibility checks and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.functions import names as N
from rosterlab.functions import values as V
from rosterlab.operators.keyed import top_per_key


def opponent_map(games: DataFrame) -> DataFrame:
    """team -> opponent per slate from (slate_id, game_text, seq); the last game that names a team wins."""
    token = F.split(F.trim("game_text"), r"\s+")[0]
    sides = games.filter(token.contains("@")).select(
        "slate_id", "seq",
        N.canon_team(F.substring_index(token, "@", 1)).alias("away"),
        N.canon_team(F.substr(token, F.locate("@", token) + 1)).alias("home"),
    )
    both = sides.select("slate_id", "seq", F.col("away").alias("team"), F.col("home").alias("map_opp")).unionByName(
        sides.select("slate_id", "seq", F.col("home").alias("team"), F.col("away").alias("map_opp"))
    )
    return both.groupBy("slate_id", "team").agg(F.max_by("map_opp", F.struct("seq", "map_opp")).alias("map_opp"))


def opponent_map_join(pool: DataFrame, games: DataFrame) -> DataFrame:
    """Canonical team; a null, empty or UNK opponent is filled from the game texts."""
    canonical = pool.withColumn("team", N.canon_team(F.col("team")))
    joined = canonical.join(opponent_map(games), ["slate_id", "team"], "left")
    unknown = F.col("opp").isNull() | F.upper("opp").isin("", C.UNKNOWN_OPPONENT)
    filled = F.when(unknown, F.coalesce("map_opp", F.lit(C.UNKNOWN_OPPONENT))).otherwise(F.col("opp"))
    return joined.withColumn("opp", filled).drop("map_opp")


def two_pass_salary_join(projections: DataFrame, salaries: DataFrame) -> DataFrame:
    """Salary by (name, pos), then by (lower-case name, pos), else the placeholder.

    Salaries carry ``seq``; the first row per key is used, so a duplicated salary name never multiplies projections.
    """
    exact = top_per_key(salaries, ["slate_id", "name", "pos"], [F.col("seq")], 1).select(
        "slate_id", "name", "pos", F.col("salary").alias("_exact")
    )
    folded = top_per_key(
        salaries.withColumn("_lower", F.lower("name")), ["slate_id", "_lower", "pos"], [F.col("seq")], 1
    ).select("slate_id", "_lower", "pos", F.col("salary").alias("_folded"))
    joined = (
        projections.withColumn("_lower", F.lower("name"))
        .join(exact, ["slate_id", "name", "pos"], "left")
        .join(folded, ["slate_id", "_lower", "pos"], "left")
    )
    found = F.coalesce("_exact", "_folded")
    salary = V.default_salary(found)
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_folded").isNotNull(), "case_insensitive").otherwise("none")
    return joined.select(
        *[c for c in projections.columns if c != "salary"], salary.alias("salary"), how.alias("salary_match"),
        V.salary_kind(salary).alias("salary_kind"),
    )


def last_wins_lookup(projections: DataFrame, salaries: DataFrame) -> DataFrame:
    """Salary of the last row with the same (lower-case name, pos); unmatched rows keep their own salary."""
    table = top_per_key(
        salaries.withColumn("_lower", F.lower("name")), ["slate_id", "_lower", "pos"], [F.col("seq").desc()], 1
    ).select("slate_id", "_lower", "pos", F.col("salary").alias("_looked_up"))
    joined = projections.withColumn("_lower", F.lower("name")).join(table, ["slate_id", "_lower", "pos"], "left")
    return joined.withColumn("salary", F.coalesce("_looked_up", "salary")).drop("_lower", "_looked_up")


def _tier_case(values: dict[str, list], column: int) -> Column:
    """Value of a tier column by (pos, salary) as one CASE expression over the fixed tier table."""
    chain = None
    for pos, tiers in values.items():
        for low, *means in tiers:
            hit = (F.col("pos") == pos) & (F.col("salary").isNotNull() if low is None else F.col("salary") >= low)
            value = F.lit(means[column])
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def salary_tier_join(pool: DataFrame) -> DataFrame:
    """Tier label and baseline feature means of each player's salary, clamped to the position's bounds.

    The tier table is fixed and tiny, so the range lookup is a CASE expression and costs neither a join nor a shuffle.
    """
    labels = {pos: [(low, label) for (low, *_), label in zip(tiers, C.TIER_LABELS, strict=True)] for pos, tiers in C.SALARY_TIERS.items()}
    tiered = pool.withColumn("tier", _tier_case(labels, 0))
    for index, feature in enumerate(("fp_avg_3", "passing_yards_avg", "rush_yards_avg", "targets_avg")):
        mean = _tier_case(C.SALARY_TIERS, index)
        bounded = mean
        for pos, bounds in C.TIER_BOUNDS.items():
            if feature in bounds:
                low, high = bounds[feature]
                bounded = F.when(F.col("pos") == pos, F.greatest(F.lit(low), F.least(F.lit(high), mean))).otherwise(bounded)
        tiered = tiered.withColumn(feature, bounded)
    return tiered


def position_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("slate_id", "pos").agg(F.count("*").alias("players"))


def _counts_by_slate(pool: DataFrame, pos: str = "pos") -> DataFrame:
    return pool.groupBy("slate_id").agg(*[F.count_if(F.col(pos) == p).alias(f"n_{p.lower()}") for p in C.POSITIONS])


def pool_preflight(pool: DataFrame) -> DataFrame:
    """Whether a slate has enough players to fill a roster, and the first lack if not."""
    counts = _counts_by_slate(pool)
    skill = F.col("n_rb") + F.col("n_wr") + F.col("n_te")
    reason = F.coalesce(
        *[F.when(F.col(f"n_{p.lower()}") < need, F.lit(f"needs {need} {p}")) for p, need in C.POSITION_MINIMUMS.items()],
        F.when(skill < C.SKILL_SLOTS, F.lit(f"needs {C.SKILL_SLOTS} skill players")),
    )
    return counts.withColumn("skill", skill).withColumn("ok", reason.isNull()).withColumn("reason", reason)


def position_availability(pool: DataFrame) -> DataFrame:
    """Required and available players per roster position; FLEX counts what the skill positions leave over."""
    counts = _counts_by_slate(pool)
    flex_used = sum(C.POSITION_MINIMUMS[p] for p in C.FLEX_POSITIONS)
    flex = F.greatest(F.lit(0), F.col("n_rb") + F.col("n_wr") + F.col("n_te") - flex_used).cast("bigint")
    rows = [
        F.struct(F.lit(p).alias("pos"), F.lit(need).cast("bigint").alias("required"), F.col(f"n_{p.lower()}").alias("available"))
        for p, need in C.POSITION_MINIMUMS.items()
    ]
    rows.append(F.struct(F.lit("FLEX").alias("pos"), F.lit(1).cast("bigint").alias("required"), flex.alias("available")))
    return counts.select("slate_id", F.inline(F.array(*rows))).withColumn("sufficient", F.col("available") >= F.col("required"))


def exact_quantiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles of a number column per key, one column each; keys without a number have no row.

    Two passes.  The first finds, with mergeable summaries whose rank error is at most 1/accuracy of the rows, two
    values around each quantile (the whole range for keys of at most ``accuracy`` rows).  The second counts the rows
    below exactly and sorts the distinct values between, about 8/accuracy of the rows.  No task holds one counter per
    distinct value of a key.
    """
    slack = 4 / accuracy
    around = [F.lit(float(f)) for q in quantiles.values() for f in (max(0.0, q - slack), min(1.0, q + slack))]
    present = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    bounds = present.groupBy("_key").agg(
        F.count("*").alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_most"),
        F.percentile_approx("_value", F.array(*around), accuracy).alias("_around"),
    )
    places = []
    for i, (name, q) in enumerate(quantiles.items()):
        few = F.col("_n") <= accuracy
        places.append(F.struct(
            F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("place"),
            F.when(few, F.col("_least")).otherwise(F.col("_around")[2 * i]).alias("low"),
            F.when(few, F.col("_most")).otherwise(F.col("_around")[2 * i + 1]).alias("high"),
        ))
    wanted = bounds.select(F.col("_key").alias("_for"), F.array(*places).alias("_places"))
    counted = present.groupBy("_key", "_value").agg(F.count("*").alias("_rows"))
    seen = counted.join(wanted, F.col("_key").eqNullSafe(F.col("_for"))).select("_key", "_value", "_rows", F.explode("_places").alias("_at"))
    # Everything below the window is one row of its own per quantile; it sorts before the window's values.
    below = F.col("_value") < F.col("_at.low")
    kept = (
        seen.filter(F.col("_value") <= F.col("_at.high"))
        .groupBy("_key", "_at.name", "_at.place", F.when(~below, F.col("_value")).alias("_in"))
        .agg(F.sum("_rows").alias("_rows"))
    )
    upto = F.sum("_rows").over(W.partitionBy("_key", "name").orderBy(F.col("_in").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    reached = kept.withColumn("_upto", upto)
    picked = reached.groupBy("_key", "name", "place").agg(
        F.min(F.when(F.col("_upto") > F.floor("place"), F.col("_in"))).alias("_lower"),
        F.min(F.when(F.col("_upto") > F.ceil("place"), F.col("_in"))).alias("_upper"),
    )
    between = (F.ceil("place") - F.col("place")) * F.col("_lower") + (F.col("place") - F.floor("place")) * F.col("_upper")
    found = picked.withColumn("_quantile", F.when(F.floor("place") == F.ceil("place"), F.col("_lower")).otherwise(between))
    return found.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("name") == n, F.col("_quantile"))).alias(n) for n in quantiles])


def salary_stats(pool: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, sample deviation, exact quartiles and range of the numeric salaries, and the invalid count."""
    amount = F.coalesce(V.to_number(F.col("salary")), F.lit(None).cast("double"))
    rows = pool.withColumn("_amount", amount)
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = exact_quantiles(rows, "slate_id", "_amount", quartiles, accuracy).withColumnRenamed("slate_id", "_slate")
    totals = rows.groupBy("slate_id").agg(
        F.count("_amount").alias("valid_count"),
        (F.count("*") - F.count("_amount")).alias("invalid_count"),
        F.avg("_amount").alias("mean_salary"),
        F.stddev_samp("_amount").alias("std_salary"),
        F.min("_amount").alias("min_salary"),
        F.max("_amount").alias("max_salary"),
    )
    joined = totals.join(found, F.col("slate_id").eqNullSafe(F.col("_slate")), "left")
    return joined.select(
        "slate_id", "valid_count", "invalid_count", "mean_salary", "std_salary", "min_salary", *quartiles, "max_salary"
    )


def column_quality(pool: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls, zeros and negatives of every projection column, in one pass, one row per slate and column."""
    words = ("projection", "points", "score")
    chosen = list(columns or [c for c in pool.columns if any(w in c.lower() for w in words)])
    measures = []
    for c in chosen:
        measures += [
            F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"),
            F.count_if(F.col(c) == 0).alias(f"{c}_zeros"),
            F.count_if(F.col(c) < 0).alias(f"{c}_negatives"),
            F.count_if((F.col("pos") == "DST") & F.col(c).isNotNull()).alias(f"{c}_dst"),
        ]
    totals = pool.groupBy("slate_id").agg(F.count("*").alias("total"), *measures)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"{c}_nulls").alias("nulls"), F.col(f"{c}_zeros").alias("zeros"),
            F.col(f"{c}_negatives").alias("negatives"), F.col(f"{c}_dst").alias("dst_with_projection"),
        )
        for c in chosen
    ]
    return totals.select("slate_id", "total", F.inline(F.array(*rows))).withColumn(
        "many_zeros", F.col("zeros") * 10 > F.col("total")
    )


def pool_quality(pool: DataFrame, required: Sequence[str] = ("name", "pos", "salary", "entity_id")) -> DataFrame:
    """Missing columns, nulls, non-numeric salaries and repeated entity ids per slate."""
    missing = [c for c in required if c not in pool.columns]

    def have(name: str, measure: Column) -> Column:
        return measure if name in pool.columns else F.lit(0).cast("bigint")

    entity = F.col("entity_id") if "entity_id" in pool.columns else F.lit(None)
    pos = F.col("pos") if "pos" in pool.columns else F.lit(None)
    salary = F.col("salary") if "salary" in pool.columns else F.lit(None).cast("string")
    # Repeats are counted from per-entity row counts, so a hot entity is summed before it moves.
    per_entity = pool.select("slate_id", entity.alias("_e"), pos.alias("_p"), salary.alias("_s")).groupBy("slate_id", "_e").agg(
        F.count("*").alias("_rows"),
        F.count_if(F.col("_p").isNull()).alias("_null_pos"),
        F.count_if(F.col("_s").isNull()).alias("_null_salary"),
        F.count_if(F.col("_s").isNotNull() & V.to_number(F.col("_s")).isNull()).alias("_text_salary"),
    )
    return per_entity.groupBy("slate_id").agg(
        F.sum("_rows").alias("total_players"),
        have("pos", F.sum("_null_pos")).alias("null_pos"),
        have("salary", F.sum("_null_salary")).alias("null_salary"),
        have("salary", F.sum("_text_salary")).alias("non_numeric_salary"),
        have("entity_id", F.sum(F.col("_rows") - 1)).alias("duplicate_entities"),
    ).withColumn("missing_columns", F.lit(", ".join(missing)))


def _ranked_by_salary(pool: DataFrame, dearest: bool, id_column: str) -> DataFrame:
    """The rows per (slate, pos) that the extreme lineup can use: one more than the position's minimum."""
    order = F.col("salary").desc() if dearest else F.col("salary")
    depth = max(C.POSITION_MINIMUMS.values()) + 1
    return top_per_key(pool, ["slate_id", "pos"], [order, F.col(id_column)], depth, "rank_in_pos")


def rank_in_position(pool: DataFrame, n: int = 3, dearest: bool = False, id_column: str = "player_id") -> DataFrame:
    """n cheapest (or dearest) players per position."""
    order = F.col("salary").desc() if dearest else F.col("salary")
    return top_per_key(pool, ["slate_id", "pos"], [order, F.col(id_column)], n, "rank_in_pos")


def _required(pos: Column) -> Column:
    chain = F.when(pos == "QB", C.POSITION_MINIMUMS["QB"])
    for p in C.POSITIONS[1:]:
        chain = chain.when(pos == p, C.POSITION_MINIMUMS[p])
    return chain


def greedy_lineup(pool: DataFrame, cap: int = C.SALARY_CAP, dearest: bool = False, id_column: str = "player_id") -> DataFrame:
    """Per slate the n cheapest (dearest) players per position and then the best remaining FLEX, one row per pick.

    A slate short of a position has one row with the error and no picks.
    """
    priced = pool.withColumn("salary", V.to_number(F.col("salary")).cast("bigint")).filter(F.col("salary").isNotNull())
    ranked = _ranked_by_salary(priced, dearest, id_column).withColumn("_need", _required(F.col("pos")))
    starters = ranked.filter(F.col("rank_in_pos") <= F.col("_need"))
    leftovers = ranked.filter(F.col("pos").isin(*C.FLEX_POSITIONS) & (F.col("rank_in_pos") == F.col("_need") + 1))
    order = F.col("salary").desc() if dearest else F.col("salary")
    flex = top_per_key(leftovers, ["slate_id"], [order, F.col(id_column)], 1)
    picks = starters.withColumn("slot", F.col("pos")).unionByName(flex.withColumn("slot", F.lit("FLEX")))
    counts = pool.select("slate_id").distinct().join(_counts_by_slate(priced), "slate_id", "left").fillna(0)
    lacks = [F.when(F.col(f"n_{p.lower()}") < need, F.lit(f"Not enough {p} players available")) for p, need in C.POSITION_MINIMUMS.items()]
    no_flex = F.when(
        F.col("n_rb") + F.col("n_wr") + F.col("n_te") < C.SKILL_SLOTS, F.lit("No FLEX eligible players available")
    )
    verdict = counts.select("slate_id", F.coalesce(*lacks, no_flex).alias("error"))
    totals = picks.groupBy("slate_id").agg(F.sum("salary").alias("total_salary"))
    summary = verdict.join(totals, "slate_id", "left").select(
        "slate_id", "error", F.when(F.col("error").isNull(), F.col("total_salary")).alias("total_salary")
    )
    chosen = picks.select("slate_id", "slot", "rank_in_pos", F.col(id_column), "pos", "salary")
    return summary.join(chosen, (summary["slate_id"] == chosen["slate_id"]) & summary["error"].isNull(), "left").select(
        summary["slate_id"], "slot", "rank_in_pos", id_column, "pos", "salary", "total_salary",
        (F.col("total_salary") <= cap).alias("under_cap"), (F.lit(cap) - F.col("total_salary")).alias("remaining"), "error",
    )


def extreme_lineup_cost(pool: DataFrame, dearest: bool = False, id_column: str = "player_id") -> DataFrame:
    """Cost of the cheapest (dearest) roster of each slate; null when a position is short."""
    priced = pool.withColumn("salary", V.to_number(F.col("salary")).cast("bigint")).filter(F.col("salary").isNotNull())
    ranked = _ranked_by_salary(priced, dearest, id_column).withColumn("_need", _required(F.col("pos")))
    starter = F.col("rank_in_pos") <= F.col("_need")
    spare = F.when(F.col("pos").isin(*C.FLEX_POSITIONS) & (F.col("rank_in_pos") == F.col("_need") + 1), F.col("salary"))
    filled = [F.count_if(starter & (F.col("pos") == p)) == need for p, need in C.POSITION_MINIMUMS.items()]
    complete = filled[0]
    for f in filled[1:]:
        complete = complete & f
    best_spare = (F.max if dearest else F.min)(spare)
    cost = ranked.groupBy("slate_id").agg(
        F.when(complete, F.sum(F.when(starter, F.col("salary"))) + F.coalesce(best_spare, F.lit(0))).alias("cost")
    )
    return pool.select("slate_id").distinct().join(cost, "slate_id", "left")


def cheapest_lineup(pool: DataFrame) -> DataFrame:
    return extreme_lineup_cost(pool).withColumnRenamed("cost", "cheapest")


def dearest_lineup(pool: DataFrame) -> DataFrame:
    return extreme_lineup_cost(pool, dearest=True).withColumnRenamed("cost", "dearest")


def feasibility(pool: DataFrame, cap: int = C.SALARY_CAP) -> DataFrame:
    """Verdict per slate: data, positions, salaries and projections, and the list of critical issues."""
    positions = position_availability(pool).groupBy("slate_id").agg(F.min("sufficient").alias("positions_ok"))
    quality = column_quality(pool, ["proj_points"]).select(
        "slate_id", ((F.col("nulls") == 0) & ~F.col("many_zeros") & (F.col("negatives") == 0)).alias("projections_ok")
    )
    data = pool_quality(pool).select(
        "slate_id", ((F.col("null_salary") == 0) & (F.col("missing_columns") == "")).alias("data_ok")
    )
    salary = cheapest_lineup(pool).select("slate_id", "cheapest", F.coalesce(F.col("cheapest") <= cap, F.lit(False)).alias("salary_ok"))
    joined = data.join(positions, "slate_id").join(salary, "slate_id").join(quality, "slate_id")
    issues = F.array_compact(
        F.array(
            F.when(~F.col("data_ok"), F.lit("Basic Data")),
            F.when(~F.col("positions_ok"), F.lit("Position Counts")),
            F.when(~F.col("salary_ok"), F.lit("Salary Constraints")),
        )
    )
    return joined.withColumn("critical_issues", F.array_join(issues, "; ")).withColumn("feasible", F.size(issues) == 0)
