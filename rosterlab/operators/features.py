"""Lagged rolling features and feature summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.operators.keyed import top_per_key
from rosterlab.session import cut_lineage

ROLLING_COLUMNS = {
    "fp_avg_3": "fantasy_points_ppr",
    "passing_yards_avg": "passing_yards",
    "rush_yards_avg": "rushing_yards",
    "targets_avg": "targets",
    "receptions_avg": "receptions",
    "receiving_yards_avg": "receiving_yards",
    "sacks_avg": "sacks",
    "interceptions_avg": "interceptions",
}
ROLLING_SUMS = {
    "fumbles_avg": ["sack_fumbles_lost", "rushing_fumbles_lost", "receiving_fumbles_lost"],
    "tds_avg": ["passing_tds", "rushing_tds", "receiving_tds", "special_teams_tds"],
}
NULL_FEATURES = ("aDOT_avg", "redzone_tgt_rate")


#: Rows of one player and week that one window takes; more are cut into ranges of about this many rows.
CUT_ROWS = 1 << 22


def cut_crowded_chunks(rows: DataFrame, key: str, chunk: Sequence[str], order: Sequence[str], width: int) -> DataFrame:
    """The rows with ``_cut``, which splits a chunk of more than ``width`` rows into ranges of about equal row counts.

    The rows of crowded chunks are dealt by range over key, chunk and order, with the borders drawn from a sample, and
    written once, so that a cut is the same for all who read it.  Rows with equal order stay together.
    """
    sizes = rows.groupBy(key, *chunk).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > width)
    crowded = cut_lineage(sizes)
    held = crowded.select(F.sum("_rows")).first()[0]
    if held is None:
        return rows.withColumn("_cut", F.lit(0))
    ranged = rows.join(crowded.drop("_rows"), [key, *chunk], "left_semi").repartitionByRange(-(-held // width), key, *chunk, *order)
    cut = cut_lineage(ranged.withColumn("_cut", F.spark_partition_id()))
    rest = rows.join(crowded.drop("_rows"), [key, *chunk], "left_anti").withColumn("_cut", F.lit(0))
    return rest.unionByName(cut)


def lagged_means(
    df: DataFrame,
    means: dict[str, Column],
    key: str = "player_id",
    chunk: Sequence[str] = ("season", "week"),
    order: Sequence[str] = ("seq",),
    lag: int = 3,
    cut_rows: int = CUT_ROWS,
) -> DataFrame:
    """Mean of each column over the key's previous ``lag`` rows, the current row excluded, nulls skipped.

    A key's history is cut into chunks (season and week by default).  Each chunk borrows the last ``lag`` rows before
    it, found from the chunks' own tails, and is then an ordinary window.  The result equals one window over the whole
    key, but a key with a third of all rows is spread over its chunks, and a chunk of more than ``cut_rows`` rows over
    ranges of about that many rows, whatever the weeks' sizes.
    """
    inputs = {name: f"_in_{i}" for i, name in enumerate(means)}
    rows = df.select("*", *[c.alias(inputs[n]) for n, c in means.items()])
    rows = cut_crowded_chunks(rows, key, chunk, order, cut_rows)
    chunk = [*chunk, "_cut"]
    carried = [*order, *inputs.values()]
    tails = top_per_key(rows.select(key, *chunk, *carried), [key, *chunk], [F.col(c).desc() for c in order], lag, "_from_end")

    # One row per chunk with its last rows, newest first; a chunk borrows from its nearest predecessors.
    newest_first = F.sort_array(F.collect_list(F.struct("_from_end", *carried)))
    chunks = tails.groupBy(key, *chunk).agg(newest_first.alias("_tail"))
    history = W.partitionBy(key).orderBy(*chunk)
    before = F.array_compact(F.array(*[F.lag("_tail", step).over(history) for step in range(1, lag + 1)]))
    borrowed = chunks.withColumn("_before", before).select(key, *chunk, F.posexplode(F.slice(F.flatten("_before"), 1, lag)).alias("_back", "_row"))
    halo = borrowed.select(key, *chunk, *[F.col(f"_row.{c}").alias(c) for c in carried], (F.col("_back") + 1).alias("_back"))
    together = rows.withColumn("_back", F.lit(0)).unionByName(halo, allowMissingColumns=True)
    frame = W.partitionBy(key, *chunk).orderBy(F.col("_back").desc(), *order).rowsBetween(-lag, -1)
    result = together.select(*df.columns, "_back", *[F.avg(inputs[n]).over(frame).alias(n) for n in means])
    return result.filter(F.col("_back") == 0).drop("_back")


def rolling_features(weekly: DataFrame, columns: dict[str, str] = ROLLING_COLUMNS, **layout) -> DataFrame:
    """Three-row lagged means of the listed stats that exist; two features stay null columns."""
    present = {f: F.col(c) for f, c in columns.items() if c in weekly.columns}
    absent = [f for f, c in columns.items() if c not in weekly.columns]
    featured = lagged_means(weekly, present, **layout)
    return featured.select("*", *[F.lit(None).cast("double").alias(f) for f in (*absent, *NULL_FEATURES)])


def rolling_sums_of_columns(weekly: DataFrame, sums: dict[str, list[str]] = ROLLING_SUMS, **layout) -> DataFrame:
    """The same frame over sums of columns; a null addend makes the row's sum null."""
    means = {}
    for feature, addends in sums.items():
        total = F.col(addends[0])
        for addend in addends[1:]:
            total = total + F.col(addend)
        means[feature] = total
    return lagged_means(weekly, means, **layout)


def dst_placeholders(features: DataFrame) -> DataFrame:
    """All four defense columns become constants when any of them is absent."""
    if set(C.DEFENSE_PLACEHOLDERS) <= set(features.columns):
        return features
    return features.withColumns({c: F.lit(v) for c, v in C.DEFENSE_PLACEHOLDERS.items()})


def feature_summary(features: DataFrame) -> DataFrame:
    """Per position: rows, distinct values and range of the recent-points and passing features."""
    measured = [c for c in ("fp_avg_3", "passing_yards_avg") if c in features.columns]
    aggregates = []
    for c in measured:
        aggregates += [F.countDistinct(c).alias(f"{c}_distinct"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return features.groupBy("pos").agg(F.count("*").alias("players"), *aggregates)
