"""Crosswalk, identifier and match audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.functions import names as N
from rosterlab.functions.values import exact_ratio, to_number
from rosterlab.operators.keyed import top_per_key


def _source_ids(crosswalk: DataFrame, source: str) -> DataFrame:
    return crosswalk.filter(F.col("source_name") == source)


def _known_ids(crosswalk: DataFrame, source: str) -> DataFrame:
    ids = _source_ids(crosswalk, source).select(F.trim("external_id").alias("id"))
    return ids.filter(F.col("id") != "").distinct()


def crosswalk_coverage(salaries: DataFrame, crosswalk: DataFrame, source: str = C.SALARY_SOURCE) -> DataFrame:
    """Per slate: distinct salary ids, how many the crosswalk knows, the share and a verdict.

    EXCELLENT needs 99 % and no duplicated id in the source's crosswalk, GOOD needs 95 %.
    """
    ids = salaries.select("slate_id", F.trim("id").alias("id")).filter(F.col("id") != "").distinct()
    known = _known_ids(crosswalk, source).withColumn("_known", F.lit(True))
    counts = ids.join(known, "id", "left").groupBy("slate_id").agg(
        F.count("*").alias("slate_ids"), F.count_if(F.col("_known").isNotNull()).alias("covered")
    )
    repeated = duplicate_ids(crosswalk, source).agg(F.count("*")).scalar()
    rated = counts.withColumn("coverage_pct", exact_ratio(F.col("covered") * 100, F.col("slate_ids"), 2)).withColumn(
        "duplicate_ids", repeated
    )
    verdict = (
        F.when((F.col("coverage_pct") >= 99) & (F.col("duplicate_ids") == 0), "EXCELLENT")
        .when(F.col("coverage_pct") >= 95, "GOOD").otherwise("NEEDS WORK")
    )
    return rated.withColumn("verdict", verdict)


def duplicate_ids(crosswalk: DataFrame, source: str = C.SALARY_SOURCE) -> DataFrame:
    """External ids that occur more than once in a source's crosswalk."""
    counts = _source_ids(crosswalk, source).groupBy("external_id").agg(F.count("*").alias("occurrences"))
    return counts.filter(F.col("occurrences") > 1)


def entities_with_many_ids(crosswalk: DataFrame, source: str = C.SALARY_SOURCE) -> DataFrame:
    """Entities with more than one distinct id, one row per id, so an entity's ids are never gathered."""
    pairs = _source_ids(crosswalk, source).select("entity_id", "external_id").distinct()
    many = pairs.groupBy("entity_id").agg(F.count("*").alias("n_ids")).filter(F.col("n_ids") > 1)
    return pairs.join(many, "entity_id")


def missing_ids(salaries: DataFrame, crosswalk: DataFrame, source: str = C.SALARY_SOURCE) -> DataFrame:
    """Salary rows whose id the crosswalk lacks."""
    known = _known_ids(crosswalk, source)
    return salaries.withColumn("id", F.trim("id")).filter(F.col("id") != "").join(known, "id", "left_anti").select(
        "slate_id", "id", "name", "pos", "team", "salary"
    )


def dst_coverage(salaries: DataFrame, crosswalk: DataFrame, source: str = C.SALARY_SOURCE) -> DataFrame:
    """Defense rows whose id the crosswalk lacks."""
    defenses = salaries.filter(F.col("pos") == "DST").withColumn("id", F.trim("id"))
    return defenses.join(_known_ids(crosswalk, source), "id", "left_anti").select("slate_id", "id", "name")


def identifier_overlap(left: DataFrame, right: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Exact overlap of two sets per measure: sizes, common values and share of the left set.

    ``columns`` maps a label to (left column, right column).
    """
    rows = None
    for label, (a, b) in columns.items():
        left_set = left.select(F.trim(F.col(a).cast("string")).alias("v")).filter(F.col("v").isNotNull()).distinct()
        right_set = right.select(F.trim(F.col(b).cast("string")).alias("v")).filter(F.col("v").isNotNull()).distinct()
        sides = left_set.withColumn("side", F.lit(1)).unionByName(right_set.withColumn("side", F.lit(2)))
        per_value = sides.groupBy("v").agg(F.sum("side").alias("sides"))
        row = per_value.agg(
            F.count_if(F.col("sides") != 2).alias("left_count"), F.count_if(F.col("sides") != 1).alias("right_count"),
            F.count_if(F.col("sides") == 3).alias("common"),
        ).select(
            F.lit(label).alias("measure"), "left_count", "right_count", "common",
            exact_ratio(F.col("common") * 100, F.col("left_count"), 1).alias("pct_of_left"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def names_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Trimmed distinct names present on both sides."""
    return left.select(F.trim("name").alias("name")).intersect(right.select(F.trim("name").alias("name")))


def distinct_players(rows: DataFrame, keys: tuple[str, ...] = ("name", "pos", "team"), order: str = "seq") -> DataFrame:
    """First row per key in a stated order."""
    return top_per_key(rows, list(keys), [F.col(order)], 1)


def id_profile(rows: DataFrame, id_column: str = "id", name_column: str = "name", pos_column: str = "pos") -> DataFrame:
    """Rows, distinct players, distinct ids and the length range and mode of the ids."""
    unique = rows.select(F.col(id_column).alias("_id"), F.col(name_column).alias("_n"), F.col(pos_column).alias("_p")).distinct()
    lengths = unique.groupBy(F.length("_id").alias("id_length")).agg(F.count("*").alias("n"))
    spread = lengths.filter(F.col("id_length").isNotNull()).agg(
        F.min("id_length").cast("bigint").alias("min_length"), F.max("id_length").cast("bigint").alias("max_length"),
        F.max_by("id_length", F.struct("n", -F.col("id_length"))).cast("bigint").alias("mode_length"),
    )
    totals = rows.agg(F.count("*").alias("total_rows"))
    players = unique.agg(F.count("*").alias("distinct_players"), F.countDistinct("_id").alias("distinct_ids"))
    tagged = [t.withColumn("_k", F.lit(1)) for t in (totals, players, spread)]
    return tagged[0].join(tagged[1], "_k").join(tagged[2], "_k").drop("_k")


def id_prefixes(rows: DataFrame, id_column: str = "id", name_column: str = "name", pos_column: str = "pos", n: int = 10) -> DataFrame:
    """n most common three-character id prefixes over distinct players."""
    unique = rows.select(F.col(id_column).alias("_id"), F.col(name_column), F.col(pos_column)).distinct()
    counts = unique.groupBy(F.substring("_id", 1, 3).alias("prefix")).agg(F.count("*").alias("players"))
    return counts.orderBy(F.col("players").desc(), "prefix").limit(n)


def id_columns(rows: DataFrame) -> DataFrame:
    """Columns whose name contains "id", with their distinct value counts."""
    chosen = [c for c in rows.columns if "id" in c.lower()]
    counts = rows.agg(*[F.countDistinct(c).alias(c) for c in chosen])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in chosen])
    return counts.select(F.inline(pairs))


def numeric_ids(rows: DataFrame, id_column: str = "id") -> DataFrame:
    """How many ids parse as numbers."""
    return rows.agg(
        F.count("*").alias("total"), F.count(to_number(F.col(id_column))).alias("numeric_ids")
    ).withColumn("numeric_pct", exact_ratio(F.col("numeric_ids") * 100, F.col("total"), 1))


def name_traits(rows: DataFrame, name_column: str = "name") -> DataFrame:
    """Naming-pattern flags of each distinct name."""
    names = rows.select(F.col(name_column).alias("name")).distinct()
    return names.select("name", *[flag.alias(label) for label, flag in N.name_traits(F.col("name")).items()])


def match_rate(matches: DataFrame, method: str = "match_how") -> DataFrame:
    """Rows and share per match method; unmatched rows count as "unmatched"."""
    labelled = matches.groupBy(F.coalesce(F.col(method), F.lit("unmatched")).alias("method")).agg(F.count("*").alias("players"))
    total = matches.agg(F.count("*")).scalar()
    return labelled.withColumn("pct", exact_ratio(F.col("players") * 100, total, 2))


def issues_report(scored: DataFrame, slates: DataFrame) -> DataFrame:
    """Per slate: positions without any player, and players of a position without a prediction."""
    expected = slates.select("slate_id").distinct().select("slate_id", F.explode(F.array(*[F.lit(p) for p in C.POSITIONS])).alias("pos"))
    empty = expected.join(scored.select("slate_id", "pos").distinct(), ["slate_id", "pos"], "left_anti").select(
        "slate_id", "pos", F.lit("empty_position").alias("issue"), F.lit(0).cast("bigint").alias("players")
    )
    failed = scored.filter(F.col("proj_points").isNull()).groupBy("slate_id", "pos").agg(F.count("*").alias("players")).select(
        "slate_id", "pos", F.lit("prediction_error").alias("issue"), "players"
    )
    return empty.unionByName(failed)
