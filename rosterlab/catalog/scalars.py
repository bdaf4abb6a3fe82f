"""Projections, filters and scalar columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.catalog.inputs import (
    SQL_NORMALISED, SQL_SALARIES, raw_salaries, salary_table, sql_name_key, sql_team,
)
from rosterlab.catalog.registry import register
from rosterlab.fixtures import view
from rosterlab.functions import names as N
from rosterlab.functions import values as V
from rosterlab.operators import features, normalise
from rosterlab.session import scratch_path
from rosterlab.sources import salaries as S


@register("scan_salaries", "SELECT slate_id, id, name_text AS name, salary_text AS salary FROM v_raw_salary")
def scan_salaries(spark, d):
    """The whole feed as CSV, scanned as text."""
    path = scratch_path(spark, "salaries")
    raw_salaries(spark, d).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    feed = S.scan_salaries(spark, path)
    return feed.select(F.col("slate_id").cast("bigint").alias("slate_id"), F.col("id").cast("bigint").alias("id"), F.col("Name").alias("name"), F.col("Salary").alias("salary"))


@register(
    "resolve_synonyms",
    """SELECT slate_id, id AS player_id, name_text AS name, position_text AS pos, salary_text AS proj_points,
              team_text AS team, opponent_text AS opp FROM v_raw_salary""",
)
def resolve_synonyms(spark, d):
    raw = raw_salaries(spark, d).withColumnsRenamed(
        {"Name": "Player Name", "Position": "POSITION", "Salary": "FPTS", "TeamAbbrev": "Tm", "id": "ID"}
    )
    return S.resolve_synonyms(raw, keep=("slate_id",))


@register(
    "override_columns",
    """SELECT slate_id, id, name_text AS name, roster_position AS pos, team_text AS team, salary_text AS salary,
              game_text AS game_info FROM v_raw_salary""",
)
def override_columns(spark, d):
    raw = raw_salaries(spark, d).withColumn("Team", F.lit("ignored")).withColumnRenamed("GameInfo", "Game Info")
    return S.override_columns(raw, keep=("slate_id", "id"))


@register(
    "scan_weekly",
    """SELECT player_id, season, week, seq, pos, fantasy_points_ppr, passing_yards, targets FROM v_weekly
       WHERE pos IS NOT NULL AND fantasy_points_ppr IS NOT NULL""",
)
def scan_weekly(spark, d):
    weekly = view(spark, d, "v_weekly").withColumnRenamed("pos", "position")
    rows = S.scan_weekly(weekly, keep=("seq",))
    return rows.select("player_id", "season", "week", "seq", "pos", "fantasy_points_ppr", "passing_yards", "targets")


@register("name_key", f"SELECT id, {sql_name_key('name_text')} AS name_key FROM v_raw_salary")
def name_key(spark, d):
    return view(spark, d, "v_raw_salary").select("id", N.name_key(F.col("name_text")).alias("name_key"))


@register("canon_team", f"SELECT id, {sql_team('team_text')} AS team FROM v_raw_salary")
def canon_team(spark, d):
    return view(spark, d, "v_raw_salary").select("id", N.canon_team(F.col("team_text")).alias("team"))


@register("is_dst", f"SELECT id, is_dst FROM ({SQL_NORMALISED})")
def is_dst(spark, d):
    return view(spark, d, "v_raw_salary").select("id", N.is_defense(F.col("name_text")).alias("is_dst"))


@register("parse_game_info", f"SELECT id, away, home, game_date FROM ({SQL_NORMALISED})")
def parse_game_info(spark, d):
    game = F.col("game_text")
    return view(spark, d, "v_raw_salary").select(
        "id", N.canon_team(N.game_away(game)).alias("away"), N.canon_team(N.game_home(game)).alias("home"),
        N.game_date(game).alias("game_date"),
    )


@register("derive_opponent", f"SELECT id, opp FROM ({SQL_NORMALISED})")
def derive_opponent(spark, d):
    return normalise.normalise_salaries(raw_salaries(spark, d), keep=("id",)).select("id", "opp")


@register("is_home", f"SELECT id, is_home FROM ({SQL_NORMALISED})")
def is_home(spark, d):
    return normalise.normalise_salaries(raw_salaries(spark, d), keep=("id",)).select("id", "is_home")


@register(
    "pick_position",
    "SELECT id, CASE WHEN position_text IS NULL THEN upper(split_part(roster_position, '/', 1)) ELSE upper(trim(position_text)) END AS pos FROM v_raw_salary",
)
def pick_position(spark, d):
    return view(spark, d, "v_raw_salary").select(
        "id", N.pick_position(F.col("position_text"), F.col("roster_position")).alias("pos")
    )


@register(
    "canon_position",
    """SELECT id, CASE WHEN p IN ('DEF', 'D') THEN 'DST' ELSE p END AS pos, CASE WHEN r IN ('DEF', 'D') THEN 'DST' ELSE r END AS roster_pos
       FROM (SELECT id, upper(trim(split_part(position_text, '/', 1))) AS p, upper(trim(split_part(roster_position, '/', 1))) AS r FROM v_raw_salary)""",
)
def canon_position(spark, d):
    return view(spark, d, "v_raw_salary").select(
        "id", N.canon_position(F.col("position_text")).alias("pos"), N.canon_position(F.col("roster_position")).alias("roster_pos")
    )


@register(
    "coerce_projections",
    """SELECT part_id, feed_seq, TRY_CAST(points_text AS DOUBLE) AS proj_points FROM v_projection_feed
       WHERE TRY_CAST(points_text AS DOUBLE) IS NOT NULL""",
)
def coerce_projections(spark, d):
    feed = view(spark, d, "v_projection_feed").withColumnRenamed("points_text", "proj_points")
    return normalise.coerce_projections(feed).select("part_id", "feed_seq", "proj_points")


@register(
    "valid_salaries",
    "SELECT id, TRY_CAST(salary_text AS DOUBLE) AS salary FROM v_raw_salary WHERE TRY_CAST(salary_text AS DOUBLE) > 0",
)
def valid_salaries(spark, d):
    rows = view(spark, d, "v_raw_salary").select("id", F.col("salary_text").alias("salary"))
    return normalise.valid_salaries(rows)


@register("normalise_salaries", f"SELECT * EXCLUDE (file_seq) FROM ({SQL_NORMALISED})")
def normalise_salaries(spark, d):
    return normalise.normalise_salaries(raw_salaries(spark, d), keep=("slate_id", "id"))


@register("points_per_k", "SELECT player_id, round(CAST(proj_points AS DOUBLE) / (salary / 1000.0::DOUBLE), 6) AS value FROM v_pool")
def points_per_k(spark, d):
    value = V.points_per_k(F.col("proj_points").cast("double"), F.col("salary"))
    return view(spark, d, "v_pool").select("player_id", F.round(value, 6).alias("value"))


@register("min_salary_filter", "SELECT player_id, salary FROM v_pool WHERE salary >= 4000")
def min_salary_filter(spark, d):
    return normalise.min_salary_filter(view(spark, d, "v_pool"), 4000).select("player_id", "salary")


@register(
    "noise_band",
    """SELECT player_id, CASE WHEN salary < 4500 THEN 0.08::DOUBLE WHEN salary <= 6500 THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END AS band
       FROM v_pool""",
)
def noise_band(spark, d):
    return view(spark, d, "v_pool").select("player_id", V.noise_band(F.col("salary")).alias("band"))


_UNIFORM = "(CAST('0x' || substr(md5(concat_ws('|', 42, k, player_id)), {}, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


@register(
    "perturb_projection",
    f"""SELECT slate_id, CAST(k AS INTEGER) AS k, player_id,
               round(proj_points::DOUBLE * (1 + sqrt(-2 * ln({_UNIFORM.format(1)})) * cos({_UNIFORM.format(14)} * 2 * pi())
                   * CASE WHEN salary < {C.NOISE_LOW_SALARY} THEN {C.NOISE_BANDS[0]} WHEN salary <= {C.NOISE_HIGH_SALARY} THEN {C.NOISE_BANDS[1]} ELSE {C.NOISE_BANDS[2]} END), 6) AS proj_points
        FROM v_pool, range(1, 21) AS t(k)""",
)
def perturb_projection(spark, d):
    pool = view(spark, d, "v_pool").select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    points = V.perturbed(F.col("proj_points").cast("double"), F.col("salary"), F.col("k"), F.col("player_id"), seed=42)
    return pool.select("slate_id", "k", "player_id", F.round(points, 6).alias("proj_points"))


@register(
    "split_name",
    """SELECT id, CASE WHEN len(w) >= 2 THEN w[1] ELSE name_text END AS first_name,
              CASE WHEN len(w) >= 2 THEN array_to_string(w[2:], ' ') ELSE '' END AS last_name
       FROM (SELECT id, name_text, string_split_regex(trim(name_text), '\\s+') AS w FROM v_raw_salary)""",
)
def split_name(spark, d):
    first, last = N.split_name(F.col("name_text"))
    return view(spark, d, "v_raw_salary").select("id", first.alias("first_name"), last.alias("last_name"))


@register(
    "abbrev_alias",
    """SELECT id AS player_id, substr(first_name, 1, 1) || '.' || last_name AS alias_name, 'nfl_api' AS source_name,
              0.9::DOUBLE AS confidence_score
       FROM v_players WHERE length(first_name) > 0 AND length(last_name) > 0""",
)
def abbrev_alias(spark, d):
    alias = N.abbrev_alias(F.col("first_name"), F.col("last_name"))
    return view(spark, d, "v_players").select(
        F.col("id").alias("player_id"), alias.alias("alias_name"), F.lit("nfl_api").alias("source_name"),
        F.lit(0.9).alias("confidence_score"),
    ).filter(F.col("alias_name").isNotNull())


_SQL_SIMILARITY = """CASE WHEN a = b THEN 1.0::DOUBLE
    ELSE least(1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))::DOUBLE
               + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END"""


@register(
    "name_similarity",
    f"""SELECT seq, round({_SQL_SIMILARITY}, 6) AS similarity
        FROM (SELECT x.seq, replace(replace(lower(strip_accents(x.name)), '.', ''), ' ', '') AS a, replace(replace(lower(y.name), '.', ''), ' ', '') AS b
              FROM v_source_a x JOIN v_source_b y ON x.seq = y.seq)""",
)
def name_similarity(spark, d):
    a, b = view(spark, d, "v_source_a"), view(spark, d, "v_source_b")
    pairs = a.select("seq", F.col("name").alias("a")).join(b.select("seq", F.col("name").alias("b")), "seq")
    return pairs.select("seq", F.round(N.name_similarity(N.fold_accents(F.col("a")), F.col("b")), 6).alias("similarity"))


# The checking engine's edit distance counts bytes, so the names compared above have their accents folded.
@register("name_similarity_sequence")
def name_similarity_sequence(spark, d):
    a, b = view(spark, d, "v_source_a"), view(spark, d, "v_source_b")
    pairs = a.select("seq", F.col("name").alias("a")).join(b.select("seq", F.col("name").alias("b")), "seq")
    return pairs.select("seq", N.sequence_similarity(F.col("a"), F.col("b")).alias("similarity"))


@register(
    "season_of",
    "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) = 1 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS BIGINT) AS season FROM orders",
)
def season_of(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", V.season_of(F.col("o_orderdate")).cast("bigint").alias("season"))


@register(
    "date_coerce",
    """SELECT o_orderkey, strftime(TRY_CAST(t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS game_date
       FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'TBD' ELSE CAST(o_orderdate AS STRING) END AS t FROM orders)""",
)
def date_coerce(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.when(F.col("o_orderstatus") == "P", "TBD").otherwise(F.col("o_orderdate").cast("string"))
    return orders.select("o_orderkey", F.date_format(V.coerce_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("game_date"))


@register(
    "default_salary",
    """SELECT id, coalesce(s, 2500) AS salary, CASE WHEN coalesce(s, 2500) <> 2500 THEN 'REAL' ELSE 'PLACEHOLDER' END AS salary_kind
       FROM (SELECT id, CAST(TRY_CAST(salary_text AS DOUBLE) AS BIGINT) AS s FROM v_raw_salary)""",
)
def default_salary(spark, d):
    salary = V.default_salary(V.to_number(F.col("salary_text")).cast("bigint"))
    return view(spark, d, "v_raw_salary").select(
        "id", salary.cast("bigint").alias("salary"), V.salary_kind(salary).alias("salary_kind")
    )


@register(
    "linear_fallback",
    """SELECT seq, round((coalesce(fantasy_points_ppr, 0) + coalesce(passing_yards, 0)) * 0.01::DOUBLE, 6) AS score FROM v_weekly""",
)
def linear_fallback(spark, d):
    score = V.linear_fallback([F.col("fantasy_points_ppr"), F.col("passing_yards")])
    return view(spark, d, "v_weekly").select("seq", F.round(score, 6).alias("score"))


@register(
    "constant_fallback",
    "SELECT seq, CASE WHEN pos = 'DST' THEN 10.0::DOUBLE ELSE fantasy_points_ppr END AS proj_points FROM v_weekly",
)
def constant_fallback(spark, d):
    points = V.constant_fallback(F.col("pos"), F.col("fantasy_points_ppr"))
    return view(spark, d, "v_weekly").select("seq", points.alias("proj_points"))


@register(
    "dst_placeholders",
    """SELECT player_id, 2.1::DOUBLE AS sacks_avg, 1.0::DOUBLE AS takeaways_avg, 22.0::DOUBLE AS opp_points_allowed,
              2.5::DOUBLE AS opp_sacks_allowed FROM v_pool""",
)
def dst_placeholders(spark, d):
    return features.dst_placeholders(view(spark, d, "v_pool").select("player_id", F.lit(9.9).alias("sacks_avg")))


@register(
    "salary_rows",
    f"SELECT slate_id, id, name, pos, team, salary FROM ({SQL_SALARIES})",
)
def salary_rows(spark, d):
    return salary_table(spark, d).select("slate_id", "id", "name", "pos", "team", "salary")
