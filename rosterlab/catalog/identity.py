"""Identity joins, lookups, matching, audits and bulk upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlab.catalog.inputs import SQL_FEED, SQL_SALARIES, projection_feed, salary_table, sql_name_key
from rosterlab.catalog.registry import register
from rosterlab.fixtures import view
from rosterlab.functions import names as N
from rosterlab.operators import audit as A
from rosterlab.operators import identity as I
from rosterlab.operators.keyed import latest_per_key

# --- crosswalk -------------------------------------------------------------------------------------------------

_FIRST = """(SELECT external_id AS id, entity_id FROM v_crosswalk WHERE source_name = 'draftkings'
             QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY seq) = 1)"""
_POOL_COLUMNS = """s.slate_id, s.name, s.pos, s.team, s.salary, p.proj_points, s.id AS dk_id, x.entity_id,
    'crosswalk' AS match_method, coalesce(p.opp, 'UNK') AS opp, round(p.proj_points / (s.salary / 1000.0::DOUBLE), 6) AS value"""
_LAST = """SELECT * FROM ({feed}) WHERE {key} IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY slate_id, {key} ORDER BY feed_seq DESC, proj_points DESC) = 1"""
SQL_BY_ID = f"""SELECT {_POOL_COLUMNS} FROM ({SQL_SALARIES}) s JOIN {_FIRST} x ON x.id = s.id
    JOIN ({_LAST.format(feed=SQL_FEED, key='player_id')}) p ON p.slate_id = s.slate_id AND p.player_id = x.entity_id"""
_NAMELESS = f"(SELECT slate_id FROM ({SQL_FEED}) GROUP BY slate_id HAVING max(CASE WHEN player_id IS NULL THEN 0 ELSE 1 END) = 0)"
SQL_BY_NAME = f"""SELECT {_POOL_COLUMNS} FROM ({SQL_SALARIES}) s JOIN {_FIRST} x ON x.id = s.id
    JOIN ({_LAST.format(feed=SQL_FEED, key='name')}) p ON p.slate_id = s.slate_id AND p.name = s.name
    WHERE s.slate_id IN {_NAMELESS}"""


def _pool_inputs(spark, d):
    return salary_table(spark, d), view(spark, d, "v_crosswalk"), projection_feed(spark, d)


def _rounded(pool):
    return pool.withColumn("value", F.round("value", 6))


@register("crosswalk_join", SQL_BY_ID)
def crosswalk_join(spark, d):
    return _rounded(I.crosswalk_join(*_pool_inputs(spark, d)))


@register("name_fallback_join", SQL_BY_NAME)
def name_fallback_join(spark, d):
    return _rounded(I.name_fallback_join(*_pool_inputs(spark, d)))


@register("build_pool", f"({SQL_BY_ID}) UNION ALL ({SQL_BY_NAME})")
def build_pool(spark, d):
    return _rounded(I.build_pool(*_pool_inputs(spark, d)))


@register(
    "unmatched_report",
    f"""SELECT slate_id, id, name, pos, team, CASE WHEN entity_id IS NULL THEN 'no_crosswalk' ELSE 'no_projection' END AS reason
        FROM (SELECT s.*, x.entity_id,
                     EXISTS (SELECT 1 FROM ({SQL_FEED}) f WHERE f.slate_id = s.slate_id AND f.player_id = x.entity_id) AS by_id,
                     s.slate_id IN {_NAMELESS} AND EXISTS (SELECT 1 FROM ({SQL_FEED}) f WHERE f.slate_id = s.slate_id AND f.name = s.name) AS by_name
              FROM ({SQL_SALARIES}) s LEFT JOIN {_FIRST} x ON x.id = s.id)
        WHERE entity_id IS NULL OR NOT (by_id OR by_name)""",
)
def unmatched_report(spark, d):
    return I.unmatched_report(*_pool_inputs(spark, d))


# --- lookups ---------------------------------------------------------------------------------------------------


@register(
    "lookup_by_external_id",
    """SELECT r.request_id, r.source_name, r.external_id, p.id AS player_id, p.canonical_name, e.external_name, e.confidence_score
       FROM v_id_requests r JOIN v_external_ids e ON e.source_name = r.source_name AND e.external_id = r.external_id
       JOIN v_players p ON p.id = e.player_id""",
)
def lookup_by_external_id(spark, d):
    found = I.lookup_by_external_id(view(spark, d, "v_id_requests"), view(spark, d, "v_players"), view(spark, d, "v_external_ids"))
    return found.select("request_id", "source_name", "external_id", "player_id", "canonical_name", "external_name", "confidence_score")


_SQL_LOOKUP = """
    SELECT request_id, name, source_name, player_id, found_by, confidence_score
    FROM (SELECT r.request_id, r.name, r.source_name, p.id AS player_id, 'canonical' AS found_by, 1.0::DOUBLE AS confidence_score, 1 AS tier
          FROM {requests} r JOIN v_players p ON p.canonical_name = r.name
          UNION ALL
          SELECT r.request_id, r.name, r.source_name, a.player_id, 'alias', a.confidence_score, 2
          FROM {requests} r JOIN v_aliases a ON a.alias_name = r.name
          WHERE r.source_name IS NULL OR a.source_name IS NULL OR a.source_name = r.source_name)
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, confidence_score DESC, player_id) = 1"""


@register("lookup_by_name", _SQL_LOOKUP.format(requests="v_name_requests"))
def lookup_by_name(spark, d):
    return I.lookup_by_name(view(spark, d, "v_name_requests"), view(spark, d, "v_players"), view(spark, d, "v_aliases"))


@register(
    "ids_of_player",
    """SELECT e.player_id, p.canonical_name, e.source_name, e.external_id, e.external_name, e.confidence_score
       FROM v_external_ids e JOIN v_players p ON p.id = e.player_id""",
)
def ids_of_player(spark, d):
    return I.ids_of_player(view(spark, d, "v_players"), view(spark, d, "v_external_ids"))


@register(
    "aliases_of_player",
    """SELECT a.player_id, p.canonical_name, a.alias_name, a.source_name, a.confidence_score
       FROM v_aliases a JOIN v_players p ON p.id = a.player_id""",
)
def aliases_of_player(spark, d):
    return I.aliases_of_player(view(spark, d, "v_players"), view(spark, d, "v_aliases"))


@register(
    "name_map_join",
    """SELECT r.request_id, r.source_name, r.name, coalesce(m.normalized_name, r.name) AS normalized_name
       FROM v_name_requests r LEFT JOIN (SELECT a.source_name, a.alias_name, min(p.canonical_name) AS normalized_name
            FROM v_aliases a JOIN v_players p ON p.id = a.player_id GROUP BY ALL) m
       ON m.source_name = r.source_name AND m.alias_name = r.name""",
)
def name_map_join(spark, d):
    players = view(spark, d, "v_players").select(F.col("id").alias("player_id"), "canonical_name")
    table = view(spark, d, "v_aliases").join(players, "player_id").groupBy(
        F.col("source_name").alias("source"), F.col("alias_name").alias("player_name")
    ).agg(F.min("canonical_name").alias("normalized_name"))
    return I.name_map_join(view(spark, d, "v_name_requests"), table).select("request_id", "source_name", "name", "normalized_name")


@register(
    "search_players",
    """SELECT query, rank, id, canonical_name, position, team, search_score FROM (
         SELECT query, id, canonical_name, position, team, search_score,
                CAST(row_number() OVER (PARTITION BY query ORDER BY search_score DESC, id) AS INT) AS rank
         FROM (SELECT DISTINCT q.query, p.id, p.canonical_name, p.position, p.team, coalesce(a.confidence_score, 1.0::DOUBLE) AS search_score
               FROM v_players p LEFT JOIN v_aliases a ON a.player_id = p.id
               JOIN v_name_queries q ON contains(lower(p.canonical_name), q.query) OR contains(lower(p.first_name), q.query)
                    OR contains(lower(p.last_name), q.query) OR contains(lower(a.alias_name), q.query))) WHERE rank <= 10""",
)
def search_players(spark, d):
    return I.search_players(view(spark, d, "v_players"), view(spark, d, "v_aliases"), view(spark, d, "v_name_queries"))


# --- matching --------------------------------------------------------------------------------------------------

_SQL_KEYED = """
    keyed_a AS (SELECT a_id, name, pos, team, {ka} AS k FROM v_source_a),
    keyed_b AS (SELECT b_id, name, pos, team, {kb} AS k FROM v_source_b),
    rungs_a AS (SELECT *, substr(k, 1, 1) AS ini, split_part(k, ' ', -1) AS fam, contains(k, ' ') AS two FROM keyed_a),
    rungs_b AS (SELECT *, substr(k, 1, 1) AS ini, split_part(k, ' ', -1) AS fam, contains(k, ' ') AS two FROM keyed_b),
    hits AS (
      SELECT a.a_id, 1 AS rung, min(b.b_id) AS b_id FROM rungs_a a JOIN rungs_b b ON a.k = b.k WHERE a.k <> '' GROUP BY 1
      UNION ALL
      SELECT a.a_id, 2, min(b.b_id) FROM rungs_a a JOIN rungs_b b ON a.two AND b.two AND a.ini = b.ini AND a.fam = b.fam AND a.pos = b.pos GROUP BY 1
      UNION ALL
      SELECT a.a_id, 3, min(b.b_id) FROM rungs_a a JOIN rungs_b b ON a.two AND b.two AND a.fam = b.fam AND a.team = b.team GROUP BY 1
      UNION ALL
      SELECT a.a_id, 4, min(b.b_id) FROM rungs_a a JOIN rungs_b b ON a.two AND b.two AND a.fam = b.fam GROUP BY 1 HAVING count(*) = 1
      UNION ALL
      SELECT a.a_id, 5, min(b.b_id) FROM rungs_a a JOIN rungs_b b ON a.pos = 'DST' AND b.pos = 'DST' AND a.team = b.team GROUP BY 1),
    cascade AS (
      SELECT a.a_id, a.name, a.pos, a.team, h.b_id, b.name AS b_name,
             CASE h.rung WHEN 1 THEN 'exact' WHEN 2 THEN 'initial+last' WHEN 3 THEN 'last+team' WHEN 4 THEN 'last-unique' WHEN 5 THEN 'dst-team' END AS match_how
      FROM v_source_a a LEFT JOIN (SELECT a_id, rung, b_id FROM hits QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY rung) = 1) h ON h.a_id = a.a_id
      LEFT JOIN v_source_b b ON b.b_id = h.b_id)""".format(ka=sql_name_key("name"), kb=sql_name_key("name"))


def _cascade(spark, d):
    return I.match_cascade(view(spark, d, "v_source_a"), view(spark, d, "v_source_b"))


@register("match_cascade", f"WITH {_SQL_KEYED} SELECT * FROM cascade")
def match_cascade(spark, d):
    return _cascade(spark, d)


@register(
    "match_rate",
    f"""WITH {_SQL_KEYED} SELECT coalesce(match_how, 'unmatched') AS method, count(*) AS players,
               floor((count(*) * 20000 + (SELECT count(*) FROM cascade)) / (2 * (SELECT count(*) FROM cascade))) / 100 AS pct
        FROM cascade GROUP BY 1""",
)
def match_rate(spark, d):
    return A.match_rate(_cascade(spark, d))


_SQL_SIMILARITY = """CASE WHEN {a} = {b} THEN 1.0::DOUBLE
    ELSE least(1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE
               + CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END"""
_SQL_TEXT = "replace(replace(lower(strip_accents({x})), '.', ''), ' ', '')"


@register(
    "match_candidates",
    f"""WITH a AS (SELECT a_id, name, pos, team, {_SQL_TEXT.format(x='name')} AS ta FROM v_source_a),
        b AS (SELECT b_id, name, pos, team, {_SQL_TEXT.format(x='name')} AS tb FROM v_source_b),
        pairs AS (SELECT a.a_id, a.name AS a_name, a.pos, b.b_id, b.name AS b_name, b.team AS b_team,
                         round({_SQL_SIMILARITY.format(a='ta', b='tb')}, 6) AS similarity
                  FROM a JOIN b ON a.pos = b.pos
                  WHERE a.team = b.team OR NOT EXISTS (SELECT 1 FROM b o WHERE o.pos = a.pos AND o.team = a.team))
        SELECT a_id, strip_accents(a_name) AS a_name, pos, CAST(rank AS INT) AS rank, b_id, b_name, b_team, similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) AS rank FROM pairs WHERE similarity > 0.3)
        WHERE rank <= 5""",
)
def match_candidates(spark, d):
    asked = view(spark, d, "v_source_a").withColumn("name", N.fold_accents(F.col("name")))
    return I.match_candidates(asked, view(spark, d, "v_source_b"))


@register(
    "ambiguous_matches",
    f"""WITH {_SQL_KEYED},
        claims AS (SELECT *, round({_SQL_SIMILARITY.format(a='ta', b='tb')}, 6) AS similarity
                   FROM (SELECT *, {_SQL_TEXT.format(x='name')} AS ta, {_SQL_TEXT.format(x='b_name')} AS tb FROM cascade WHERE b_id IS NOT NULL)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY similarity DESC, a_id) AS r FROM claims)
        SELECT l.a_id, l.name, l.pos, l.team, l.b_id, l.b_name, l.similarity, w.name AS conflict_with
        FROM ranked l JOIN ranked w ON w.b_id = l.b_id AND w.r = 1 WHERE l.r > 1""",
)
def ambiguous_matches(spark, d):
    linked = _cascade(spark, d).filter(F.col("b_id").isNotNull())
    score = F.round(N.name_similarity(N.fold_accents(F.col("name")), F.col("b_name")), 6)
    return I.ambiguous_matches(linked.withColumn("similarity", score))


@register(
    "partial_name_overlap",
    """SELECT a.name AS name_a, min(b.name) AS name_b
       FROM (SELECT DISTINCT trim(name) AS name FROM v_source_a) a JOIN (SELECT DISTINCT trim(name) AS name FROM v_source_b) b
       ON contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) GROUP BY 1""",
)
def partial_name_overlap(spark, d):
    return I.partial_name_overlap(view(spark, d, "v_source_a"), view(spark, d, "v_source_b"))


# --- audits ----------------------------------------------------------------------------------------------------


def _raw_ids(spark, d):
    raw = view(spark, d, "v_raw_salary")
    return raw.select("slate_id", "id", F.col("name_text").alias("name"), F.col("roster_position").alias("pos"),
                      F.col("team_text").alias("team"), F.col("salary_text").alias("salary"))


_KNOWN = "(SELECT DISTINCT external_id AS id FROM v_crosswalk WHERE source_name = 'draftkings')"


@register(
    "crosswalk_coverage",
    f"""SELECT *, CASE WHEN coverage_pct >= 99 AND duplicate_ids = 0 THEN 'EXCELLENT' WHEN coverage_pct >= 95 THEN 'GOOD' ELSE 'NEEDS WORK' END AS verdict
        FROM (SELECT slate_id, slate_ids, covered, floor((covered * 20000 + slate_ids) / (2 * slate_ids)) / 100 AS coverage_pct,
                     (SELECT count(*) FROM (SELECT external_id FROM v_crosswalk WHERE source_name = 'draftkings' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids
              FROM (SELECT slate_id, count(DISTINCT s.id) AS slate_ids, count(DISTINCT k.id) AS covered
                    FROM v_raw_salary s LEFT JOIN {_KNOWN} k ON k.id = s.id GROUP BY slate_id))""",
)
def crosswalk_coverage(spark, d):
    return A.crosswalk_coverage(_raw_ids(spark, d), view(spark, d, "v_crosswalk"))


@register(
    "duplicate_ids",
    "SELECT external_id, count(*) AS occurrences FROM v_crosswalk WHERE source_name = 'draftkings' GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, d):
    return A.duplicate_ids(view(spark, d, "v_crosswalk"))


@register(
    "entities_with_many_ids",
    """SELECT DISTINCT entity_id, external_id, n_ids FROM (SELECT entity_id, external_id,
              (SELECT count(DISTINCT o.external_id) FROM v_crosswalk o WHERE o.source_name = 'draftkings' AND o.entity_id = c.entity_id) AS n_ids
       FROM v_crosswalk c WHERE source_name = 'draftkings') WHERE n_ids > 1""",
)
def entities_with_many_ids(spark, d):
    return A.entities_with_many_ids(view(spark, d, "v_crosswalk"))


@register(
    "missing_ids",
    f"""SELECT slate_id, id, name_text AS name, roster_position AS pos, team_text AS team, salary_text AS salary
        FROM v_raw_salary WHERE id NOT IN (SELECT id FROM {_KNOWN})""",
)
def missing_ids(spark, d):
    return A.missing_ids(_raw_ids(spark, d), view(spark, d, "v_crosswalk"))


@register(
    "dst_coverage",
    f"SELECT slate_id, id, name_text AS name FROM v_raw_salary WHERE roster_position = 'DST' AND id NOT IN (SELECT id FROM {_KNOWN})",
)
def dst_coverage(spark, d):
    return A.dst_coverage(_raw_ids(spark, d), view(spark, d, "v_crosswalk"))


@register(
    "identifier_overlap",
    """WITH m AS (
         SELECT 'names' AS measure, (SELECT count(DISTINCT trim(name)) FROM v_source_a) AS left_count,
                (SELECT count(DISTINCT trim(name)) FROM v_source_b) AS right_count,
                (SELECT count(*) FROM (SELECT trim(name) FROM v_source_a INTERSECT SELECT trim(name) FROM v_source_b)) AS common
         UNION ALL
         SELECT 'teams', (SELECT count(DISTINCT team) FROM v_source_a), (SELECT count(DISTINCT team) FROM v_source_b),
                (SELECT count(*) FROM (SELECT team FROM v_source_a INTERSECT SELECT team FROM v_source_b)))
       SELECT *, floor((common * 2000 + left_count) / (2 * left_count)) / 10 AS pct_of_left FROM m""",
)
def identifier_overlap(spark, d):
    columns = {"names": ("name", "name"), "teams": ("team", "team")}
    return A.identifier_overlap(view(spark, d, "v_source_a"), view(spark, d, "v_source_b"), columns)


@register("names_in_both", "SELECT trim(name) AS name FROM v_source_a INTERSECT SELECT trim(name) FROM v_source_b")
def names_in_both(spark, d):
    return A.names_in_both(view(spark, d, "v_source_a"), view(spark, d, "v_source_b"))


@register(
    "distinct_players",
    """SELECT canonical_name, position, team, seq FROM v_player_batch
       QUALIFY row_number() OVER (PARTITION BY canonical_name, position, team ORDER BY seq) = 1""",
)
def distinct_players(spark, d):
    batch = view(spark, d, "v_player_batch").select("canonical_name", "position", "team", "seq")
    return A.distinct_players(batch, ("canonical_name", "position", "team"))


@register(
    "id_profile",
    """WITH u AS (SELECT DISTINCT external_id, external_name, source_name FROM v_external_ids),
            n AS (SELECT length(external_id) AS len, count(*) AS c FROM u GROUP BY 1)
       SELECT (SELECT count(*) FROM v_external_ids) AS total_rows, (SELECT count(*) FROM u) AS distinct_players,
              (SELECT count(DISTINCT external_id) FROM u) AS distinct_ids,
              (SELECT min(len) FROM n) AS min_length, (SELECT max(len) FROM n) AS max_length,
              (SELECT len FROM n ORDER BY c DESC, len LIMIT 1) AS mode_length""",
)
def id_profile(spark, d):
    return A.id_profile(view(spark, d, "v_external_ids"), "external_id", "external_name", "source_name")


@register(
    "id_prefixes",
    """SELECT substr(external_id, 1, 3) AS prefix, count(*) AS players
       FROM (SELECT DISTINCT external_id, external_name, source_name FROM v_external_ids)
       GROUP BY 1 ORDER BY players DESC, prefix LIMIT 10""",
)
def id_prefixes(spark, d):
    return A.id_prefixes(view(spark, d, "v_external_ids"), "external_id", "external_name", "source_name")


@register(
    "id_columns",
    """SELECT 'player_id' AS column_name, count(DISTINCT player_id) AS distinct_values FROM v_external_ids
       UNION ALL SELECT 'external_id', count(DISTINCT external_id) FROM v_external_ids
       UNION ALL SELECT 'confidence_score', count(DISTINCT confidence_score) FROM v_external_ids""",
)
def id_columns(spark, d):
    return A.id_columns(view(spark, d, "v_external_ids"))


@register(
    "numeric_ids",
    """SELECT count(*) AS total, count(TRY_CAST(external_id AS DOUBLE)) AS numeric_ids,
              floor((count(TRY_CAST(external_id AS DOUBLE)) * 2000 + count(*)) / (2 * count(*))) / 10 AS numeric_pct FROM v_external_ids""",
)
def numeric_ids(spark, d):
    return A.numeric_ids(view(spark, d, "v_external_ids"), "external_id")


@register(
    "name_traits",
    """SELECT DISTINCT name_text AS name,
              contains(name_text, ' Jr.') OR contains(name_text, ' Sr.') OR contains(name_text, ' III') OR contains(name_text, ' IV')
                OR contains(name_text, ' V') AS has_suffix,
              contains(name_text, '''') OR contains(name_text, '-') OR contains(name_text, '.') OR contains(name_text, ' ') AS has_special,
              name_text <> rtrim(name_text) AS trailing_space FROM v_raw_salary""",
)
def name_traits(spark, d):
    return A.name_traits(view(spark, d, "v_raw_salary"), "name_text")


# --- upserts ---------------------------------------------------------------------------------------------------

_SQL_UPSERT = """
    latest AS (SELECT * FROM {batch} QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY seq DESC) = 1),
    merged AS (
      SELECT p.id, p.canonical_name,
             CASE WHEN l.seq IS NULL THEN p.first_name ELSE l.first_name END AS first_name,
             CASE WHEN l.seq IS NULL THEN p.last_name ELSE l.last_name END AS last_name,
             CASE WHEN l.seq IS NULL THEN p.position ELSE l.position END AS position,
             CASE WHEN l.seq IS NULL THEN p.team ELSE l.team END AS team,
             CASE WHEN l.seq IS NULL THEN p.nfl_id ELSE l.nfl_id END AS nfl_id,
             coalesce(l.seq, p.updated_seq) AS updated_seq
      FROM v_players p LEFT JOIN latest l ON l.canonical_name = p.canonical_name
      UNION ALL
      SELECT (SELECT max(id) FROM v_players) + row_number() OVER (ORDER BY md5(canonical_name), canonical_name),
             canonical_name, first_name, last_name, position, team, nfl_id, seq
      FROM latest WHERE canonical_name NOT IN (SELECT canonical_name FROM v_players))"""


@register(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def latest(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus")
    return latest_per_key(orders, ["o_custkey"], [F.col("o_orderkey").desc()])


@register("upsert_players", f"WITH {_SQL_UPSERT.format(batch='v_player_batch')} SELECT * FROM merged")
def upsert_players(spark, d):
    return I.upsert_players(view(spark, d, "v_players"), view(spark, d, "v_player_batch"))


def _id_batch(spark, d):
    requests = view(spark, d, "v_id_requests")
    return requests.select(
        (F.col("request_id") + 1).alias("player_id"), "source_name", "external_id", F.concat(F.lit("feed "), "external_id").alias("external_name"),
        F.lit(None).cast("double").alias("confidence_score"), F.col("request_id").alias("seq"),
    )


@register(
    "upsert_external_ids",
    """SELECT player_id, source_name, external_id, external_name, confidence_score
       FROM (SELECT *, -1 AS seq FROM v_external_ids
             UNION ALL
             SELECT request_id + 1, source_name, external_id, 'feed ' || external_id, 1.0::DOUBLE, request_id FROM v_id_requests)
       QUALIFY row_number() OVER (PARTITION BY source_name, external_id ORDER BY seq DESC) = 1""",
)
def upsert_external_ids(spark, d):
    return I.upsert_external_ids(view(spark, d, "v_external_ids"), _id_batch(spark, d))


@register(
    "upsert_aliases",
    """SELECT player_id, alias_name, source_name, confidence_score
       FROM (SELECT *, -1 AS seq FROM v_aliases
             UNION ALL SELECT request_id + 1, name, source_name, 1.0::DOUBLE, request_id FROM v_name_requests)
       QUALIFY source_name IS NULL OR row_number() OVER (PARTITION BY alias_name, source_name ORDER BY seq DESC) = 1""",
)
def upsert_aliases(spark, d):
    batch = view(spark, d, "v_name_requests").select(
        (F.col("request_id") + 1).alias("player_id"), F.col("name").alias("alias_name"), "source_name",
        F.lit(None).cast("double").alias("confidence_score"), F.col("request_id").alias("seq"),
    )
    return I.upsert_aliases(view(spark, d, "v_aliases"), batch)


def _tables(spark, d):
    return I.IdentityTables(view(spark, d, "v_players"), view(spark, d, "v_external_ids"), view(spark, d, "v_aliases"))


def _new_decisions(spark, d):
    batch = view(spark, d, "v_player_batch")
    rows = batch.select(
        F.col("canonical_name").alias("dk_name"), F.concat(F.lit("D"), F.col("person").cast("string")).alias("dk_id"),
        F.col("position").alias("dk_position"), F.col("team").alias("dk_team"), "seq",
    )
    return latest_per_key(rows, ["dk_name"], [F.col("seq").desc()])


_SQL_NEW = """
    decided AS (SELECT canonical_name, split_part(canonical_name, ' ', 1) AS first_name, split_part(canonical_name, ' ', 2) AS last_name,
                       position, team, CAST(NULL AS VARCHAR) AS nfl_id, seq, 'D' || CAST(person AS VARCHAR) AS dk_id
                FROM v_player_batch QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY seq DESC) = 1),"""


@register(
    "apply_new_players",
    f"""WITH {_SQL_NEW} {_SQL_UPSERT.format(batch='decided')},
        linked AS (SELECT m.id, d.* FROM decided d JOIN merged m ON m.canonical_name = d.canonical_name)
        SELECT 'player' AS kind, id AS player_id, canonical_name AS text, position AS detail FROM merged
        UNION ALL
        (SELECT 'external_id', player_id, external_id, source_name FROM (
           SELECT player_id, external_id, source_name, -1 AS seq FROM v_external_ids
           UNION ALL SELECT id, dk_id, 'draftkings', seq FROM linked)
         QUALIFY row_number() OVER (PARTITION BY source_name, external_id ORDER BY seq DESC) = 1)
        UNION ALL
        (SELECT 'alias', player_id, alias_name, source_name FROM (
           SELECT player_id, alias_name, source_name, -1 AS seq FROM v_aliases
           UNION ALL SELECT id, canonical_name, 'draftkings', seq FROM linked)
         QUALIFY source_name IS NULL OR row_number() OVER (PARTITION BY source_name, alias_name ORDER BY seq DESC) = 1)""",
)
def apply_new_players(spark, d):
    return _flat(I.apply_new_players(_tables(spark, d), _new_decisions(spark, d)))


def _flat(tables):
    return (
        tables.players.select(F.lit("player").alias("kind"), F.col("id").alias("player_id"), F.col("canonical_name").alias("text"), F.col("position").alias("detail"))
        .unionByName(tables.external_ids.select(F.lit("external_id").alias("kind"), "player_id", F.col("external_id").alias("text"), F.col("source_name").alias("detail")))
        .unionByName(tables.aliases.select(F.lit("alias").alias("kind"), "player_id", F.col("alias_name").alias("text"), F.col("source_name").alias("detail")))
    )


@register(
    "apply_matches",
    f"""WITH decisions AS (SELECT 'S' || CAST(o.seq AS VARCHAR) AS dk_name, 'S' || CAST(o.seq AS VARCHAR) AS dk_id,
               o.canonical_name AS nfl_name, o.nfl_id, o.position, o.team, o.seq FROM v_player_batch o),
        targets AS (SELECT *, nfl_name AS request_id, nfl_name AS name, 'nfl_api' AS source_name FROM decisions
                    QUALIFY row_number() OVER (PARTITION BY nfl_name ORDER BY seq DESC) = 1),
        found AS ({_SQL_LOOKUP.format(requests='targets')}),
        unknown AS (SELECT nfl_name AS canonical_name, CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name,
                           position, team, nfl_id, seq FROM targets WHERE nfl_name NOT IN (SELECT name FROM found)),
        {_SQL_UPSERT.format(batch='unknown')},
        created AS (SELECT m.id, u.* FROM unknown u JOIN merged m ON m.canonical_name = u.canonical_name),
        linked AS (SELECT d.*, coalesce(f.player_id, c.id) AS player_id FROM decisions d LEFT JOIN found f ON f.name = d.nfl_name
                   LEFT JOIN created c ON c.canonical_name = d.nfl_name)
        SELECT 'player' AS kind, id AS player_id, canonical_name AS text, position AS detail FROM merged
        UNION ALL
        (SELECT 'external_id', player_id, external_id, source_name FROM (
           SELECT player_id, external_id, source_name, -1 AS seq FROM v_external_ids
           UNION ALL SELECT id, nfl_id, 'nfl_api', seq FROM created
           UNION ALL SELECT player_id, dk_id, 'draftkings', seq FROM linked)
         QUALIFY row_number() OVER (PARTITION BY source_name, external_id ORDER BY seq DESC) = 1)
        UNION ALL
        (SELECT 'alias', player_id, alias_name, source_name FROM (
           SELECT player_id, alias_name, source_name, -1 AS seq FROM v_aliases
           UNION ALL SELECT id, canonical_name, 'nfl_api', seq FROM created
           UNION ALL SELECT player_id, dk_name, 'draftkings', seq FROM linked)
         QUALIFY source_name IS NULL OR row_number() OVER (PARTITION BY source_name, alias_name ORDER BY seq DESC) = 1)""",
)
def apply_matches(spark, d):
    batch = view(spark, d, "v_player_batch")
    site = F.concat(F.lit("S"), F.col("seq").cast("string"))
    decisions = batch.select(
        site.alias("dk_name"), site.alias("dk_id"), F.col("canonical_name").alias("nfl_name"), "nfl_id", "position", "team", "seq"
    )
    return _flat(I.apply_matches(_tables(spark, d), decisions))


@register(
    "identity_counts",
    """SELECT 'players' AS table_name, count(*) AS row_count FROM v_players
       UNION ALL SELECT 'external_ids', count(*) FROM v_external_ids UNION ALL SELECT 'aliases', count(*) FROM v_aliases""",
)
def identity_counts(spark, d):
    return I.identity_counts(_tables(spark, d))
