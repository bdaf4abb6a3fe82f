"""Identity resolution: crosswalk joins, lookups, match cascade, fuzzy candidates and bulk upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rosterlab import constants as C
from rosterlab.functions import names as N
from rosterlab.functions import values as V
from rosterlab.functions.edits import Offered
from rosterlab.operators.keyed import hashed_number, latest_per_key, top_per_key
from rosterlab.session import cut_lineage, importable

# --- crosswalk -------------------------------------------------------------------------------------------------


def first_crosswalk_rows(crosswalk: DataFrame, source: str = C.SALARY_SOURCE) -> DataFrame:
    """One entity per external id of a source: the first row in feed order wins."""
    rows = crosswalk.filter(F.col("source_name") == source)
    return top_per_key(rows, ["external_id"], [F.col("seq")], 1).select(F.col("external_id").alias("id"), "entity_id")


def last_projection_rows(projections: DataFrame, key: str) -> DataFrame:
    """One projection per slate and key: the last row of the feed wins."""
    rows = projections.filter(F.col(key).isNotNull())
    return latest_per_key(rows, ["slate_id", key], [F.col("feed_seq").desc(), F.col("proj_points").desc()])


def slates_with_ids(projections: DataFrame) -> DataFrame:
    """Whether any projection row of the slate carries a player id."""
    return projections.groupBy("slate_id").agg(F.max(F.col("player_id").isNotNull()).alias("has_ids"))


def _pool_columns(opp: Column) -> list[Column]:
    return [
        F.col("slate_id"), F.col("name"), F.col("pos"), F.col("team"), F.col("salary"), F.col("proj_points"),
        F.col("id").alias("dk_id"), F.col("entity_id"), F.lit("crosswalk").alias("match_method"),
        F.coalesce(opp, F.lit(C.UNKNOWN_OPPONENT)).alias("opp"),
        V.points_per_k(F.col("proj_points"), F.col("salary")).alias("value"),
    ]


def crosswalk_join(salaries: DataFrame, crosswalk: DataFrame, projections: DataFrame) -> DataFrame:
    """Salaries joined to projections through the entity id of the salary site's player id."""
    latest = last_projection_rows(projections, "player_id").select(
        "slate_id", F.col("player_id").alias("entity_id"), "proj_points", F.col("opp").alias("_opp")
    )
    linked = salaries.join(first_crosswalk_rows(crosswalk), "id")
    return linked.join(latest, ["slate_id", "entity_id"]).select(*_pool_columns(F.col("_opp")))


def name_fallback_join(salaries: DataFrame, crosswalk: DataFrame, projections: DataFrame) -> DataFrame:
    """Exact-name join for the slates none of whose projection rows has an id."""
    nameless = slates_with_ids(projections).filter(~F.col("has_ids")).select("slate_id")
    latest = last_projection_rows(projections.join(nameless, "slate_id", "left_semi"), "name").select(
        "slate_id", "name", "proj_points", F.col("opp").alias("_opp")
    )
    linked = salaries.join(first_crosswalk_rows(crosswalk), "id")
    return linked.join(latest, ["slate_id", "name"]).select(*_pool_columns(F.col("_opp")))


def build_pool(salaries: DataFrame, crosswalk: DataFrame, projections: DataFrame) -> DataFrame:
    """Pool of every slate: by entity id, or by name where the slate has no ids."""
    by_id = crosswalk_join(salaries, crosswalk, projections)
    return by_id.unionByName(name_fallback_join(salaries, crosswalk, projections))


def unmatched_report(salaries: DataFrame, crosswalk: DataFrame, projections: DataFrame) -> DataFrame:
    """Salary rows that drop out of the pool, with the reason."""
    known = first_crosswalk_rows(crosswalk)
    columns = ["slate_id", "id", "name", "pos", "team"]
    unlinked = salaries.join(known, "id", "left_anti").select(*columns, F.lit("no_crosswalk").alias("reason"))
    by_id = projections.filter(F.col("player_id").isNotNull()).select("slate_id", F.col("player_id").alias("entity_id"))
    nameless = slates_with_ids(projections).filter(~F.col("has_ids")).select("slate_id")
    by_name = projections.join(nameless, "slate_id", "left_semi").select("slate_id", "name").distinct()
    linked = salaries.join(known, "id")
    unprojected = linked.join(by_id.distinct(), ["slate_id", "entity_id"], "left_anti").join(
        by_name, ["slate_id", "name"], "left_anti"
    )
    return unlinked.unionByName(unprojected.select(*columns, F.lit("no_projection").alias("reason")))


# --- lookups ---------------------------------------------------------------------------------------------------


def lookup_by_external_id(requests: DataFrame, players: DataFrame, external_ids: DataFrame) -> DataFrame:
    """Bulk lookup of players by (source_name, external_id)."""
    mapped = requests.join(
        external_ids.select("source_name", "external_id", "external_name", "confidence_score", "player_id"),
        ["source_name", "external_id"],
    )
    return mapped.join(players.withColumnRenamed("id", "player_id"), "player_id")


def lookup_by_name(requests: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """Bulk lookup (request_id, name, source_name): the canonical name first, else the most confident alias.

    With a source, an alias of that source or of no source counts; without one, any alias.  Aliases are reduced to
    one best row per lookup key before the join, so a widely shared alias never multiplies rows.
    """
    canonical = players.select(F.col("canonical_name").alias("name"), F.col("id").alias("_canonical_id"))
    best_first = [F.col("confidence_score").desc(), F.col("player_id")]
    scopes = F.array(F.coalesce(F.concat(F.lit("="), F.col("source_name")), F.lit("none")), F.lit("any"))
    alias_keys = top_per_key(
        aliases.select("alias_name", "player_id", "confidence_score", F.explode(scopes).alias("_scope")),
        ["alias_name", "_scope"],
        best_first,
        1,
    ).withColumnRenamed("alias_name", "name")
    wanted = F.when(
        F.col("source_name").isNotNull(), F.array(F.concat(F.lit("="), F.col("source_name")), F.lit("none"))
    ).otherwise(F.array(F.lit("any")))
    by_canonical = requests.join(canonical, "name", "left")
    resolved = by_canonical.filter(F.col("_canonical_id").isNotNull()).select(
        "request_id", "name", "source_name", F.col("_canonical_id").alias("player_id"),
        F.lit("canonical").alias("found_by"), F.lit(1.0).alias("confidence_score"),
    )
    rest = by_canonical.filter(F.col("_canonical_id").isNull()).select(
        "request_id", "name", "source_name", F.explode(wanted).alias("_scope")
    )
    by_alias = top_per_key(rest.join(alias_keys, ["name", "_scope"]), ["request_id"], best_first, 1).select(
        "request_id", "name", "source_name", "player_id", F.lit("alias").alias("found_by"), "confidence_score"
    )
    return resolved.unionByName(by_alias)


def ids_of_player(players: DataFrame, external_ids: DataFrame) -> DataFrame:
    """All external ids of each player, most confident first; one row per id so no player's list is gathered."""
    rows = external_ids.join(players.select(F.col("id").alias("player_id"), "canonical_name"), "player_id")
    return rows.select(
        "player_id", "canonical_name", "source_name", "external_id", "external_name", "confidence_score"
    ).orderBy("player_id", F.col("confidence_score").desc(), "source_name", "external_id")


def aliases_of_player(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """All aliases of each player, most confident first."""
    rows = aliases.join(players.select(F.col("id").alias("player_id"), "canonical_name"), "player_id")
    return rows.select("player_id", "canonical_name", "alias_name", "source_name", "confidence_score").orderBy(
        "player_id", F.col("confidence_score").desc(), "alias_name"
    )


def name_map_join(rows: DataFrame, name_map: DataFrame | None = None) -> DataFrame:
    """Source-specific spelling replaced by the mapped name; unknown spellings stay.  Without a map the shipped one is used."""
    if name_map is None:
        name_map = rows.sparkSession.createDataFrame(C.NAME_MAP, "source string, player_name string, normalized_name string")
    spelled = name_map.select(
        F.col("source").alias("source_name"), F.col("player_name").alias("name"), F.col("normalized_name")
    )
    return rows.join(spelled, ["source_name", "name"], "left").withColumn(
        "normalized_name", F.coalesce("normalized_name", "name")
    )


#: Length of the pieces by which names are looked up; shorter texts are their own piece.
PIECE = 12  # long, so that the rarest piece of a text stays rare as names grow in number


def _pieces(text: str, size: int) -> Column:
    """The distinct pieces of one length; the piece of length 0 is the empty text."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def _by_piece(texts: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """One row per text and distinct piece of the given lengths: at most as many as the text has characters per length."""
    return texts.filter(F.col(text).isNotNull()).select("*", F.explode(F.concat(*[_pieces(text, n) for n in sizes])).alias("_piece"))


def _meeting(texts: DataFrame, text: str, wanted: DataFrame, needle: str) -> DataFrame:
    """Rows of ``texts`` next to each distinct needle that they may contain: those with the needle's rarest piece.

    Both sides are as large as the tables however small their files are, so the joins merge and nothing is broadcast.
    """
    needles = wanted.filter(F.col(needle).isNotNull())
    own_size = F.least(F.length(needle), F.lit(PIECE))
    sizes = sorted(needles.select(F.collect_set(own_size)).first()[0]) or [0]
    arriving = _by_piece(texts, text, sizes)
    own = F.lit(None).cast("array<string>")
    for n in sizes:
        own = F.when(own_size == n, _pieces(needle, n)).otherwise(own)
    waiting = needles.select(needle).distinct().select(needle, F.explode(own).alias("_piece"))
    spread = arriving.groupBy("_piece").agg(F.count("*").alias("_texts"))
    rarest = (
        waiting.join(spread.hint("merge"), "_piece", "left")
        .groupBy(needle)
        .agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("_texts"), "_piece")).alias("_least"))
        .filter(F.col("_least._texts") > 0)
        .select(needle, "_least._piece")
    )
    return arriving.join(rarest.hint("merge"), "_piece").drop("_piece")


def _containing(texts: DataFrame, text: str, wanted: DataFrame, needle: str) -> DataFrame:
    """Rows of ``texts`` next to every row of ``wanted`` whose text they contain; both sides' other columns are kept.

    A needle waits under the rarest of its pieces, so a frequent one gathers only what consists of frequent pieces.
    Texts arrive by their own pieces, linear in their length, and what meets is verified.  A needle with a piece that no
    text has is inside none.  Null texts and needles meet nothing; the empty needle is inside every text.
    """
    met = _meeting(texts, text, wanted, needle).filter(F.contains(F.col(text), F.col(needle)))
    return met.join(wanted.hint("merge"), needle)


def search_players(players: DataFrame, aliases: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """Case-insensitive contains-search over canonical, first, last and alias names; top n players per query.

    Names are found by pieces of a few characters and verified, see ``_containing``; the empty query is inside every name.
    """
    wanted = queries.select("query", F.lower("query").alias("_lower"))

    def hits(names: DataFrame, *carried: str) -> DataFrame:
        lower = names.select(*carried, F.lower("_name").alias("_name"))
        return _containing(lower, "_name", wanted, "_lower").select("query", *carried).distinct()

    own = players.select("id", F.explode(F.array("canonical_name", "first_name", "last_name")).alias("_name"))
    scored = aliases.select(
        F.col("player_id").alias("id"), F.col("alias_name").alias("_name"), F.coalesce("confidence_score", F.lit(1.0)).alias("search_score")
    )
    # A hit on the player's own names counts with the score of each of the player's aliases, or 1 without any.
    scores = players.select("id").join(scored.select("id", "search_score").distinct().hint("merge"), "id", "left").select(
        "id", F.coalesce("search_score", F.lit(1.0)).alias("search_score")
    )
    by_own = hits(own, "id").join(scores.hint("merge"), "id").select("query", "id", "search_score")
    rows = by_own.unionByName(hits(scored, "id", "search_score")).distinct()
    ranked = top_per_key(rows, ["query"], [F.col("search_score").desc(), F.col("id")], n, "rank")
    return ranked.join(players.hint("merge"), "id").select(
        "query", "rank", "id", "canonical_name", "position", "team", "search_score"
    )


# --- matching --------------------------------------------------------------------------------------------------


def _name_parts(name: Column) -> tuple[Column, Column]:
    words = F.split(name, " ")
    return F.left(words[0], F.lit(1)), F.element_at(words, -1)


def _rung_keys() -> Column:
    """(rung, key) pairs of one player, strongest rung first; a rung without a usable key is left out."""
    initial, last = _name_parts(F.col("_key"))

    def rung(number: int, *parts: Column) -> Column:
        return F.struct(F.lit(number).alias("rung"), F.concat_ws("|", *parts).alias("key"))

    named = F.length("_key") > 0
    two_words = named & F.col("_key").contains(" ")
    has_team = F.col("team").isNotNull()
    keys = F.array(
        F.when(named, rung(1, F.col("_key"))),
        F.when(two_words & F.col("pos").isNotNull(), rung(2, initial, last, F.col("pos"))),
        F.when(two_words & has_team, rung(3, last, F.col("team"))),
        F.when(two_words, rung(4, last)),
        F.when((F.col("pos") == "DST") & has_team, rung(5, F.col("team"))),
    )
    return F.filter(keys, lambda k: k.isNotNull())


RUNG_NAMES = {1: "exact", 2: "initial+last", 3: "last+team", 4: "last-unique", 5: "dst-team"}


def match_cascade(source: DataFrame, target: DataFrame) -> DataFrame:
    """Link (a_id, name, pos, team) to (b_id, name, pos, team) by the first rung that hits.

    Rungs: name key; initial + last name + position; last name + team; last name that is unique in the target;
    team for defenses.  The target is reduced to one row per rung key before the join, so no key multiplies rows.
    """
    offered = target.withColumn("_key", N.name_key(F.col("name"))).select(
        "b_id", F.col("name").alias("b_name"), F.inline(_rung_keys())
    )
    chosen = (
        offered.groupBy("rung", "key")
        .agg(F.min(F.struct("b_id", "b_name")).alias("pick"), F.count("*").alias("claims"))
        .filter((F.col("rung") != 4) | (F.col("claims") == 1))
        .select("rung", "key", "pick.b_id", "pick.b_name")
    )
    wanted = source.withColumn("_key", N.name_key(F.col("name"))).select(
        "a_id", F.inline(_rung_keys())
    )
    hits = wanted.join(chosen, ["rung", "key"]).groupBy("a_id").agg(F.min(F.struct("rung", "b_id", "b_name")).alias("hit"))
    how = F.col("hit.rung")
    label = F.when(how == 1, RUNG_NAMES[1])
    for number in (2, 3, 4, 5):
        label = label.when(how == number, RUNG_NAMES[number])
    return source.join(hits, "a_id", "left").select(
        "a_id", "name", "pos", "team", F.col("hit.b_id").alias("b_id"), F.col("hit.b_name").alias("b_name"),
        label.alias("match_how"),
    )


CHUNK = 4096  # texts, and questions, that one group holds


def _chunked(rows: DataFrame, text: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by their text to chunks of about CHUNK rows within (pos, _scope), and the number of chunks of each."""
    block = ["pos", "_scope"]
    counts = rows.groupBy(*block).agg(F.ceil(F.count("*") / CHUNK).alias(f"_n{name}"))
    dealt = rows.join(counts, block).withColumn(name, F.pmod(F.xxhash64(text), F.col(f"_n{name}"))).drop(f"_n{name}")
    return dealt, counts


def _best_of_two_chunks(n: int, threshold: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a chunk of questions and a chunk of texts: the n best texts of each question, ties by the first id, then the text."""

    def decoded(column: pa.ChunkedArray) -> list[str | None]:
        return [None if x is None else x.decode("utf-8", "surrogateescape") for x in column.cast(pa.binary()).to_pylist()]

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        by = pc.sort_indices(offered, [("_first", "ascending"), ("_b_text", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        who, what = Offered(decoded(offered["_b_text"])).best(decoded(asked["_text"]), rank, n, threshold)
        found = {**{c: asked[c].take(who) for c in ("pos", "_scope", "_text", "_tile")}, **{c: offered[c].take(what) for c in ("_first", "_b_text")}}
        return pa.table([found[f.name].cast(f.type) for f in schema], schema)

    return run


def _best_of_chunks(questions: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The n best texts of each chunk of a question's block.

    A chunk of questions meets a chunk of texts in one group, whose pairs are scored in vectors and never are rows: a
    question keeps its n best of the chunk where it is scored, and a large block is scored by many tasks.
    """
    spark = texts.sparkSession
    importable(spark)
    asked, asked_counts = _chunked(questions.filter("_text IS NOT NULL"), "_text", "_ask")
    offered, offered_counts = _chunked(texts, "_b_text", "_tile")
    all_chunks = lambda count, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)).alias(name)
    on = ["pos", "_scope", "_ask", "_tile"]
    spread = asked.join(offered_counts, ["pos", "_scope"]).select("pos", "_scope", "_text", "_ask", all_chunks("_n_tile", "_tile"))
    copies = offered.join(asked_counts, ["pos", "_scope"]).select("pos", "_scope", "_b_text", "_first", "_tile", all_chunks("_n_ask", "_ask"))
    # a row is small and its work is not, so the number of tasks does not follow from the bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*[spread.schema[c] for c in ("pos", "_scope", "_text", "_tile")], *[texts.schema[c] for c in ("_first", "_b_text")]])
    score = _best_of_two_chunks(n, threshold, to_arrow_schema(schema))
    best = spread.repartition(tasks, *on).groupBy(*on).cogroup(copies.repartition(tasks, *on).groupBy(*on)).applyInArrow(score, schema)
    scored = best.withColumn("similarity", F.round(N.text_similarity(F.col("_text"), F.col("_b_text")), 6))
    return scored.select("pos", "_scope", "_text", "_tile", "similarity", "_first", "_b_text")


def match_candidates(
    unmatched: DataFrame, candidates: DataFrame, n: int = 5, threshold: float = 0.3, tiles: int = 16, similarity=N.text_similarity
) -> DataFrame:
    """Up to n suggestions per unmatched player: same position, same team when the team has any, score > threshold.

    Both sides are reduced to distinct name texts per block first.  Each block's candidates are cut into chunks, every
    chunk keeps its own n best before the shuffle, so a large block is scored by many tasks and never gathered.
    ``similarity`` scores two prepared texts; ``text_sequence_similarity`` is the longest-matching-block alternative.
    """
    teams = candidates.select("pos", "team").distinct().withColumn("_team_known", F.lit(True))
    scope = F.when(F.col("_team_known"), F.concat(F.lit("="), F.col("team"))).otherwise(F.lit("*"))
    asked = (
        unmatched.join(teams, ["pos", "team"], "left")
        .select("a_id", "pos", scope.alias("_scope"), N.similarity_text(F.col("name")).alias("_text"), F.col("name").alias("a_name"))
    )
    offered = candidates.select(
        "b_id", F.col("name").alias("b_name"), "pos", F.col("team").alias("b_team"), N.similarity_text(F.col("name")).alias("_b_text"),
        F.explode(F.array(F.concat(F.lit("="), F.col("team")), F.lit("*"))).alias("_scope"),
    )
    offered = offered.filter(F.col("_scope").isNotNull())
    keys = ["pos", "_scope", "_text"]
    texts = offered.groupBy("pos", "_scope", "_b_text").agg(F.min("b_id").alias("_first"))
    questions = asked.select(*keys).distinct()
    best_first = [F.col("similarity").desc(), F.col("_first")]
    if similarity is N.text_similarity:
        tile_best = _best_of_chunks(questions, texts, n, threshold)
    else:
        # A score that runs in Python has no form inside an array: its pairs are rows.
        tile_list = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("_tile")
        tiled = texts.withColumn("_tile", F.pmod(F.xxhash64("_b_text"), F.lit(tiles)))
        possible = N.length_bound(similarity, F.col("_text"), F.col("_b_text"))
        pairs = questions.select("*", tile_list).join(tiled, ["pos", "_scope", "_tile"]).filter(possible >= threshold - 1e-6)
        scored = pairs.withColumn("similarity", F.round(similarity(F.col("_text"), F.col("_b_text")), 6)).filter(
            F.col("similarity") > threshold
        )
        tile_best = top_per_key(scored, [*keys, "_tile"], best_first, n)
    # n best distinct texts per tile, then overall; n ids per text are enough for n suggestions.
    few_ids = top_per_key(offered, ["pos", "_scope", "_b_text"], [F.col("b_id")], n)
    distinct_best = top_per_key(tile_best, keys, best_first, n)
    named = distinct_best.join(few_ids.hint("merge"), ["pos", "_scope", "_b_text"]).select(*keys, "similarity", "b_id", "b_name", "b_team")
    best = top_per_key(named, keys, [F.col("similarity").desc(), F.col("b_id")], n, "rank")
    return asked.join(best.hint("merge"), keys).select("a_id", "a_name", "pos", "rank", "b_id", "b_name", "b_team", "similarity")


def ambiguous_matches(claims: DataFrame) -> DataFrame:
    """Claims (a_id, name, pos, team, b_id, b_name, similarity) that lost their target to a better claim."""
    winners = top_per_key(claims, ["b_id"], [F.col("similarity").desc(), F.col("a_id")], 1).select(
        "b_id", F.struct("a_id", "name").alias("winner")
    )
    return claims.join(winners, "b_id").filter(F.col("a_id") != F.col("winner.a_id")).select(
        "a_id", "name", "pos", "team", "b_id", "b_name", "similarity", F.col("winner.name").alias("conflict_with")
    )


def partial_name_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each distinct name of the left the first (alphabetical) right name that contains it or is contained in it.

    Null names meet nothing.  An empty name is contained in every name.
    """
    a = left.select(F.trim("name").alias("name_a")).distinct().withColumn("_a", F.lower("name_a"))
    b = right.select(F.trim("name").alias("name_b")).distinct().withColumn("_b", F.lower("name_b"))
    # Reduced to the first name per text before joining, so copies do not multiply.
    b_texts = b.groupBy("_b").agg(F.min("name_b").alias("name_b"))
    inside_a = _containing(a, "_a", b_texts, "_b")
    # A short left name is a piece itself: the first right name per piece is settled before the join.
    short = F.length("_a") <= PIECE
    sizes = sorted(a.filter(short).select(F.collect_set(F.length("_a"))).first()[0]) or [0]
    holders = _by_piece(b_texts, "_b", sizes).groupBy(F.col("_piece").alias("_a")).agg(F.min("name_b").alias("name_b"))
    inside_b = a.filter(short).join(holders.hint("merge"), "_a")
    inside_long_b = _containing(b_texts, "_b", a.filter(~short), "_a")
    hits = inside_a.select("name_a", "name_b")
    for more in (inside_b, inside_long_b):
        hits = hits.unionByName(more.select("name_a", "name_b"))
    return hits.groupBy("name_a").agg(F.min("name_b").alias("name_b"))


# --- bulk upserts ----------------------------------------------------------------------------------------------

PLAYER_FIELDS = ("first_name", "last_name", "position", "team", "nfl_id")


def upsert_players(
    players: DataFrame, batch: DataFrame, stamp: str = "updated_seq", order: str = "seq", last_id: int | None = None
) -> DataFrame:
    """Merge a batch by canonical name, last row of the batch wins; known players keep their id.

    ``last_id`` is the highest id given so far where ``players`` is only a part of the table.

    New players are numbered after the highest id in the order of their name's digest, so the ids do not depend on
    partitioning.
    """
    latest = cut_lineage(
        latest_per_key(batch, ["canonical_name"], [F.col(order).desc()]).select("canonical_name", *PLAYER_FIELDS, F.col(order).alias(stamp))
    )
    incoming = latest.select(
        "canonical_name", F.struct(*PLAYER_FIELDS, stamp).alias("_new")
    )
    kept = players.join(incoming, "canonical_name", "left").select(
        "id",
        "canonical_name",
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in (*PLAYER_FIELDS, stamp)],
    )
    added = hashed_number(latest.join(players, "canonical_name", "left_anti"), "canonical_name", "_number")
    highest = players.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar() if last_id is None else F.lit(last_id)
    numbered = added.select((F.col("_number") + highest).alias("id"), "canonical_name", *PLAYER_FIELDS, stamp)
    return kept.unionByName(numbered)


def _merge_latest(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    columns = [c for c in table.columns]
    old = table.select(*columns, F.lit(None).cast("bigint").alias("_order"))
    new = batch.select(*columns, F.col(order).cast("bigint").alias("_order"))
    return latest_per_key(old.unionByName(new), keys, [F.col("_order").desc_nulls_last()]).select(*columns)


def upsert_external_ids(external_ids: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Merge by (source_name, external_id); a missing confidence is 1."""
    filled = batch.withColumn("confidence_score", F.coalesce("confidence_score", F.lit(1.0)))
    return _merge_latest(external_ids, filled, ["source_name", "external_id"], order)


def upsert_aliases(aliases: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Merge by (alias_name, source_name); rows without a source never conflict and are all kept."""
    filled = batch.withColumn("confidence_score", F.coalesce("confidence_score", F.lit(1.0)))
    sourced = _merge_latest(
        aliases.filter(F.col("source_name").isNotNull()), filled.filter(F.col("source_name").isNotNull()),
        ["alias_name", "source_name"], order,
    )
    free = aliases.filter(F.col("source_name").isNull()).unionByName(
        filled.filter(F.col("source_name").isNull()).select(*aliases.columns)
    )
    return sourced.unionByName(free)


@dataclass(frozen=True)
class IdentityTables:
    players: DataFrame
    external_ids: DataFrame
    aliases: DataFrame


def _link_salary_site(tables: IdentityTables, resolved: DataFrame) -> IdentityTables:
    """Salary-site alias and id for rows (player_id, dk_name, dk_id, seq)."""
    alias = resolved.select(
        "player_id", F.col("dk_name").alias("alias_name"), F.lit(C.SALARY_SOURCE).alias("source_name"),
        F.lit(1.0).alias("confidence_score"), "seq",
    )
    ids = resolved.select(
        "player_id", F.lit(C.SALARY_SOURCE).alias("source_name"), F.col("dk_id").alias("external_id"),
        F.col("dk_name").alias("external_name"), F.lit(1.0).alias("confidence_score"), "seq",
    )
    return IdentityTables(
        tables.players, upsert_external_ids(tables.external_ids, ids), upsert_aliases(tables.aliases, alias)
    )


def apply_new_players(tables: IdentityTables, decisions: DataFrame) -> IdentityTables:
    """Decisions (dk_name, dk_id, dk_position, dk_team, seq) "add as new": player, alias and external id."""
    first, last = N.split_name(F.col("dk_name"))
    batch = decisions.select(
        F.col("dk_name").alias("canonical_name"), first.alias("first_name"), last.alias("last_name"),
        F.col("dk_position").alias("position"), F.col("dk_team").alias("team"), F.lit(None).cast("string").alias("nfl_id"), "seq",
    )
    players = cut_lineage(upsert_players(tables.players, batch))
    ids = players.select(F.col("id").alias("player_id"), F.col("canonical_name").alias("dk_name"))
    return _link_salary_site(
        IdentityTables(players, tables.external_ids, tables.aliases), decisions.join(ids, "dk_name")
    )


def apply_matches(tables: IdentityTables, decisions: DataFrame) -> IdentityTables:
    """Decisions (dk_name, dk_id, nfl_name, nfl_id, position, team, seq) "same player as".

    A target known by canonical name or stats alias is reused; otherwise it is inserted with its stats alias and id.
    """
    targets = latest_per_key(decisions, ["nfl_name"], [F.col("seq").desc()])
    requests = targets.select(
        F.col("nfl_name").alias("request_id"), F.col("nfl_name").alias("name"), F.lit(C.STATS_SOURCE).alias("source_name")
    )
    found = cut_lineage(lookup_by_name(requests, tables.players, tables.aliases).select(F.col("name").alias("nfl_name"), "player_id"))
    unknown = targets.join(found, "nfl_name", "left_anti")
    batch = unknown.select(
        F.col("nfl_name").alias("canonical_name"), F.lit(None).cast("string").alias("first_name"),
        F.lit(None).cast("string").alias("last_name"), "position", "team", "nfl_id", "seq",
    )
    players = cut_lineage(upsert_players(tables.players, batch))
    created = unknown.join(
        players.select(F.col("id").alias("player_id"), F.col("canonical_name").alias("nfl_name")), "nfl_name"
    )
    stats_alias = created.select(
        "player_id", F.col("nfl_name").alias("alias_name"), F.lit(C.STATS_SOURCE).alias("source_name"),
        F.lit(1.0).alias("confidence_score"), "seq",
    )
    stats_ids = created.select(
        "player_id", F.lit(C.STATS_SOURCE).alias("source_name"), F.col("nfl_id").cast("string").alias("external_id"),
        F.col("nfl_name").alias("external_name"), F.lit(1.0).alias("confidence_score"), "seq",
    )
    with_targets = IdentityTables(
        players, upsert_external_ids(tables.external_ids, stats_ids), upsert_aliases(tables.aliases, stats_alias)
    )
    linked = found.unionByName(created.select("nfl_name", "player_id"))
    return _link_salary_site(with_targets, decisions.join(linked, "nfl_name"))


def identity_counts(tables: IdentityTables) -> DataFrame:
    """Row counts of the three tables."""
    parts = {"players": tables.players, "external_ids": tables.external_ids, "aliases": tables.aliases}
    counts = [t.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, t in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
