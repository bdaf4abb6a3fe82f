import random

from pyspark.sql import functions as F

from rosterlab.functions import names as N
from rosterlab.operators import audit as A
from rosterlab.operators import identity as I
from rosterlab.operators import pool as P
from rosterlab.sources.identity_store import ALIASES, EXTERNAL_IDS, PLAYERS

BATCH = "canonical_name string, first_name string, last_name string, position string, team string, nfl_id string, seq bigint"


def player(i, name, team="KC"):
    return (i, name, name.split()[0], name.split()[-1], "QB", team, None, 0)


def test_upsert_players_keeps_ids_and_numbers_new_ones(spark):
    players = spark.createDataFrame([player(1, "A One"), player(7, "B Two")], PLAYERS)
    batch = spark.createDataFrame(
        [("A One", "A", "One", "WR", "DEN", "x", 5), ("A One", "A", "One", "TE", None, "y", 9)] + [(f"N {i}", "N", str(i), "QB", "T", None, i) for i in range(50)], BATCH
    )
    got = {r.canonical_name: r for r in I.upsert_players(players, batch.repartition(7)).collect()}
    assert (got["A One"].id, got["A One"].position, got["A One"].team, got["A One"].updated_seq) == (1, "TE", None, 9)
    assert got["B Two"].id == 7 and got["B Two"].team == "KC"
    assert sorted(r.id for n, r in got.items() if n.startswith("N ")) == list(range(8, 58))
    again = {r.canonical_name: r.id for r in I.upsert_players(players, batch.coalesce(1)).collect()}
    assert again == {n: r.id for n, r in got.items()}


def test_empty_batch_and_empty_store(spark):
    players = spark.createDataFrame([player(3, "A One")], PLAYERS)
    assert I.upsert_players(players, spark.createDataFrame([], BATCH)).collect() == players.collect()
    fresh = I.upsert_players(spark.createDataFrame([], PLAYERS), spark.createDataFrame([("A", "A", "", "QB", "T", None, 1)], BATCH))
    assert [r.id for r in fresh.collect()] == [1]


def test_alias_without_source_never_conflicts(spark):
    aliases = spark.createDataFrame([(1, "Ace", None, 0.5), (1, "Ace", "site", 0.5)], ALIASES)
    batch = spark.createDataFrame([(2, "Ace", None, None, 1), (2, "Ace", None, 0.7, 2), (2, "Ace", "site", None, 3)], ALIASES + ", seq bigint")
    got = sorted((r.player_id, r.source_name or "", r.confidence_score) for r in I.upsert_aliases(aliases, batch).collect())
    assert got == [(1, "", 0.5), (2, "", 0.7), (2, "", 1.0), (2, "site", 1.0)]


def test_reused_external_id_moves_to_the_last_player(spark):
    ids = spark.createDataFrame([(1, "site", "9", "one", 1.0)], EXTERNAL_IDS)
    batch = spark.createDataFrame([(2, "site", "9", "two", 0.5, 1), (3, "site", "9", "three", None, 2)], EXTERNAL_IDS + ", seq bigint")
    assert [(r.player_id, r.confidence_score) for r in I.upsert_external_ids(ids, batch).collect()] == [(3, 1.0)]


def test_lookup_prefers_canonical_then_confidence_then_id(spark):
    players = spark.createDataFrame([player(1, "A One"), player(2, "B Two"), player(3, "C Three")], PLAYERS)
    aliases = spark.createDataFrame([(2, "A One", "site", 1.0), (2, "Al", "site", 0.4), (3, "Al", None, 0.4), (1, "Al", "other", 0.9)], ALIASES)
    requests = spark.createDataFrame([(1, "A One", "site"), (2, "Al", "site"), (3, "Al", None), (4, "Zed", None)], "request_id int, name string, source_name string")
    got = {r.request_id: (r.player_id, r.found_by) for r in I.lookup_by_name(requests, players, aliases).collect()}
    assert got == {1: (1, "canonical"), 2: (2, "alias"), 3: (1, "alias")}


def test_search_scores_rows_like_a_contains_query(spark):
    players = spark.createDataFrame([player(1, "Patrick Mahomes"), player(2, "Pat Freiermuth"), player(3, "Cole Kmet")], PLAYERS)
    aliases = spark.createDataFrame([(1, "P.Mahomes", "site", 0.9), (1, "Showtime", None, 0.5), (3, "Patty", None, 0.2)], ALIASES)
    queries = spark.createDataFrame([("PAT",), ("zzz",)], "query string")
    got = [(r.id, r.search_score) for r in I.search_players(players, aliases, queries).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.9), (1, 0.5), (3, 0.2)]


def test_candidates_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    left = [(f"a{i}", f"{word()} {word()}", rng.choice(["QB", "RB"]), rng.choice(["X", "Y", "Z"])) for i in range(25)]
    right = [(f"b{i:03d}", f"{word()} {word()}", rng.choice(["QB", "RB"]), rng.choice(["X", "Y"])) for i in range(120)]
    right += [(f"b{200 + i}", right[0][1], right[0][2], right[0][3]) for i in range(8)]  # copies of one name
    a = spark.createDataFrame(left, "a_id string, name string, pos string, team string")
    b = spark.createDataFrame(right, "b_id string, name string, pos string, team string")
    scored = a.alias("l").join(b.alias("r"), F.col("l.pos") == F.col("r.pos")).select(
        "a_id", "b_id", F.col("l.team").alias("lt"), F.col("r.team").alias("rt"), F.round(N.name_similarity(F.col("l.name"), F.col("r.name")), 6).alias("s")
    ).collect()
    teams = {(x[2], x[3]) for x in right}
    want = set()
    for a_id, _, pos, team in left:
        own = [(-r.s, r.b_id) for r in scored if r.a_id == a_id and r.s > 0.3 and ((pos, team) not in teams or r.rt == team)]
        want |= {(a_id, rank, b_id) for rank, (_, b_id) in enumerate(sorted(own)[:5], 1)}
    got = {(r.a_id, r["rank"], r.b_id) for r in I.match_candidates(a, b).collect()}
    assert got == want


def test_candidates_with_the_sequence_scorer(spark):
    a = spark.createDataFrame([("a1", "Brian Robinson", "RB", "WAS")], "a_id string, name string, pos string, team string")
    b = spark.createDataFrame([("b1", "B.Robinson", "RB", "WAS"), ("b2", "Q", "RB", "WAS")], "b_id string, name string, pos string, team string")
    got = I.match_candidates(a, b, similarity=N.text_sequence_similarity).collect()
    assert [(r.b_id, r.similarity) for r in got] == [("b1", 0.818182)]


def test_cascade_rungs(spark):
    schema = "{}_id string, name string, pos string, team string"
    a = spark.createDataFrame(
        [("a1", "José Díaz Jr.", "WR", "KC"), ("a2", "A. Rodgers", "QB", "PIT"), ("a3", "Zed Dalton", "QB", "CAR"), ("a4", "Emanuel Wilson", "RB", "GB"), ("a5", "Bears", "DST", "CHI"), ("a6", "No One", "QB", "KC")],
        schema.format("a"),
    )
    b = spark.createDataFrame(
        [("b1", "Jose Diaz", "WR", "LV"), ("b2", "Aaron Rodgers", "QB", "NYJ"), ("b3", "Andy Dalton", "RB", "CAR"), ("b4", "Jeff Wilson", "WR", "SF"), ("b5", "Chicago", "DST", "CHI")],
        schema.format("b"),
    )
    got = {r.a_id: (r.b_id, r.match_how) for r in I.match_cascade(a, b).collect()}
    assert got == {
        "a1": ("b1", "exact"), "a2": ("b2", "initial+last"), "a3": ("b3", "last+team"), "a4": ("b4", "last-unique"), "a5": ("b5", "dst-team"), "a6": (None, None),
    }


def test_name_fallback_only_without_any_id(spark):
    salaries = spark.createDataFrame([(1, "10", "A", "QB", "KC", 5000), (2, "20", "B", "QB", "KC", 5000)], "slate_id int, id string, name string, pos string, team string, salary int")
    crosswalk = spark.createDataFrame([("draftkings", "10", 100, 1), ("draftkings", "10", 999, 2), ("draftkings", "20", 200, 1)], "source_name string, external_id string, entity_id bigint, seq int")
    feed = spark.createDataFrame(
        [(1, 100, "A", 1.0, None, 1), (1, 100, "A", 20.0, "DEN", 2), (2, None, "B", 7.0, None, 1)],
        "slate_id int, player_id bigint, name string, proj_points double, opp string, feed_seq bigint",
    )
    got = {r.slate_id: (r.entity_id, r.proj_points, r.opp, r.value) for r in I.build_pool(salaries, crosswalk, feed).collect()}
    assert got == {1: (100, 20.0, "DEN", 4.0), 2: (200, 7.0, "UNK", 1.4)}


def test_shipped_name_map(spark):
    rows = spark.createDataFrame([("ESPN", "CMC"), ("FanDuel", "CMC")], "source_name string, name string")
    got = {r.source_name: r.normalized_name for r in I.name_map_join(rows).collect()}
    assert got == {"ESPN": "Christian McCaffrey", "FanDuel": "CMC"}


def test_coverage_verdicts(spark):
    salaries = spark.createDataFrame([(1, str(i), "n", "QB", "T", 1) for i in range(200)], "slate_id int, id string, name string, pos string, team string, salary int")

    def verdict(n, extra=()):
        rows = [("draftkings", str(i), i) for i in [*range(n), *extra]]
        return A.crosswalk_coverage(salaries, spark.createDataFrame(rows, "source_name string, external_id string, entity_id int")).first().verdict

    assert [verdict(199), verdict(199, [0]), verdict(190), verdict(189)] == ["EXCELLENT", "GOOD", "GOOD", "NEEDS WORK"]


def test_opponent_map_last_game_wins(spark):
    pool = spark.createDataFrame([(1, "JAC", None), (1, "KC", ""), (1, "DEN", "LV"), (1, "SEA", "UNK")], "slate_id int, team string, opp string")
    games = spark.createDataFrame([(1, "KC@LA 09/07/2025", 1), (1, "KC@JAC", 2), (1, "TBD", 3), (1, None, 4)], "slate_id int, game_text string, seq int")
    got = {r.team: r.opp for r in P.opponent_map_join(pool, games).collect()}
    assert got == {"JAX": "KC", "KC": "JAX", "DEN": "LV", "SEA": "UNK"}


def test_duplicated_salary_names_do_not_multiply(spark):
    projections = spark.createDataFrame([(1, "Al B", "QB"), (1, "al b", "QB"), (1, "Cy", "QB")], "slate_id int, name string, pos string")
    salaries = spark.createDataFrame([(1, "Al B", "QB", 4000, 1), (1, "Al B", "QB", 9000, 2)], "slate_id int, name string, pos string, salary int, seq int")
    got = sorted((r.name, r.salary, r.salary_match, r.salary_kind) for r in P.two_pass_salary_join(projections, salaries).collect())
    assert got == [("Al B", 4000, "exact", "REAL"), ("Cy", 2500, "none", "PLACEHOLDER"), ("al b", 4000, "case_insensitive", "REAL")]


def test_greedy_lineup_reports_the_short_position(spark):
    rows = [(1, i, p, "3000") for i, p in enumerate(["QB", "RB", "RB", "WR", "WR", "WR", "TE", "TE", "DST"])] + [(2, i, p, "3000") for i, p in enumerate(["QB", "RB", "WR", "WR", "WR", "TE", "DST"])]
    pool = spark.createDataFrame(rows, "slate_id int, player_id int, pos string, salary string")
    got = P.greedy_lineup(pool).collect()
    assert len([r for r in got if r.slate_id == 1]) == 9 and all(r.total_salary == 27000 and r.under_cap for r in got if r.slate_id == 1)
    assert [(r.slot, r.error) for r in got if r.slate_id == 2] == [(None, "Not enough RB players available")]
    assert {r.slate_id: r.cheapest for r in P.cheapest_lineup(pool).collect()} == {1: 27000, 2: None}


def test_containment_equals_brute_force(spark):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abA ") for _ in range(rng.randint(0, 7)))
    left, right = [text() for _ in range(60)] + [None, "", "é😀b"], [text() for _ in range(60)] + [None, "x😀bé", "é😀"]
    a = spark.createDataFrame([(x,) for x in left], "name string")
    b = spark.createDataFrame([(x,) for x in right], "name string")
    trimmed = lambda names: {x.strip(" ") for x in names if x is not None}
    for others, rows in ((trimmed(right), b), (trimmed(right) - {""}, b.filter("trim(name) <> ''"))):
        got = {r.name_a: r.name_b for r in I.partial_name_overlap(a, rows).collect()}
        want = {}
        for x in trimmed(left):
            holders = [y for y in others if x.lower() in y.lower() or y.lower() in x.lower()]
            if holders:
                want[x] = min(holders)
        assert got == want


def test_search_equals_brute_force(spark):
    rng = random.Random(12)
    text = lambda low: "".join(rng.choice("abc ") for _ in range(rng.randint(low, 9)))
    names = {i: "c" + text(1) for i in range(80)}
    players = spark.createDataFrame([player(i, n) for i, n in names.items()], PLAYERS)
    aliases = spark.createDataFrame([], ALIASES)
    asked = sorted({text(0)[:rng.randint(0, 5)] for _ in range(40)} | {"", "zz"})
    found = I.search_players(players, aliases, spark.createDataFrame([(q,) for q in asked] + [(None,)], "query string"), n=1000).collect()
    fields = {r.id: [x.lower() for x in (r.canonical_name, r.first_name, r.last_name) if x is not None] for r in players.collect()}
    want = {(q, i) for q in asked for i, texts in fields.items() if any(q in x for x in texts)}
    assert {(r["query"], r.id) for r in found} == want and len(found) == len(want)
    assert I.search_players(players, aliases, spark.createDataFrame([], "query string")).count() == 0


def test_containment_broadcasts_nothing(spark):
    names = spark.createDataFrame([("Ann One",), ("Bob Two",)], "name string")
    wanted = spark.createDataFrame([("one",)], "needle string")
    found = I._containing(names.select(F.lower("name").alias("name")), "name", wanted, "needle")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    players = spark.createDataFrame([player(1, "A One")], PLAYERS)
    searched = I.search_players(players, spark.createDataFrame([], ALIASES), wanted.withColumnRenamed("needle", "query"))
    assert "BroadcastHashJoin" not in searched._jdf.queryExecution().executedPlan().toString()


def test_frequent_short_pieces_do_not_pair_all_names(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("ab") for _ in range(14)) for _ in range(400)}
    texts = spark.createDataFrame([(x,) for x in names], "text string")
    met = I._meeting(texts, "text", texts.withColumnRenamed("text", "needle"), "needle")
    assert met.count() <= 4 * len(names)


def test_candidates_keep_the_best_of_each_chunk(spark, monkeypatch):
    rng = random.Random(8)
    names = lambda n: sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(n)})
    a = spark.createDataFrame([(f"A{i}", x, "QB", "KC") for i, x in enumerate(names(15))], "a_id string, name string, pos string, team string")
    b = spark.createDataFrame([(f"B{i:02}", x, "QB", "KC") for i, x in enumerate(names(60))], "b_id string, name string, pos string, team string")
    questions = a.selectExpr("pos", "'=KC' AS _scope", "name AS _text")
    texts = b.selectExpr("pos", "'=KC' AS _scope", "name AS _b_text", "b_id AS _first")
    assert I._best_of_chunks(questions, texts, 2, 0.3).count() <= 2 * questions.count()
    score = F.round(N.text_similarity(F.col("name"), F.col("b_name")), 6)
    pairs = a.join(b.withColumnRenamed("name", "b_name"), ["pos", "team"]).withColumn("s", score).filter("s > 0.3").collect()
    want = {(r.a_id, i + 1, q.b_id) for r in a.collect() for i, q in enumerate(sorted((p for p in pairs if p.a_id == r.a_id), key=lambda p: (-p.s, p.b_id))[:2])}
    for size in (I.CHUNK, 7):
        monkeypatch.setattr(I, "CHUNK", size)
        assert {(r.a_id, r["rank"], r.b_id) for r in I.match_candidates(a, b, n=2).collect()} == want
