import datetime
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rosterlab.functions import names as N
from rosterlab.functions import values as V
from rosterlab.operators.normalise import normalise_salaries
from rosterlab.sources.salaries import MissingColumns, override_columns, resolve_synonyms, scan_weekly


def apply(spark, values, column, ddl="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_name_key_edge_cases(spark):
    given = ["D.J. Moore", "Amon-Ra St. Brown", "Odell Beckham Jr.", "Ken Jr. Walker III", "Henry V", "José Ñandú", "", None, "ﬁnn Æ", "  A   B "]
    assert apply(spark, given, N.name_key) == [
        "dj moore", "amonra st brown", "odell beckham", "ken walker", "henry v", "jose nandu", "", None, "finn", "a b",
    ]


def test_accent_folding_matches_unicode_decomposition(spark):
    chars = [chr(c) for c in range(0xA0, 0x250)] + [chr(c) for c in range(0x1E00, 0x1F00)]
    got = apply(spark, chars, N.fold_accents)

    def expected(c):
        return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))

    # Only the letters, digits and spaces that survive the match key matter.
    keep = lambda s: re.sub(r"[^A-Za-z0-9 ]", "", s)
    wrong = [(c, g) for c, g in zip(chars, got, strict=True) if keep(g) != keep(expected(c)) and (c < chr(0x250) or len(keep(expected(c))) == 1)]
    assert wrong == []
    assert apply(spark, ["é"], N.fold_accents) == ["e"]


def test_teams(spark):
    assert apply(spark, ["jac", " LA ", "WSH", "KC", "xyz", None], N.canon_team) == ["JAX", "LAR", "WAS", "KC", "XYZ", None]


def test_defense_words(spark):
    assert apply(spark, ["Bears D/ST", "Texas Defense", "Def Leppard", "Defoe", "DST", None], N.is_defense) == [True, True, True, False, True, None]


def test_game_text(spark):
    given = ["CIN@CLE 09/07/2025 01:00PM ET", "CIN @ CLE", "CIN@CLE 13/45/2025", "09/07/2025", None]
    assert apply(spark, given, N.game_away) == ["CIN", "CIN", "CIN", None, None]
    assert apply(spark, given, N.game_home) == ["CLE", "CLE", "CLE", None, None]
    assert apply(spark, given, N.game_date) == [datetime.date(2025, 9, 7), None, None, None, None]


def test_positions(spark):
    assert apply(spark, ["RB/FLEX", "D/ST", "DEF", "d", " wr ", None], N.canon_position) == ["RB", "DST", "DST", "DST", "WR", None]


def test_split_name(spark):
    given = ["Patrick Mahomes", "Amon-Ra St. Brown", "Cher", None]
    assert apply(spark, given, lambda x: N.split_name(x)[0]) == ["Patrick", "Amon-Ra", "Cher", None]
    assert apply(spark, given, lambda x: N.split_name(x)[1]) == ["Mahomes", "St. Brown", "", None]


def test_numbers(spark):
    assert apply(spark, ["7000", "n/a", "-1", "0", None], V.to_number) == [7000.0, None, -1.0, 0.0, None]
    assert apply(spark, [4499, 4500, 6500, 6501], V.noise_band, "int") == [0.08, 0.04, 0.04, 0.02]


def test_season(spark):
    given = [datetime.date(2025, 1, 5), datetime.date(2025, 9, 7)]
    assert apply(spark, given, V.season_of, "date") == [2024, 2025]


def test_sequence_similarity_equals_difflib(spark):
    pairs = [("A.J. Brown", "AJ Brown"), ("Brian Robinson", "Bijan Robinson"), ("Kupp", "Cooper Kupp"), ("x", "y")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in rows.select("i", N.sequence_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    for (a, b), score in zip(pairs, got, strict=True):
        x, y = (t.lower().replace(".", "").replace(" ", "") for t in (a, b))
        want = 1.0 if x == y else min(1.0, SequenceMatcher(None, x, y).ratio() + (0.2 if x in y or y in x else 0.0))
        assert score == pytest.approx(want)


def test_noise_is_keyed_and_has_the_stated_spread(spark):
    rows = spark.range(40000).withColumn("band", F.lit(3000))
    draw = lambda df: df.select("id", V.perturbed(F.lit(10.0), F.col("band"), F.col("id"), seed=7).alias("x"))
    a = {r.id: r.x for r in draw(rows.repartition(3)).collect()}
    b = {r.id: r.x for r in draw(rows.repartition(11)).collect()}
    assert a == b
    stats = draw(rows).agg(F.avg("x"), F.stddev("x")).first()
    assert stats[0] == pytest.approx(10.0, abs=0.02)
    assert stats[1] == pytest.approx(0.8, rel=0.03)


def test_normalise_handles_schema_variants(spark):
    base = spark.createDataFrame(
        [("Joe Burrow", "QB", "cin", "CIN@CLE 09/07/2025 01:00PM ET", "6800"), ("Browns D/ST", "DST", "CLE", None, "x")],
        "Name string, `Roster Position` string, TeamAbbrev string, `Game Info` string, Salary string",
    )
    first, second = normalise_salaries(base).orderBy(F.desc("name")).collect()
    assert (first.opp, first.is_home, first.salary, first.name_key) == ("CLE", False, 6800, "joe burrow")
    assert (second.opp, second.is_home, second.salary, second.is_dst) == (None, None, None, True)
    stated = normalise_salaries(base.withColumn("Opponent", F.lit("wsh"))).first()
    assert stated.opp == "WAS"
    with pytest.raises(MissingColumns, match="Salary, GameInfo or Game Info"):
        normalise_salaries(base.drop("Salary", "Game Info"))


def test_header_resolution(spark):
    rows = spark.createDataFrame([("a", "QB", "1", "2")], "`Player Name` string, POSITION string, FPTS string, Points string")
    assert resolve_synonyms(rows).columns == ["name", "pos", "proj_points"]
    assert resolve_synonyms(rows).first().proj_points == "1"
    with pytest.raises(MissingColumns, match="name .*; proj_points"):
        resolve_synonyms(rows.select("POSITION"))
    salaries = spark.createDataFrame([("n", "X", "Y", "RB", "RB/FLEX")], "Name string, Team string, TeamAbbrev string, Position string, `Roster Position` string")
    got = override_columns(salaries).first()
    assert (got.team, got.pos) == ("Y", "RB/FLEX")
    weekly = spark.createDataFrame([(1, "QB", 2.0), (2, None, 1.0), (3, "RB", None)], "player_id int, position string, fantasy_points_ppr double")
    assert [r.player_id for r in scan_weekly(weekly).collect()] == [1]
