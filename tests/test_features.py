import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.operators import features as W
from rosterlab.operators.keyed import hashed_number, running_number


def weekly(seed, players, rows):
    rng = random.Random(seed)
    out = []
    for p in range(players):
        for i in range(rng.choice([1, 2, rows])):
            out.append((p, 2020 + i // 7, i % 7 // 3, i, None if rng.random() < 0.25 else float(rng.randint(0, 40))))
    return pd.DataFrame(out, columns=["player_id", "season", "week", "seq", "fantasy_points_ppr"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rolling_equals_lagged_pandas_mean(spark, seed):
    frame = weekly(seed, 12, 40)
    lagged = frame.groupby("player_id")["fantasy_points_ppr"].transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    want = {(p, s): None if pd.isna(v) else v for p, s, v in zip(frame.player_id, frame.seq, lagged, strict=True)}
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "player_id bigint, season bigint, week bigint, seq bigint, fantasy_points_ppr double")
    got = {(r.player_id, r.seq): r.fp_avg_3 for r in W.rolling_features(rows, {"fp_avg_3": "fantasy_points_ppr"}).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(value)), key


def test_rolling_by_season_chunks(spark):
    rows = spark.createDataFrame([(1, 2023, 17, 10.0), (1, 2023, 18, 20.0), (1, 2024, 1, 30.0), (1, 2024, 2, 40.0)], "player_id int, season int, week int, fantasy_points_ppr double")
    got = W.rolling_features(rows, {"fp_avg_3": "fantasy_points_ppr"}, chunk=("season",), order=("week",)).orderBy("season", "week")
    assert [r.fp_avg_3 for r in got.collect()] == [None, 10.0, 15.0, 20.0]


def test_null_addend_makes_the_sum_null(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 2.0, 1.0), (1, 1, 2, 2, None, 1.0), (1, 1, 3, 3, 0.0, 0.0)], "player_id int, season int, week int, seq int, a double, b double")
    got = W.rolling_sums_of_columns(rows, {"s": ["a", "b"]}).orderBy("seq").collect()
    assert [r.s for r in got] == [None, 3.0, 3.0]


def test_placeholders_only_when_a_column_is_absent(spark):
    full = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], list(C.DEFENSE_PLACEHOLDERS))
    assert W.dst_placeholders(full).first().sacks_avg == 1.0
    assert W.dst_placeholders(full.drop("takeaways_avg")).first().sacks_avg == 2.1


def test_running_and_hashed_numbers_do_not_depend_on_partitioning(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("v"))
    numbered = running_number(rows.repartition(5), ["k"], "v", "n", width=100)
    for k in range(3):
        got = [r.n for r in numbered.filter(F.col("k") == k).orderBy("v").collect()]
        assert got == list(range(1, len(got) + 1))
    names = spark.range(500).select(F.concat(F.lit("p"), "id").alias("name"))
    a = {r.name: r.n for r in hashed_number(names.repartition(7), "name", "n").collect()}
    b = {r.name: r.n for r in hashed_number(names.coalesce(1), "name", "n").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 501))


@pytest.mark.parametrize("cut_rows", [1, 40, 150])
def test_one_week_of_one_player_is_cut_into_ranges(spark, cut_rows):
    rng = random.Random(cut_rows)
    hot = [(1, 2023, 4, seq, float(rng.randint(0, 40))) for seq in range(400)]
    rest = [(p, 2023, w, 1000 + 10 * w + i, float(rng.randint(0, 40))) for p in range(4) for w in range(1, 9) for i in range(3)]
    frame = pd.DataFrame(hot + rest, columns=["player_id", "season", "week", "seq", "fantasy_points_ppr"]).sort_values(["season", "week", "seq"])
    frame["want"] = frame.groupby("player_id")["fantasy_points_ppr"].transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    rows = spark.createDataFrame((hot + rest)[::-1], "player_id bigint, season bigint, week bigint, seq bigint, fantasy_points_ppr double")
    got = W.rolling_features(rows, {"fp_avg_3": "fantasy_points_ppr"}, cut_rows=cut_rows).collect()
    assert len(got) == len(frame)
    want = {(p, w, s): None if pd.isna(v) else v for p, w, s, v in zip(frame.player_id, frame.week, frame.seq, frame.want, strict=True)}
    for r in got:
        expected = want[r.player_id, r.week, r.seq]
        assert r.fp_avg_3 == (None if expected is None else pytest.approx(expected)), r
    cuts = W.cut_crowded_chunks(rows, "player_id", ["season", "week"], ["seq"], cut_rows).filter("week = 4 AND player_id = 1").groupBy("_cut").count().collect()
    assert len(cuts) > 1 and max(r["count"] for r in cuts) < 403
