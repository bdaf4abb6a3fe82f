import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlab import fixtures
from rosterlab.operators import lineups as L
from rosterlab.plans.report import lineup_report
from rosterlab.session import placed_joins

SCHEMA = (
    "contest_id bigint, lineup bigint, slot string, player_id bigint, name string, pos string, team string, opp string, salary string, proj_points string"
)
SLOTS = [("QB", "QB"), ("RB", "RB"), ("RB", "RB"), ("WR", "WR"), ("WR", "WR"), ("WR", "WR"), ("TE", "TE"), ("FLEX", "RB"), ("DST", "DST")]


def lineup(lineup_id, contest=1, salary=5000, change=None, players=None):
    rows = []
    for i, (slot, pos) in enumerate(SLOTS):
        player = players[i] if players else i
        rows.append([contest, lineup_id, slot, player, f"p{player}", pos, f"T{player % 4}", None, str(salary), "10.5"])
    if change:
        change(rows)
    return rows


def table(spark, *groups):
    return L.drop_total_rows(spark.createDataFrame([tuple(r) for g in groups for r in g], SCHEMA))


def set_value(index, column, value):
    return lambda rows: rows[index].__setitem__(column, value)


def test_validation_edge_cases(spark):
    def two_flex(rows):
        rows[2][2] = "FLEX"

    def flex_qb(rows):
        rows[7][5] = "QB"

    rows = table(
        spark,
        lineup(1),
        lineup(2, change=lambda r: r.pop()),
        lineup(3, change=lambda r: r.append([*r[0]])),
        lineup(4, change=two_flex),
        lineup(5, change=flex_qb),
        lineup(6, change=set_value(0, 8, "10000")),
        lineup(7, change=set_value(0, 8, "10001")),
        lineup(8, change=lambda r: r.append([1, 8, "total", None, None, None, None, None, "45000", "94.5"])),
        lineup(9, change=set_value(0, 5, "WR")),
    )
    errors = {r.lineup: r.errors for r in L.validate_lineups(rows).collect()}
    assert errors[1] == errors[6] == errors[8] == []
    assert errors[2] == ["Expected 9 players, got 8"]
    assert errors[3] == ["Expected 9 players, got 10"]
    assert errors[4] == ["Expected exactly 1 FLEX, found 2"]
    assert errors[5] == ["FLEX must be RB/WR/TE, got QB"]
    assert errors[7] == ["Salary 50001 exceeds cap 50000"]
    assert errors[9] == ["Needs at least 1 QB, has 0"]
    strict = {r.lineup: r.result for r in L.check_slots(rows).collect()}
    assert strict[1] == "OK" and strict[4] == "Need 2 RB, found 1" and strict[7] == "Salary cap exceeded: 50001 > 50000"


def test_single_lineup_contest(spark):
    got = L.overlap_summary(table(spark, lineup(1))).first()
    assert (got.min_pair_overlap, got.min_pair_uniques, got.worst_a, got.worst_b) == (0, 9, None, None)


def random_contests(seed, contests, most):
    rng = random.Random(seed)
    groups, sets, lineup_id = [], {}, 0
    for contest in range(contests):
        for _ in range(rng.randint(1, most)):
            players = rng.sample(range(16 if contest % 2 else 40), 9)
            groups.append(lineup(lineup_id, contest, players=players))
            sets.setdefault(contest, {})[lineup_id] = set(players)
            lineup_id += 1
    return groups, sets


def test_overlap_equals_brute_force(spark):
    groups, sets = random_contests(5, 6, 12)
    rows = table(spark, *groups)
    want, summary = {}, {}
    for contest, lineups in sets.items():
        pairs = [(len(lineups[a] & lineups[b]), a, b) for a, b in combinations(sorted(lineups), 2)]
        for shared, _, _ in pairs:
            want[(contest, shared)] = want.get((contest, shared), 0) + 1
        least = min(pairs, default=(0, None, None))
        summary[contest] = (least[0], 18 - 2 * max(p[0] for p in pairs) if pairs else 9, least[1], least[2])
    assert {(r.contest_id, r.shared): r.pairs for r in L.lineup_overlap(rows).collect()} == want
    got = {r.contest_id: (r.min_pair_overlap, r.min_pair_uniques, r.worst_a, r.worst_b) for r in L.overlap_summary(rows).collect()}
    assert got == summary


def test_overlap_of_wide_and_equal_lineups(spark):
    def widen(rows):
        rows.extend([[*rows[0][:3], 100 + i, f"x{i}", *rows[0][5:]] for i in range(6)])

    rows = table(spark, lineup(1, change=widen), lineup(2), lineup(3, change=widen))
    assert {r.shared: r.pairs for r in L.lineup_overlap(rows).collect()} == {9: 2, 15: 1}
    got = L.overlap_summary(rows).first()
    assert (got.min_pair_overlap, got.min_pair_uniques, got.worst_a, got.worst_b) == (9, -12, 1, 2)


def test_overlap_of_a_large_contest_with_a_wide_lineup(spark):
    """3,000 lineups of nine from 60 players, one of them with fifteen, some repeated."""
    rng = np.random.default_rng(11)
    sets = np.argsort(rng.random((3000, 60)), axis=1)[:, :9]
    sets[1000:1200] = sets[7]
    rows = [(1, i, int(p)) for i, s in enumerate(sets) for p in s] + [(1, 0, int(p)) for p in [x for x in range(60) if x not in sets[0]][:6]]
    held = np.zeros((3000, 60), int)
    for _, i, p in rows:
        held[i, p] = 1
    shared = (held @ held.T)[np.triu_indices(3000, 1)]
    df = spark.createDataFrame(rows, "contest_id long, lineup long, player_id long")
    assert {r.shared: r.pairs for r in L.lineup_overlap(df).collect()} == dict(zip(*[x.tolist() for x in np.unique(shared, return_counts=True)], strict=True))
    a, b = (x[int(np.argmin(shared))] for x in np.triu_indices(3000, 1))
    got = L.overlap_summary(df).first()
    assert (got.min_pair_overlap, got.min_pair_uniques, got.worst_a, got.worst_b) == (shared.min(), 18 - 2 * shared.max(), a, b)


def test_stacks_and_missing_qb(spark):
    def stack(rows):
        rows[0][6], rows[3][6], rows[6][6], rows[0][7], rows[4][6] = "KC", "KC", "KC", "BUF", "BUF"

    rows = table(spark, lineup(1, change=stack), lineup(2, change=set_value(0, 5, "RB")))
    got = L.qb_stack_join(rows.filter("lineup = 1")).first()
    assert (got.qb_team, got.receivers, got.stack_size) == ("KC", "p3; p6", 2)
    back = {r.lineup: (r.qb, r.has_stack, r.bring_back) for r in L.bring_back(rows).collect()}
    assert back == {1: ("p0", True, True), 2: ("Unknown", False, False)}


def test_rb_against_defense(spark):
    def clash(rows):
        rows[1][7], rows[8][6] = "DEN", "DEN"

    def unknown(rows):
        rows[1][7], rows[8][6] = "UNK", "UNK"

    rows = table(spark, lineup(1, change=clash), lineup(2, change=unknown))
    assert [(r.lineup, r.rb_id, r.dst_id) for r in L.rb_vs_dst_conflicts(rows).collect()] == [(1, 1, 8)]


def test_exposure_counts_and_percentages(spark):
    rows = table(spark, lineup(1), lineup(2), lineup(3, players=[20, *range(1, 9)]))
    got = {r.name: (r.appearances, r.exposure_pct, r.avg_salary, r.avg_proj) for r in L.player_exposure(rows).collect()}
    assert got["p0"] == (2, 66.67, 5000.0, 10.5) and got["p20"] == (1, 33.33, 5000.0, 10.5)
    alerts = {r.player_id: (r.exposure_count, r.limit_count, r.at_limit) for r in L.exposure_alerts(rows, 0.1).collect()}
    assert alerts[20] == (1, 1, True)


def test_report_without_contest_or_ids(spark):
    rows = spark.createDataFrame([tuple(r) for g in (lineup(1), lineup(2)) for r in g], SCHEMA).drop("contest_id", "player_id", "opp")
    reports = lineup_report(rows)
    summary = reports["validation_report"].first()
    assert (summary.total_lineups, summary.lineups_with_errors, summary.pairwise_uniqueness.min_pair_overlap) == (2, 0, 9)
    assert reports["player_exposure"].count() == 9


def test_validation_summary_maps_lineups_to_errors(spark):
    short = lambda rows: rows.pop()
    rows = table(
        spark, lineup(10, change=short), lineup(9, change=set_value(0, 8, "10001")), lineup(2), lineup(None, change=short),
        lineup(1, contest=2), lineup(2, contest=2, players=[20, *range(1, 9)]),
    )
    got = {r.contest_id: r for r in L.validation_summary(rows).collect()}
    assert got[1].errors == {"9": ["Salary 50001 exceeds cap 50000"], "10": ["Expected 9 players, got 8"], "null": ["Expected 9 players, got 8"]}
    assert (got[1].total_lineups, got[1].lineups_with_errors) == (4, 3)
    assert (got[2].errors, got[2].pairwise_uniqueness.asDict()) == ({}, {"min_pair_overlap": 8, "min_pair_uniques": 2, "worst_a": 1, "worst_b": 2})


def test_assign_slots_labels_the_seventh_skill_player(spark):
    rows = table(spark, lineup(1)).drop("slot")
    slots = sorted(r.slot for r in L.assign_slots(rows).collect())
    assert slots == sorted(s for s, _ in SLOTS)
    assert L.total_rows(table(spark, lineup(1))).filter(F.col("slot") == "TOTAL").first().salary == 45000


def _contests(spark, sizes):
    rng = random.Random(21)
    rows = {(c, i): rng.sample(range(30), 9) for c, n in sizes.items() for i in range(n)}
    df = spark.createDataFrame([(*key, p) for key, players in rows.items() for p in players], "contest_id bigint, lineup bigint, player_id bigint")
    return df, rows


def test_small_and_large_contests_equal_brute_force(spark):
    df, rows = _contests(spark, {1: 1, 2: 12, 3: L.SMALL_CONTEST, 4: L.SMALL_CONTEST + 6})
    pairs = [(a[0], len(set(rows[a]) & set(rows[b])), a[1], b[1]) for a, b in combinations(sorted(rows), 2) if a[0] == b[0]]
    assert {(r.contest_id, r.shared): r.pairs for r in L.lineup_overlap(df).collect()} == Counter((c, n) for c, n, _, _ in pairs)
    got = {r.contest_id: (r.min_pair_overlap, r.min_pair_uniques, r.worst_a, r.worst_b) for r in L.overlap_summary(df).collect()}
    want = {c: (*(x := min(p for p in pairs if p[0] == c))[1:2], 18 - 2 * max(p[1] for p in pairs if p[0] == c), *x[2:]) for c in (2, 3, 4)}
    assert got == want | {1: (0, 9, None, None)}


def test_small_contests_stage_one_row_a_lineup(spark):
    df, _ = _contests(spark, {2: 12, 4: L.SMALL_CONTEST + 6})
    small, members = L._rosters(df)
    assert [r.contest_id for r in small.collect()] == [2]
    assert {r.contest_id for r in members.select("contest_id").distinct().collect()} == {4}


def test_contest_sizes_are_not_broadcast_and_do_not_broadcast(spark):
    df, _ = _contests(spark, {1: 3})
    rows = df.selectExpr("*", "'A' AS name", "'QB' AS pos", "'KC' AS team", "1 AS salary", "1.0 AS proj_points")
    assert "BroadcastHashJoin" not in L.player_exposure(rows)._jdf.queryExecution().executedPlan().toString()


def test_lineups_join_one_row_an_order(spark, tmp_path):
    parts = [(k, f"part {k}", None if k % 41 == 0 else f"Brand#{k % 25 + 1}", t, 1, 1.0) for k in range(600) for t in [["ECONOMY", "PROMO", "LARGE", "MEDIUM", "STANDARD", "SMALL", None][k % 7]] if k < 250 or t != "STANDARD"]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    orders = [(i, None if i % 17 == 0 else i % 23) for i in range(200)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = fixtures.view(spark, str(tmp_path), "v_lineups")
    plain = spark.sql(fixtures.with_views("SELECT * FROM v_lineups", "spark"))
    assert got.schema.names == plain.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in plain.schema]
    assert got.count() == plain.count() > 0 and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    broken = spark.sql(fixtures.with_views("SELECT * FROM v_broken_lineups", "spark"))
    assert sorted(map(tuple, fixtures.view(spark, str(tmp_path), "v_broken_lineups").collect()), key=repr) == sorted(map(tuple, broken.collect()), key=repr)
    # the nine places of an order come after the join with the players
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join Inner")


def test_exposure_and_stacks_by_slate_are_not_shuffled(spark, sf_dir):
    rows = fixtures.view(spark, sf_dir, "v_lineups")
    assert L.contest_columns(rows, "slate_id", "lineup") == ["slate_id"]
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    with placed_joins(spark):
        exposure, stacks = L.player_exposure(rows, ["slate_id"]), L.qb_stack_join(rows, ["slate_id"])
        for frame in (exposure, stacks):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert not any("contest_id" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
        assert same(exposure, L.player_exposure(rows)) and same(stacks.drop("slate_id"), L.qb_stack_join(rows))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert same(L.stack_sequence(rows, ["slate_id"]), L.stack_sequence(rows))


def test_a_contest_of_two_slates_or_none_is_not_cut_by_slate(spark):
    rows = lambda *slates: spark.createDataFrame([(c, s) for c, s in slates], "contest_id bigint, slate_id bigint")
    assert L.contest_columns(rows((1, 5), (1, 5), (2, 6), (None, 7)), "slate_id") == ["slate_id"]
    assert L.contest_columns(rows((1, 5), (1, 6), (2, 6)), "slate_id") == []
    assert L.contest_columns(rows((1, 5), (1, None)), "slate_id") == L.contest_columns(rows((1, None)), "slate_id") == []
    assert L.contest_columns(rows(), "slate_id") == []
