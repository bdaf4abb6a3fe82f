import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rosterlab.operators import forest as D
from rosterlab.operators import models as M


@pytest.fixture(scope="module")
def weekly(spark):
    rows = spark.range(1500).withColumn("pos", F.when(F.col("id") < 700, "QB").otherwise("DST"))
    columns = {c: (F.col("id") * m % 97).cast("double") for c, m in (("fp_avg_3", 5), ("sacks_avg", 7), ("interceptions_avg", 11), ("fumbles_avg", 13), ("tds_avg", 17))}
    return rows.select(
        F.col("id").alias("player_id"), F.lit(1).alias("seq"), "pos", (F.col("id") % 20).cast("double").alias("passing_yards_avg"),
        *[c.alias(n) for n, c in columns.items()], (F.col("id") * 5 % 97 + F.col("id") % 20).cast("double").alias(M.TARGET),
    ).persist()


def test_full_forests_are_grown_whole_and_kept_as_tables(spark, weekly, tmp_path):
    models, predictions = M.train_position_models(weekly, ["player_id", "seq"])
    assert set(models) == {"QB", "DST"}
    for model in models.values():
        assert isinstance(model, D.TableForest)  # before, the driver held every node
        assert model.nodes.select("tree").distinct().count() == 300
        trees = model.nodes.groupBy("tree").agg(F.count("*").alias("n"), F.count_if(F.col("feature") < 0).alias("leaves"), F.max("node").alias("last"))
        assert trees.filter("n != 2 * leaves - 1 OR last != n - 1 OR n < 100").count() == 0
    metrics = {r.pos: r for r in M.model_metrics(predictions).collect()}
    assert metrics["QB"].r2 > 0.8 and metrics["DST"].r2 > 0.2
    assert sum(r.train_rows + r.validation_rows for r in metrics.values()) == 1500
    M.save_models(models, str(tmp_path))
    loaded = M.load_models(str(tmp_path))
    assert set(loaded) == {"QB", "DST"}
    rows = weekly.filter("pos = 'QB'")
    predicted = lambda m: {r.player_id: r.prediction for r in m.transform(rows).collect()}
    assert predicted(loaded["QB"]) == pytest.approx(predicted(models["QB"]), rel=1e-12)


def test_a_forest_does_not_depend_on_the_partitioning(weekly):
    rows = weekly.filter("pos = 'QB'")
    a, b = (D.fit(r, ["player_id", "seq"], ["fp_avg_3", "passing_yards_avg"], M.TARGET, 12, 30, 42) for r in (rows.repartition(7), rows.coalesce(1)))
    nodes = lambda m: sorted((r.tree, r.node, r.feature, r.bin, r.child, round(r.value, 9)) for r in m.nodes.collect())
    assert nodes(a) == nodes(b)


def test_crowded_cells_and_copies_keep_their_rows(weekly, monkeypatch):
    rows = weekly.filter("pos = 'QB'")
    twice = rows.unionByName(rows)
    model = D.fit(twice, ["player_id", "seq"], ["fp_avg_3", "passing_yards_avg"], M.TARGET, 5, 30, 42)
    plain = sorted(tuple(r) for r in model.transform(twice).select("player_id", "prediction").collect())
    monkeypatch.setattr(D, "CROWDED_CELL", 3)
    crowded = sorted(tuple(r) for r in model.transform(twice).select("player_id", "prediction").collect())
    assert len(plain) == 1400 and crowded == plain


def test_copies_of_a_row_are_drawn_one_by_one(spark):
    rows = spark.range(1).select(F.lit(1).alias("k"), F.lit(0.0).alias("x"), F.lit(2.0).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("col")
    cells = rows.select(D.cell_of(["x"], [[]]).alias("cell")).distinct().collect()
    assert [r.cell for r in cells] == [0]
    model = D.fit(rows, ["k"], ["x"], "y", 10, 30, 1)
    assert [(r.tree, r.value) for r in model.nodes.orderBy("tree").collect()] == [(t, 2.0) for t in range(10)]


def test_bins_follow_the_thresholds(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.5, 9.0)], "x double")
    assert [r.cell for r in rows.select(D.cell_of(["x"], [[0.0, 1.0]]).alias("cell")).collect()] == [0, 0, 1, 1, 2, 2]
    assert D.split_points(rows, ["x"]) == [[-0.5, 0.25, 0.75, 1.25, 5.25]]
    with pytest.raises(PySparkException, match="null or NaN"):
        spark.createDataFrame([(None,)], "x double").select(D.cell_of(["x"], [[0.0]])).collect()


def test_best_split_is_the_one_of_all_splits(monkeypatch):
    monkeypatch.setattr(D, "CHUNK_NODES", 2)
    draws = np.random.default_rng(3)
    cell = np.sort(draws.choice(1 << 10, 300, replace=False))
    node = np.sort(draws.integers(0, 5, 300))
    w, y = draws.integers(1, 4, 300).astype(float), draws.normal(size=300)
    weight, total = np.bincount(node, w), np.bincount(node, w * y)
    feature, split = D.best_splits(cell, node, w, w * y, weight, total, 2, np.uint64(9), 0)

    def spread(mask):
        mean = np.average(y[mask], weights=w[mask])
        return (w[mask] * (y[mask] - mean) ** 2).sum()

    for n in range(5):
        bins = (cell >> (5 * feature[n])) & 31
        cuts = [b for b in range(31) if ((node == n) & (bins <= b)).any() and ((node == n) & (bins > b)).any()]
        cost = {b: spread((node == n) & (bins <= b)) + spread((node == n) & (bins > b)) for b in cuts}
        assert cost[split[n]] == pytest.approx(min(cost.values()))


def test_a_tree_grown_to_the_end_separates_what_its_bins_tell_apart():
    cell = np.arange(1 << 10, dtype=np.int64)  # two features: half of the splits are offered, so some nodes stay whole
    w, y = np.ones(len(cell)), (cell * 37 % 1009).astype(float)
    feature, split, child, value = D.grow_tree(cell, w, w * y, 2, 30, np.uint64(5))
    at = np.zeros(len(cell), dtype=np.int64)
    for _ in range(31):
        inner = child[at] >= 0
        step = child[at] + (((cell >> (5 * np.maximum(feature[at], 0))) & 31) > split[at])
        at = np.where(inner, step, at)
    assert (child[at] < 0).all()
    for leaf in np.unique(at):
        assert value[leaf] == pytest.approx(y[at == leaf].mean())
    assert len(np.unique(at)) == (child < 0).sum() > 100
