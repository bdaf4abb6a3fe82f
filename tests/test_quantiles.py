import random

import numpy as np
import pytest

from rosterlab.operators import pool as P

QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q0": 0.0, "q100": 1.0}


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_of_continuous_and_repeated_values(spark, accuracy):
    rng = random.Random(accuracy)
    values = {
        1: [rng.lognormvariate(3, 4) for _ in range(6000)],
        2: [rng.choice([100.0, 100.0, rng.random()]) for _ in range(3000)],
        3: [7.5],
        4: [3.0, -1.0],
        5: [5.0] * 500,
        None: [float(rng.randint(0, 50)) for _ in range(150)],
    }
    rows = [(k, v) for k, many in values.items() for v in many] + [(1, None), (6, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "slate_id int, amount double").repartition(6)
    got = {r.slate_id: r for r in P.exact_quantiles(table, "slate_id", "amount", QUANTILES, accuracy).collect()}
    assert got.keys() == values.keys()
    for k, many in values.items():
        for name, q in QUANTILES.items():
            assert got[k][name] == pytest.approx(np.quantile(many, q), rel=1e-12, abs=1e-12), (k, name)


def test_slate_without_numbers_keeps_its_row(spark):
    pool = spark.createDataFrame([(1, "5000"), (1, "5100"), (2, "x"), (None, "40")], "slate_id int, salary string")
    got = {r.slate_id: r for r in P.salary_stats(pool).collect()}
    assert (got[1].q25, got[1].q50, got[1].q75) == (5025.0, 5050.0, 5075.0)
    assert got[2].q50 is None and got[2].invalid_count == 1
    assert got[None].q50 == 40.0
