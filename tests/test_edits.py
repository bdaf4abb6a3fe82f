import random
import time

import numpy as np
from pyspark.sql import functions as F

from rosterlab.functions import names as N
from rosterlab.functions.edits import Offered
from rosterlab.operators import identity as I


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_distances_of_any_length():
    rng = random.Random(1)
    for low, high in ((0, 6), (0, 16), (10, 32), (50, 70), (0, 200)):
        word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(low, high)))  # noqa: E731, B023
        texts, asked = [word() for _ in range(20)], [word() + rng.choice(["", "z"]) for _ in range(10)]
        offered = Offered(texts)
        assert offered.distances(asked).tolist() == [[distance(t, a) for a in asked] for t in offered.texts]


def test_many_pairs_take_little_time():
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfghklmn") for _ in range(rng.randint(9, 13))) for _ in range(4500)]
    start = time.process_time()
    who, what = Offered(words[:4000]).best(words[4000:], np.arange(4000), 5, 0.3)
    assert len(who) == len(what) == 2500
    assert time.process_time() - start < 2  # two million pairs


def test_candidates_equal_the_scores_of_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé🏈 ") for _ in range(rng.randint(0, 6)))
    schema = "{}_id long, name string, pos string, team string"
    a = spark.createDataFrame([(i, word(), "QB", rng.choice(["KC", "BUF", None])) for i in range(30)], schema.format("a"))
    b = spark.createDataFrame([(i, word(), "QB", "KC") for i in range(50)], schema.format("b"))
    score = F.round(N.text_similarity(N.similarity_text(F.col("a.name")), N.similarity_text(F.col("b.name"))), 6)
    pairs = a.alias("a").crossJoin(b.alias("b")).select("a_id", "b_id", score.alias("s")).filter("s > 0.1").collect()
    want = set()
    for a_id in {p.a_id for p in pairs}:
        own = sorted((p for p in pairs if p.a_id == a_id), key=lambda p: (-p.s, -1 if p.b_id is None else p.b_id))
        want |= {(a_id, rank, p.b_id, p.s) for rank, p in enumerate(own[:4], 1)}
    assert {(r.a_id, r["rank"], r.b_id, r.similarity) for r in I.match_candidates(a, b, n=4, threshold=0.1).collect()} == want
