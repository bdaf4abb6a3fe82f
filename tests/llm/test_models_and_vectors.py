"""Toxicity, language and vectors; the pipeline against brute force of its exact stages."""

from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from rosterlab.llm import op2_projections, op4_toxicity, op5_language, op7_substrings, op9_partenum, op10_packing

SMALL = "/root/testdata/sf0.01"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_edit_distance_allows():
    terms = ["idiot", "worthless", "scum", "disgusting", "trash"]
    lexicon = op4_toxicity.Lexicon(terms)
    r = random.Random(1)
    words = []
    for t in terms * 60:
        w = list(t)
        for _ in range(r.randint(0, 3)):
            at, kind = r.randrange(len(w) + 1), r.random()
            if kind < 0.4:
                w.insert(at, r.choice("abcdist1"))
            elif w and kind < 0.7:
                del w[min(at, len(w) - 1)]
            elif w:
                w[min(at, len(w) - 1)] = r.choice("abcdist1")
        words.append("".join(w))
    for w in [*words, "", "scun", "of"]:
        best = min((distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= lexicon.limit[i]) if any(distance(w, t) <= lexicon.limit[i] for i, t in enumerate(terms)) else None
        found = lexicon.match(w)
        assert (found is None) == (best is None), w
        if best is not None:
            assert found[1] == best[0], w
    assert op4_toxicity.Lexicon(["moron"], frozenset(["oron"])).match("oron") is None


def test_quotation_differs_from_abuse():
    scorer = op4_toxicity.Scorer(op4_toxicity.Lexicon(["idiot"]), np.zeros(7), np.ones(7), np.zeros(8))
    abuse, quote, clean, none = scorer.features(["you idiot !!", 'the word "idiot" is old', "a calm text", ""])
    assert abuse[3] == 0 and abuse[4] > 0
    assert quote[3] == 1 and quote[4] == 0
    assert not clean.any() and not none.any()


def test_toxicity_on_held_out_rows(spark):
    found = op4_toxicity.op4_toxicity(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.93
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or score is null").isEmpty()


def test_toxicity_without_labels_and_odd_rows(make, spark):
    docs = make([(1, "a b", 0.5), (None, None, 0.1), (2, "", 0.2), (2, "", 0.2)], ", score double")
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    out = op4_toxicity.score(docs, op4_toxicity.fit(docs, nothing)).collect()
    assert len(out) == 4 and all(r["score"] < 1e-6 for r in out)
    assert op4_toxicity.score(docs.limit(0), op4_toxicity.fit(docs.limit(0), nothing)).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = op5_language.op5_language(spark, SMALL)
    rows = found.join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert found.count() == 1000


def test_language_of_odd_texts(make, spark):
    docs = make([(i, "the cat and the dog", "x") for i in range(9)] + [(100, None, "x"), (101, " 12 !", "x"), (102, "", "x"), (103, "日本" * 900, "x")], ", lang_pred string")
    learned = docs.selectExpr("doc_id", "text", "if(doc_id < 9, if(doc_id % 2 = 0, 'aa', 'bb'), null) AS lang")
    out = {r["doc_id"]: r for r in op5_language.predict(docs, op5_language.fit(learned)).collect()}
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert out[103]["lang_pred"] in ("aa", "bb")
    blank = op5_language.fit(learned.withColumn("lang", learned["lang"].substr(0, 0)).where("false"))
    assert {r["lang_pred"] for r in op5_language.predict(docs, blank).collect()} == {"und"}


def test_regularised_weights_are_sparse():
    idf = np.ones(op5_language.FEATURES)
    rows = [(np.array([1, 5 + i % 40]), np.array([3.0, 1.0])) if i % 2 else (np.array([2, 5 + i % 40]), np.array([3.0, 1.0])) for i in range(200)]
    labels = np.arange(200) % 2
    weights, _ = op5_language.train_ftrl(rows, labels, 2, idf, l1=1.0)
    assert weights[1, 1] > 0 > weights[2, 1]
    assert (weights == 0).mean() > 0.99


def brute_vectors(vectors, ids, similar=0.9):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = v @ v.T >= similar - 1e-12
    np.fill_diagonal(near, False)
    group = np.array(ids)
    for _ in ids:
        group = np.array([min([g, *group[near[i]]]) for i, g in enumerate(group)])
    return {k: (int(near[i].sum()), int(group[i]), bool(group[i] == k)) for i, k in enumerate(ids)}


def test_vectors_of_dense_groups(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((30, 16))
    rows = [c + 0.08 * r.standard_normal(16) for c, n in zip(centres, [200, 60, *range(1, 29)], strict=True) for _ in range(n)]
    rows += [rows[0]] * 5
    ids = r.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    out = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in op2_projections.near_vectors(df, window=10).collect()}
    assert out == brute_vectors(np.array(rows), ids)
    members = df.selectExpr("1L AS component", "vec_id AS rep", "embedding AS v", "1L AS copies")
    n = {x["rep"]: x["n"] for x in op2_projections.link_counts(members, similar=-1e9, tile=40).collect()}
    assert set(n.values()) == {len(rows) - 1}


def planted_vectors(rows, pairs, cosine, seed=7, width=64, alike=0.8):
    """Unit vectors, a third of them in one loose cluster of mutual cosine `alike`, and the places of planted pairs in it and outside."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    v, third = unit(r.standard_normal((rows, width))), rows // 3
    centre = unit(r.standard_normal(width))
    v[:third] = unit(np.sqrt(alike) * centre + np.sqrt(1 - alike) * v[:third])
    at = np.concatenate([np.arange(0, 2 * pairs, 2), np.arange(rows - 2 * pairs, rows, 2)])
    side = r.standard_normal((len(at), width))
    side = unit(side - (side * v[at]).sum(1, keepdims=True) * v[at])
    v[at + 1] = cosine * v[at] + np.sqrt(1 - cosine**2) * side
    return v, at


@pytest.mark.parametrize(("window", "least"), [(2048, 1.0), (128, 0.98), (16, 0.9)])
def test_vectors_of_a_hot_cluster(spark, window, least):
    v, at = planted_vectors(6000, 100, 0.905)
    df = spark.createDataFrame(enumerate(v.tolist()), "vec_id long, embedding array<double>")
    out = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in op2_projections.near_vectors(df, window=window).collect()}
    together = [out[i][1] == out[i + 1][1] for i in at.tolist()]
    assert np.mean(together) >= least
    links = (v @ v.T >= 0.9).sum(1) - 1
    assert np.mean([out[i][0] == n for i, n in enumerate(links.tolist())]) >= least
    assert all(out[i][0] <= n for i, n in enumerate(links.tolist()))


def test_windows_reach_over_blocks_and_ranges(spark):
    v, _ = planted_vectors(1500, 40, 0.92)
    reps = spark.createDataFrame([(i, x, 64) for i, x in enumerate(v.tolist())], "rep long, v array<double>, size int")
    small = op2_projections.C.staged(reps.mapInArrow(op2_projections._rounded, "rep long, size int, q binary"))
    order = op2_projections.ordered(small, 0, 3)
    got = {(x["a"], x["b"]) for x in op2_projections.window_pairs(order, small, window=40, similar=0.85).collect()}
    rows = sorted(order.collect(), key=lambda x: (x["part"], x["at"]))
    assert [x["pass"] for x in rows] == sorted(x["pass"] for x in rows) and len(rows) == 4500
    near = {(min(x["rep"], y["rep"]), max(x["rep"], y["rep"])) for i, x in enumerate(rows) for y in rows[i + 1 : i + 41] if x["rep"] != y["rep"] and v[x["rep"]] @ v[y["rep"]] >= 0.85}
    label = lambda pairs: dict(zip(*[x.tolist() for x in op2_projections.C.forest(*np.array(sorted(pairs)).T)][::-1], strict=True))
    # a tree's edges lead to its root: they stay inside what true links join, and join all that the windows reach
    true = label({(i, j) for i, j in np.argwhere(np.triu(v @ v.T >= 0.85, 1)).tolist()})
    assert got and all(true.get(a, a) == true.get(b, b) for a, b in got)
    reached = label(got)
    assert all(reached.get(a, a) == reached.get(b, b) for a, b in near)


def test_the_limit_is_exact(spark):
    # 9 of 10: 81 + 16 + 3 = 100
    ten, other = [10, 0, 0, 0, 0, 0], [9, 4, 1, 1, 1, 0]
    below = [9, 4, 1, 1, 1, 1e-7]
    rows = [(1, ten), (2, other), (3, [10.0 * 3, 0, 0, 0, 0, 0]), (4, [-x for x in ten]), (5, [-x for x in below])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    out = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in op2_projections.near_vectors(df).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_passes_follow_from_the_signs():
    for bits in (1, 8, 20):
        alike = (1 - np.arccos(0.9) / np.pi) ** bits
        need = op2_projections.passes_for(bits)
        assert (1 - alike) ** need <= op2_projections.MISSED < (1 - alike) ** (need - 1)
    small, large = op2_projections.bits_for(100_000), op2_projections.bits_for(10_000_000)
    assert op2_projections.bits_for(500) == 0 < small < large


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.95, 0.1]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted(((x["vec_id"] or 0, x["n_links"], x["component_id"], x["kept"]) for x in op2_projections.near_vectors(df).collect()), key=lambda x: x[0])
    assert out == [(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), *[(i, 0, i, True) for i in range(5, 12)], (12, 1, 4, False)]
    assert op2_projections.near_vectors(df.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True)
    assert op9_partenum.similar_sets(spark.read.parquet(f"{small}/documents.parquet")).where("doc_id != component_id").count() > 0
    last = op7_substrings.remove_repeats(docs)
    assert last.where("n_removed > 0").count() <= docs.count()
    assert op10_packing.token_pieces(docs).groupBy("doc_id").count().count() == docs.count()


def test_pipeline_rejects_planted_documents_and_keeps_clean_ones(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = "river stone lantern meadow orchard window harbour candle bridge valley"
    planted = [
        (10_001, "you idiot moron scum loser trash worthless pathetic stupid clown " * 3, None, "x", 1),
        (10_002, " ".join(f"{w}{i}" for i in range(9) for w in clean.split()), None, "x", 1),
        (10_003, " ".join(f"{w}{i}" for i in range(9) for w in clean.split()) + " more", None, "x", 1),
        (10_004, "12 34 !!", None, "x", 1),
    ]
    more = spark.createDataFrame(planted, docs.schema).withColumn("n_chars", F.length("text").cast("long"))
    folder = str(tmp_path / "sf")
    docs.union(more).write.parquet(f"{folder}/documents.parquet")
    os.symlink(f"{SMALL}/labels.parquet", f"{folder}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert 10_001 not in kept and 10_004 not in kept and 10_003 not in kept
    assert 10_002 in kept


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in __spark_entry__.queries()) == 1


def test_entry_has_the_pipeline():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_letters_of_all_planes_and_only_learned_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 60)]
    rows += [(1000 + i, "😀 zzz 42 qqq", None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op5_language.fit(df)
    assert np.array_equal(model.idf, op5_language.fit(df.where("lang is not null")).idf)
    texts = ["😀😀", "😀 12", "\U000103a0", "\U0001d400\U0001d401", "12 ?!", None, "", "𒀀"]
    out = op5_language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    got = [r.lang_pred for r in out.orderBy("doc_id").collect()]
    assert [g == "und" for g in got] == [not any(c.isalpha() for c in t or "") for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_packing_ends_where_no_exchange_is_left(seed):
    """Brute force over every move, one-for-one and two-for-one exchange of the emptier bin; bins of many short items too."""
    rng = np.random.default_rng(seed)
    capacity = 60
    lengths = rng.integers(1, [50, 30, 12, 4, 25, 40][seed], 70)
    bins = op10_packing.local_search(lengths, op10_packing.best_fit(lengths, capacity), capacity)
    fill = np.bincount(bins, weights=lengths).astype(int)
    assert fill.max() <= capacity and fill.sum() == lengths.sum()
    if len(fill) == -(-lengths.sum() // capacity):
        return
    for a in range(len(fill)):
        mine = np.flatnonzero(bins == a)
        gives = [(i,) for i in mine] + [(i, j) for x, i in enumerate(mine) for j in mine[x + 1 :]]
        for b in range(len(fill)):
            if a == b or fill[b] < fill[a] or capacity in (fill[a], fill[b]):
                continue
            takes = [0, *lengths[bins == b]]
            assert not any(0 < lengths[list(g)].sum() - t <= capacity - fill[b] and not (t == 0 and len(g) == 2) for g in gives for t in takes)
