"""Winnowing, repeated passages, shingle join and shuffle against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rosterlab.llm import common as C
from rosterlab.llm import op1_winnowing, op7_substrings, op8_shuffle, op9_partenum

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    """Texts with exact copies, edited copies, shared passages, and empty ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    passage = [r.choice(words) for _ in range(60)]
    texts: list[str] = ["", " \n\t ", "one", "One two", "one two three four five"]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.25 and len(texts) > 8:
            copy = r.choice(texts).split(" ")
            for _ in range(r.randint(0, max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
            continue
        body = [r.choice(words) for _ in range(r.choice([1, 3, 6, 12, 30, 80, 200]))]
        if kind > 0.8:
            at, a = r.randrange(len(body)), r.randrange(30)
            body[at:at] = passage[a : a + r.randint(15, 45)]
        texts.append(r.choice(" \n\t").join(body))
    return texts


def test_winnow_picks_rightmost_minima():
    r = random.Random(2)
    gram, window = 4, 5
    for _ in range(60):
        texts = ["".join(r.choice("ab🙂é") for _ in range(r.choice([0, 1, 3, 5, 8, 13, 40, 90]))) for _ in range(5)]
        doc, hashes, where = op1_winnowing.winnow(texts, gram, window)
        for i, t in enumerate(texts):
            mine = {(int(h), int(p)) for d, h, p in zip(doc, hashes, where, strict=True) if d == i}
            n = len(t) - gram + 1
            if n <= 0:
                assert len(mine) == bool(t)
                continue
            each = [int(op1_winnowing.winnow([t[j : j + gram]], gram, window)[1][0]) for j in range(n)]
            want = set()
            for a in range(max(1, n - window + 1)):
                span = range(a, min(n, a + window))
                low = min(each[x] for x in span)
                want.add((low, max(x for x in span if each[x] == low)))
            assert mine == want


def test_edited_fingerprints(make):
    texts = [*prose(1, 80), None, "é🙂" * 500]
    rows = {r["doc_id"]: r for r in op1_winnowing.edited_fingerprints(make([(3 * i, t) for i, t in enumerate(texts)])).collect()}
    assert len(rows) == len(texts)
    order = sorted(rows, reverse=True)
    text = {3 * i: t or "" for i, t in enumerate(texts)}
    for i, k in enumerate(order):
        t, after = text[k], text[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert rows[k]["n_chars"] == len(t)
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [set(op1_winnowing.winnow([x])[1].tolist()) for x in (t, edited, after)]
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            assert rows[k][name] == (len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
    by = defaultdict(set)
    for k, r in rows.items():
        by[text[k]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())


def test_fingerprints_of_single_empty_and_repeated_rows(make):
    assert op1_winnowing.edited_fingerprints(make([(1, "only text")])).first()["near_next"] == 1.0
    assert op1_winnowing.edited_fingerprints(make([(1, "a")]).limit(0)).count() == 0
    assert op1_winnowing.edited_fingerprints(make([(1, "a"), (1, "a"), (None, None)])).count() == 3
    prints = op1_winnowing.fingerprints(make([(1, "a" * 40, "x"), (2, None, "y")], ", prints string")).collect()
    assert {r["doc_id"]: len(r["prints"]) for r in prints} == {1: 10, 2: 0}


def brute_passages(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        words = WORD.findall((t or "").encode())
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if seen.setdefault(tuple(words[s : s + length]), (i, s)) < (i, s):
                gone[s : s + length] = [True] * length
        out[i] = len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
    return out


def test_repeated_passages(make):
    for seed, length, anchor in ((1, 20, 6), (2, 6, 3), (3, 20, 20)):
        rows = list(enumerate([*prose(seed, 150, 60), None, "same " * 300, "same " * 300]))
        out = op7_substrings.remove_repeats(make(rows), length=length, anchor=anchor).collect()
        want = brute_passages(rows, length)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"] or "") for r in out} == want


def test_passages_across_batches(make, spark):
    """The reader of sorted anchors sees small batches: what it remembers between them must suffice."""
    rows = list(enumerate(prose(5, 120, 30)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in op7_substrings.remove_repeats(make(rows), length=8, anchor=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == brute_passages(rows, 8)


def test_passages_of_repeated_rows_and_empty_tables(make):
    long = " ".join(map(str, range(30)))
    rows = op7_substrings.remove_repeats(make([(4, long, "a"), (4, long, "b"), (None, long, "c"), (9, None, "d")], ", n_words string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (4, 30), (4, 30), (9, 0)]
    assert op7_substrings.remove_repeats(make([(1, "a")]).limit(0)).count() == 0


def brute_sets(rows):
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").encode().lower() if t and t.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())
        sets[i] = {tuple(words[a : a + 5]) for a in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: (len(s), group[i]) for i, s in sets.items()}


def test_similar_sets(make, monkeypatch):
    for seed, n in ((1, 260), (4, 260)):
        rows = [(5 * i, t) for i, t in enumerate([*prose(seed, n), None])]
        out = op9_partenum.similar_sets(make(rows)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_sets(rows)


def test_large_groups_are_joined_in_blocks(make, monkeypatch):
    """A chain of edits: neighbours are similar, ends are not; small blocks and runs force every stage."""
    monkeypatch.setattr(op9_partenum, "BLOCK", 6)
    monkeypatch.setattr(op9_partenum, "SMALL_RUN", 3)
    r = random.Random(3)
    words = [str(x) for x in range(90)]
    rows, chain = [], list(words)
    for i in range(60):
        rows.append((i, " ".join(chain)))
        chain[r.randrange(90)] = f"w{i}"
    r.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    out = op9_partenum.similar_sets(make(rows)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute_sets(rows)


def test_runs_are_looked_up_only_where_a_dropped_pair_parts_clusters(spark, make, monkeypatch):
    monkeypatch.setattr(op9_partenum, "SMALL_RUN", 3)
    called = []
    across = op9_partenum.across
    monkeypatch.setattr(op9_partenum, "across", lambda *a: called.append(1) or across(*a))
    words = [f"w{x}" for x in range(120)]
    rows = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(30)]
    out = op9_partenum.similar_sets(make(rows)).collect()
    assert {r["component_id"] for r in out} == {0} and not called

    members = spark.createDataFrame([(g, n) for g, ns in ((1, (1, 2, 3, 4)), (2, (5, 6, 7, 8)), (3, (3, 9))) for n in ns] * 2, "group long, node long")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5), (8, 5)], "node long, component long")
    dropped = spark.createDataFrame([(2, 3), (5, 7), (3, 9)], "a long, b long")
    ends = op9_partenum._parted(dropped, clusters)
    assert sorted(r["node"] for r in ends.collect()) == [2, 3, 9]
    mixed = sorted(tuple(r) for r in op9_partenum._mixed_runs(members, ends, clusters).select("group", "node", "component").collect())
    assert mixed == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (3, 3, 3), (3, 9, 9)]


def test_signatures_meet_for_all_similar_sets():
    """For random pairs at the edge of similarity, some signature is shared, at every size."""
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.choice([3, 5, 8, 12, 20, 33, 70, 150, 400, 900]))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        d = int(r.integers(0, n // 4 + 1))
        b = np.concatenate([a[d:], r.integers(0, 2**63, int(r.integers(0, d + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        values, size = np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)])
        offsets = np.array([0, len(a), len(a) + len(b)])
        band = np.searchsorted(op9_partenum.BANDS, size, "right") - 1
        if sorted(a.tolist()) == sorted(b.tolist()):
            continue
        shared = False
        for low in {int(x) for x in (*band, *(band - 1)) if x >= 0}:
            chosen = np.flatnonzero((band == low) | (band == low + 1))
            sig, who = op9_partenum._signatures(values, size, offsets, chosen, low)
            shared |= bool(set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()))
        assert shared, (len(a), len(b), both)


def test_signatures_take_as_many_bytes_in_any_number_of_buckets():
    texts = pa.array([" ".join(str(i * j % 97) for j in range(60)) for i in range(40)])
    sent = []
    for buckets in (1, 16, 4096):
        rows = [r for b in op9_partenum._signature_rows(5, "text", buckets)(pa.RecordBatch.from_arrays([texts], ["text"])) for r in b.to_pylist()]
        assert all(3 * len(r["sigs"]) == len(r["sigs"]) + len(r["nodes"]) for r in rows)
        sent.append(sum(len(r["sigs"]) + len(r["nodes"]) for r in rows))
    assert sent[0] == sent[1] == sent[2]


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (70, 60), (9, 9)], "a long, b long").repartition(5)
    want = {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50}
    tasks = spark.sparkContext.statusTracker()
    for few in (0, 1000):
        monkeypatch.setattr(C, "FEW_EDGES", few)
        spark.sparkContext.setJobGroup(f"edges-{few}", "")
        assert {r["node"]: r["component"] for r in C.components(edges).collect()} == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tasks.getJobIdsForGroup("edges-1000")) < len(tasks.getJobIdsForGroup("edges-0"))


def test_similar_sets_of_nothing(make):
    assert op9_partenum.similar_sets(make([(1, "a")]).limit(0)).count() == 0
    out = op9_partenum.similar_sets(make([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)])).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"]) for x in out) == [(0, 7), (7, 7), (7, 7), (9, 9)]


def test_one_row_of_each_group_is_kept(make, spark):
    a, b, c = ("a b c d e f g h i j k l m n o p q r s t u v w x y z", "one two three four five six seven", "red green blue white black brown")
    near = a + " more"
    rows = [(5, a), (5, a), (7, near), (7, b), (3, b), (None, a), (None, c), (None, c), (9, None), (9, None), (2, "z y x w v u")]
    out = op9_partenum.kept_documents(spark, make(rows + rows))
    assert out.columns == make(rows).columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    # a null text links to nothing
    assert got == {(5, a): 1, (3, b): 1, (None, c): 1, (2, "z y x w v u"): 1, (9, None): 4}
    two = op9_partenum.kept_documents(spark, make([(1, a), (1, near), (None, near)])).collect()
    assert len(two) == 1 and two[0]["doc_id"] == 1


def test_shuffle_deals_all_rows_evenly(make, spark):
    rows = [(i, f"text {i}" if i % 7 else None, i) for i in range(500)]
    docs = make(rows, ", shard int")
    out = op8_shuffle.external_shuffle(docs, shards=7, bucket_bytes=700).collect()
    again = op8_shuffle.external_shuffle(docs, shards=7, bucket_bytes=700).collect()
    count = Counter(r["shard"] for r in out)
    assert len({r["doc_id"] for r in out}) == 500
    assert max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    order = [r["doc_id"] for r in sorted(out, key=lambda r: (r["slot"], r["shard"]))]
    assert abs(float(np.corrcoef(order, range(500))[0, 1])) < 0.2
    assert op8_shuffle.external_shuffle(docs.limit(0)).count() == 0
    same = op8_shuffle.external_shuffle(make([(1, "a")] * 50), shards=4)
    assert sorted(Counter(r["shard"] for r in same.collect()).values()) == [12, 12, 13, 13]


def test_shuffle_does_not_depend_on_the_shuffle_partitions(make, spark):
    docs = op8_shuffle.C.staged(make([(i, f"text {i}") for i in range(3000)]))
    had, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("8", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append({(r["doc_id"], r["shard"], r["slot"]) for r in op8_shuffle.external_shuffle(docs, shards=7, bucket_bytes=4000).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert seen[0] == seen[1]
    other = op8_shuffle.external_shuffle(docs, shards=7, bucket_bytes=4000, seed=4).collect()
    assert len(seen[0] & {(r["doc_id"], r["shard"], r["slot"]) for r in other}) < 100


def test_shuffle_spreads_rows_that_are_alike(make):
    docs = make([(1, "same")] * 2000 + [(None, None)] * 2000)
    for options in ({"bucket_bytes": 4000}, {"bucket_rows": 400}):
        sizes = [r["count"] for r in op8_shuffle.scattered(docs, **options)[0].groupBy("_bucket").count().collect()]
        assert sum(sizes) == 4000 and len(sizes) >= 10 and max(sizes) < 600
    out = op8_shuffle.external_shuffle(docs, shards=3, bucket_bytes=4000).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 2000, None: 2000}
    assert sorted(r["slot"] * 3 + r["shard"] for r in out) == list(range(4000))


def test_shards_are_written(make, spark, tmp_path):
    op8_shuffle.write_shards(make([(i, "x" * i) for i in range(40)]), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40
    assert back.select("shard").distinct().count() == 3


def plain_repeats(rows, length):
    """(n_words, kept words) of each row, rows in the order of key (null first) and row; removal judged on the input."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = set()
        for at in range(len(words) - length + 1):
            window = tuple(words[at : at + length])
            if window in seen:
                gone |= set(range(at, at + length))
            seen.add(window)
        out[i] = (len(words), [w for at, w in enumerate(words) if at not in gone])
    return out


@pytest.mark.parametrize("hot", [1, 40, 4096])
def test_repeats_are_found_by_row_also_under_one_or_no_key(spark, hot):
    rng = random.Random(hot)
    phrase = [f"p{i}" for i in range(8)]
    rows = []
    for i in range(120):
        words = rng.choices([f"w{k}" for k in range(40)], k=rng.randint(0, 40))
        if i % 3 == 0:  # a phrase in a third of the rows, with different surroundings
            at = rng.randint(0, len(words))
            words[at:at] = phrase
        rows.append((rng.choice([None, 1, 2, 3, i]), " ".join(words) if i % 17 else None))
    w25 = " ".join(f"a{i}" for i in range(25))
    rows += [(1001, w25), (1005, w25), (1005, "short text"), (1005, " ".join(f"u{i}" for i in range(40))), (None, w25), rows[3], rows[3], (2000, "x " * 300)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")  # partitions keep the rows' order
    got = {r.row: (r.n_words, r.text) for r in op7_substrings.remove_repeats(df, length=7, anchor=3, hot=hot).collect()}
    for i, (n, kept) in plain_repeats(rows, 7).items():
        assert got[i] == (n, None if rows[i][1] is None else " ".join(kept)), i
