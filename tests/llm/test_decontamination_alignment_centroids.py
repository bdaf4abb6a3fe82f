"""op11 to op13 against brute force on small tables, with nulls, repeated rows, long texts, ties and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rosterlab.llm import op11_decontaminate as D
from rosterlab.llm import op12_alignment as A
from rosterlab.llm import op13_centroids as K

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, items string, spans int"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items, window):
    phrases = {}
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if w else 0):
            phrases.setdefault(tuple(w[at : at + n]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for p, ids in phrases.items():
            for at in range(len(w) - len(p) + 1):
                if tuple(w[at : at + len(p)]) == p:
                    hit |= set(range(at, at + len(p)))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=str)


def test_suffix_order_of_repetitive_texts():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        parts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)) for _ in range(rng.integers(1, 6))]
        text = np.concatenate([np.concatenate([p + len(parts), [i]]) for i, p in enumerate(parts)])
        assert D.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def corpus():
    rng = random.Random(3)
    vocabulary = ["de", "la", "Año", "x1", "y", "ÉTÉ", "z9z", "b", "c", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(20)]
    items += [(5, items[1][1]), (None, "only a nameless item"), (30, None), (31, "...")]
    docs = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(7, docs[7][1]), (7, "de LA año"), (None, items[3][1]), (None, None), (99, ""), (100, "Only, a NAMELESS-item!"), (101, "de la " * 3000), (102, "ab" * 50000)]
    return docs, items


@pytest.mark.parametrize("shard_bytes,block", [(1 << 20, 1 << 16), (300, 7)])
def test_contamination_equals_brute_force(spark, shard_bytes, block):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    got = D.contamination(df, benchmark, window=4, shard_bytes=shard_bytes, block=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == contaminated(docs, items, 4)
    for r in got:
        spans = [(s.start, s.end) for s in r.spans or []]
        assert sum(b - a for a, b in spans) == r.n_hit and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_contamination_of_empty_tables(spark):
    docs, items = corpus()
    some, none = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs[:3]], DOCS), spark.createDataFrame([], DOCS)
    assert [r.n_hit for r in D.contamination(some, spark.createDataFrame([], ITEMS)).collect()] == [0, 0, 0]
    assert D.contamination(none, spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)).collect() == []


# --- op12 ------------------------------------------------------------------------------------------------------------


def aligned(texts):
    a = Tokenizer.from_file(public_tokenizers.path(A.VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.VOCABULARY_B))
    pair = A.tokenizer_pair(public_tokenizers.path(A.VOCABULARY_A), public_tokenizers.path(A.VOCABULARY_B))
    rows, count = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        sides = [(a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (b.encode(text), pair.bytes_b)] if text else []
        if not text or any(b"".join(table[i] for i in ids) != raw for ids, table in sides):
            rows.append(None)
            continue
        spans = []
        for ids, table in sides:
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [[",".join(str(t[2]) for t in side if low < t[1] <= high) for side in spans] for low, high in zip([0, *cuts[:-1]], cuts, strict=True)]
        count.update(links)
        rows.append((len(spans[0]), len(spans[1]), len(cuts), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in rows]


TEXTS = [
    "The quick brown fox", "The quick brown fox", "  leading  and   many    spaces ", " ", "   ", "tab\tand\nline\n\n next", "it's don't <|endoftext|> <s> <0x41> x", "Ａﬁ ½ 日本語 🙂🙂 é é", "lost ▁ piece",
    "a b  c\x1cd", "", None, "x", "supercalifragilistic" * 40, "ñ" * 700, "1234567890 12 3.14", "end \n", "\x00 nul", "The The The the THE",
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_alignment_equals_brute_force(spark, block_bytes):
    df = spark.createDataFrame([(i % 17, t, 1, "b") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, block string").repartition(3)
    got = A.alignment(df, block_bytes=block_bytes)[0].collect()
    want = [(i % 17, *r) for i, r in enumerate(aligned(TEXTS))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_alignment_of_random_texts(spark):
    rng = random.Random(5)
    letters = "abc é\n\t ▁'日1.🙂 "
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in A.alignment(df, block_bytes=2000)[0].collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)


def test_alignment_forgets_pieces_and_keeps_results(spark, monkeypatch):
    pair = A.tokenizer_pair(public_tokenizers.path(A.VOCABULARY_A), public_tokenizers.path(A.VOCABULARY_B))
    memory = A.Memory(pair)
    first = memory.slots([" one", " two", " " + "long" * 40]).tolist()
    assert memory.slots([" two", " one"]).tolist() == [first[1], first[0]] and " " + "long" * 40 not in memory.slot
    memory.forget()
    assert memory.slots([" two"]).tolist() == [0] and len(memory.texts) == 1


def test_alignment_of_no_rows(spark):
    assert A.alignment(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []
    assert [tuple(r) for r in A.alignment(spark.createDataFrame([(None, None)], "doc_id long, text string"))[0].collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


# --- op13 ------------------------------------------------------------------------------------------------------------


def clustered(rows, k, rounds, scale, width, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in drawn]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("lead", [1, 3, 8])
def test_clusters_equal_brute_force(spark, lead):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2) + (3 if i % 3 else -2)]) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[7][1]), (400, None), (401, [1.0] * 7), (402, [None] * 8), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [0.0] * 8), (406, [0.0] * 8), (407, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(4)
    want, centroids = clustered(rows, 12, 3, 4, 8, 9)
    out, found = K.cluster(df, k=12, rounds=3, scale=4, width=8, seed=9, lead=lead)
    assert found.tolist() == centroids
    full = K.with_inertia(out, found).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in full), key=str) == want
    total = Counter()
    for _, c, d in want:
        total[c] += d
    assert all(r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) for r in full)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in full)


def test_equal_distances_go_to_the_smaller_number_and_few_vectors_make_few_centroids(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out, centroids = K.cluster(df, k=40, rounds=0, scale=1, width=2, lead=1)
    want, _ = clustered(rows, 40, 0, 1, 2, K.SEED)
    assert sorted(tuple(r) for r in out.collect()) == want and len(centroids) == 4


def test_no_vectors_give_no_clusters(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    out, centroids = K.cluster(df)
    assert K.with_inertia(out, centroids).collect() == [] and len(centroids) == 0


def test_the_filter_leaves_out_centroids(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (500, 16)) * np.array([20] * 3 + [1] * 13)
    _, axes = np.linalg.eigh(np.cov(v.T))
    axes = axes[:, ::-1]
    near = K.Nearest(v[:40], axes, 4)
    best, distance = near(v, *K.rotated(v.astype(float), axes, 4))
    every = ((v[:, None] - v[:40]) ** 2).sum(2)
    assert best.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
    assert near.verified < 500 * 39 / 4
