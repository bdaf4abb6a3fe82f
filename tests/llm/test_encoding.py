"""Byte-level BPE, token counts and packing against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rosterlab.llm import op3_bpe, op6_token_counts, op10_packing
from rosterlab.llm.bpe import LONG, pieces_of

ODD = [
    None, "", " ", "   ", "a", "a  b   c\n\n  d \n e", "x  y   z", "it's he'll WE'RE 1234 ١٢", "<|endoftext|> a<|endoftext|>b <|startoftext|>",
    "日本語 テキスト œuvre İstanbul ΣΑΣ", "é é \x1c x\x1f y", "a" * 700, "ab" * 3000, "!!! ... ??", "🙂🙂 ok", "\t\ta \r\n b", "ΌΣΟΣ word", "a ́b", "a", "a",
]
PIECES = [" ", "  ", "\n", "a", "b", "the", " ing", "1", ".", "!!", "'s", "é", "ß", "\t", "<|endoftext|>", "Z", "日", " \n", " "]


def rank_encoding():
    path = public_tokenizers.path(op3_bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_round_trip_equals_the_library(make):
    texts = ODD + mixed(3, 400)
    library = rank_encoding()
    rows = {r["doc_id"]: r for r in op3_bpe.round_trip(make(list(enumerate(texts)))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_and_decode_keep_columns_of_any_name(make, spark):
    docs = make([(1, "some words", "x"), (2, None, "y")], ", ids string")
    out = op3_bpe.decode(op3_bpe.encode(docs), out="n_chars").collect()
    assert sorted((r["doc_id"], bytes(r["n_chars"]).decode()) for r in out) == [(1, "some words"), (2, "")]
    assert op3_bpe.round_trip(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcdeé日 '1.\n\t"), max_size=300))
def test_pieces_join_to_the_text_and_long_words_merge_alike(text):
    assert "".join(pieces_of(text)) == text
    word = text.replace(" ", "").encode() or b"a"
    codec = op3_bpe.codec(public_tokenizers.path(op3_bpe.VOCABULARY), public_tokenizers.PATTERN)
    first = codec.file.first[np.frombuffer(word, np.uint8)]
    short, _ = codec.file.merges.merge(first, np.array([len(first)]))
    if len(word) <= LONG:
        assert short.tolist() == codec.file.merges._merge_long(first).tolist()
    assert codec.file.decode(short) == word


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 8), (64, 16), (200, 50), (10**9, 1)])
def test_token_counts_equal_the_library(chunk, overlap):
    counter = op6_token_counts.counter(public_tokenizers.path(op6_token_counts.VOCABULARY))
    texts = [t or "" for t in ODD] + mixed(5, 600)
    want = [len(e) for e in counter.library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts, chunk, overlap) == want


def test_token_counts_of_huge_texts(make):
    words = mixed(7, 4000)
    texts = ["\n".join(words), "x" * 40_000, " ".join(words[:2000]) + "y" * 30_000]
    library = Tokenizer.from_file(public_tokenizers.path(op6_token_counts.VOCABULARY))
    out = op6_token_counts.token_counts(make(list(enumerate(texts))).select("doc_id", "text"), chunk=3000, overlap=64).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in out} == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False))) for i, t in enumerate(texts)}


def test_packing_covers_every_piece_once(make):
    r = random.Random(1)
    texts = ODD + mixed(9, 200) + ["word " * r.randint(1, 9000) for _ in range(60)]
    library = Tokenizer.from_file(public_tokenizers.path(op10_packing.VOCABULARY))
    rows = op10_packing.pack(op10_packing.token_pieces(make(list(enumerate(texts)))), bucket=64).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        by[x["doc_id"]].append(x)
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[i], key=lambda x: x["piece"])
        assert [(x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in parts] == [
            (n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))
        ]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_local_search_empties_bins():
    r = np.random.default_rng(4)
    for _ in range(40):
        lengths = r.integers(1, 100, int(r.integers(1, 60)))
        bins = op10_packing.local_search(lengths, np.arange(len(lengths)), 100)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and fill.min() > 0
        assert (fill**2).sum() >= (lengths**2).sum()
        assert len(fill) <= 1.25 * -(-lengths.sum() // 100) + 1
    # nothing moves, but 40 for 35 fills the first bin and the rest of the second then fits the third
    lengths, start = np.array([60, 35, 40, 30, 65]), np.array([0, 0, 1, 1, 2])
    assert op10_packing.local_search(lengths, start, 100).max() + 1 == 3


def test_packing_of_nothing_repeats_and_long_pieces(make, spark):
    pieces = op10_packing.token_pieces(make([(1, "same"), (1, "same"), (None, None)]))
    assert sorted(r["length"] for r in op10_packing.pack(pieces).collect()) == [1, 2, 2]
    assert op10_packing.pack(pieces.limit(0)).count() == 0
    with pytest.raises(Exception, match="longer than a sequence"):
        op10_packing.pack(spark.createDataFrame([(1, 5000)], "doc_id long, length long")).collect()
