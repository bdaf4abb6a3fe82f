"""Packing of documents into sequences of fixed token length by best fit and swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlab.llm import common as C
from rosterlab.llm.bpe import JsonBpe, Memory, cut_bytes

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 1
#: Pieces that one task packs together.
BUCKET = 16_384
#: The splitting pattern of the vocabulary file (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under a lower-casing vocabulary that drops white space; kept by a worker between tasks.

    No token spans a space or a line feed, so a text's ids are those of its parts, one after another.  Parts of Latin-1
    letters are lower-cased, split and merged by the file's own rules in batches; parts with any other character, and texts
    that hold a special token's string, go through the tokenizers library.
    """

    def __init__(self, path: str):
        self.library, self.bpe, self.pattern = Tokenizer.from_file(path), JsonBpe(path), regex.compile(PATTERN)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.memory = Memory(self._ids_of)

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        words: list[bytes] = []
        counts: list[int] = []
        odd: dict[int, bytes] = {}
        for i, p in enumerate(parts):
            try:
                p.encode("latin-1")
            except UnicodeEncodeError:
                odd[i] = self._library_ids(p)
                counts.append(0)
                continue
            p = p.lower()
            found = [p] if p.isalpha() else self.pattern.findall(p)
            words += [w.encode() for w in found]
            counts.append(len(found))
        out = cut_bytes(*self.bpe.encode(words), counts)
        for i, ids in odd.items():
            out[i] = ids
        return out

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _parts(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [any(s in t for s in self.special) for t in texts]
        cut = [[] if o else self._parts(t) for t, o in zip(texts, odd, strict=True)]
        self.memory.learn(set().union(*cut) if cut else set())
        return [self._library_ids(t) if o else b"".join(map(self.memory.__getitem__, c)) for t, c, o in zip(texts, cut, odd, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and the ids): every text's ids followed by `end`, cut at `capacity`.

    Null and empty texts are the one id `end`.  Repeated rows give repeated pieces.  No shuffle.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    df = df.select(key, text)
    tail = np.array([end], "<u4").tobytes()

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int, bytes]] = []
        wide = 4 * capacity
        who: list[int] = []
        for i, ids in enumerate(encoder(path).encode([t or "" for t in block.column(text).to_pylist()])):
            ids += tail
            for n, at in enumerate(range(0, len(ids), wide)):
                part = ids[at : at + wide]
                who.append(i)
                rows.append((n, at // 4, len(part) // 4, zlib.crc32(part), part))
        cols = list(zip(*rows, strict=True))
        arrays = [block.column(key).take(pa.array(who, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
        names = [key, "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(cols[4], pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(C.in_arrow(step, text, after=lambda: encoder(path).memory.forget()), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every item: longest first, each into the fullest bin that takes it."""
    bins = np.zeros(len(lengths), np.int64)
    free: list[tuple[int, int]] = []  # (room left, bin), ascending
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if room > size:
            insort(free, (room - size, b))
    return bins


def _pair_sums(own: np.ndarray) -> np.ndarray:
    """All sums of two of the lengths; distinct lengths of one bin are few, because they add up to its capacity at most."""
    one, n = np.unique(own, return_counts=True)
    i, j = np.triu_indices(len(one))
    some = (i != j) | (n[i] > 1)
    return np.unique(one[i[some]] + one[j[some]])


def _two_of(own: np.ndarray, total: int) -> list[int]:
    """Places of two of the lengths with that sum, by two pointers over the sorted lengths."""
    order = np.argsort(own, kind="stable")
    x, y = 0, len(own) - 1
    while (found := own[order[x]] + own[order[y]]) != total:
        x, y = (x + 1, y) if found < total else (x, y - 1)
    return [int(order[x]), int(order[y])]


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Moves and exchanges among underfull bins that increase the sum of squared fills, until bins empty or none is left.

    The emptiest bin is worked on: an item moves where it fits best; else it is exchanged for a smaller item, or any two of
    its items for one, of a fuller bin with room for the difference, always with the largest gain.  Every step raises the sum
    of squares, so the search ends; it ends at once when all items could not do with one bin less.  A bin without a step is
    tried again after all others, as long as any of them has changed: the end is a packing that no step improves.
    """
    bins, lengths = bins.copy(), np.asarray(lengths, np.int64)
    least = -(-int(lengths.sum()) // capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    used = int((fill > 0).sum())
    stuck, changed = np.zeros(len(fill), bool), False
    # only items of underfull bins take part; a full bin never changes again
    part = np.flatnonzero(fill[bins] < capacity)
    while used > least:
        open_ = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(open_):
            if not changed:
                break
            stuck[:], changed = False, False
            continue
        a = int(open_[fill[open_].argmin()])
        here = bins[part] == a
        mine, rest = part[here], part[~here]
        own = lengths[mine]
        room = np.where((fill > 0) & (fill >= fill[a]), capacity - fill, 0)
        room[a] = 0
        # a move needs room only; an item may go to a bin that becomes fuller than this one was
        takes = np.where(fill > 0, capacity - fill, 0)
        takes[a] = 0
        step = False
        for size in np.unique(own)[::-1]:
            fits = np.flatnonzero((takes >= size) & (fill + size > fill[a]))
            if len(fits):
                b, i = int(fits[takes[fits].argmin()]), int(mine[np.flatnonzero(own == size)[0]])
                bins[i], fill[a], fill[b], step = b, fill[a] - size, fill[b] + size, True
                break
        if not step:
            theirs, space = lengths[rest], room[bins[rest]]
            for two in (False, True):  # one for one, then two for one
                sums = _pair_sums(own) if two else np.unique(own)
                at = np.searchsorted(sums, theirs + space, "right") - 1
                gain = np.where((at >= 0) & (space > 0), sums[np.maximum(at, 0)] - theirs, 0) if len(sums) else np.zeros(0, np.int64)
                if not len(gain) or gain.max() <= 0:
                    continue
                o = int(gain.argmax())
                b, total = int(bins[rest[o]]), int(sums[at[o]])
                give = mine[_two_of(own, total)] if two else mine[np.flatnonzero(own == total)[:1]]
                bins[give], bins[rest[o]] = b, a
                fill[a], fill[b], step = fill[a] - gain[o], fill[b] + gain[o], True
                break
        if not step:
            stuck[a] = True
            continue
        changed = True
        used -= fill[a] == 0
        if fill[b] == capacity or not fill[a]:
            part = part[fill[bins[part]] < capacity]
    return np.unique(bins, return_inverse=True)[1]


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Adds sequence_id and offset: pieces of at most `capacity` share sequences, one after another without gaps.

    The pieces are dealt at random into buckets of about `bucket` rows; a task packs one bucket, so sequences never cross
    buckets and each bucket wastes at most a part of a sequence.  All rows are packed, repeated ones too; a piece longer
    than `capacity` raises an error.  Extra columns stay.
    """
    pieces = C.staged(pieces.drop("sequence_id", "offset"))
    n = max(1, -(-pieces.count() // bucket))
    # the row number of a written table does not change when a task is run again
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    schema = C.widened(pieces, sequence_id="long", offset="long")
    names = pieces.columns

    def one(rows: pa.Table) -> pa.Table:
        lengths = rows.column(length).to_numpy().astype(np.int64)
        if (lengths > capacity).any():
            raise ValueError(f"a piece of {lengths.max()} is longer than a sequence of {capacity}")
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        sizes, sorted_bins = lengths[order], bins[order]
        before = np.cumsum(sizes) - sizes
        first = np.concatenate([[True], sorted_bins[1:] != sorted_bins[:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - before[np.maximum.accumulate(np.where(first, np.arange(len(bins)), 0))]
        sequence = rows.column("_bucket").to_numpy() * (1 << 32) + bins
        return pa.Table.from_arrays([*[rows.column(c) for c in names], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return dealt.groupBy("_bucket").applyInArrow(one, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(C.table(spark, sf_dir, "documents")))


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return pack(token_pieces(docs))
