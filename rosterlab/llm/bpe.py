"""Byte-level BPE on padded matrices of many words at once, and the memory of words that a worker has met.

Words are bucketed by length and laid out as rows of one matrix.  In every round each row merges its leftmost pair of
minimum rank; a merge removes exactly one cell of its row, so the matrix loses one column and is compacted by a mask.  Rows
without a mergeable pair leave the matrix.  Pairs are found in an open-addressing hash table held in two numpy arrays.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterable

import numpy as np

NONE = np.int32(2**31 - 1)
LONG = 192


class Merges:
    """Merge table: pair of token ids -> rank and merged id.

    pairs: (left id, right id, rank, merged id); the rank orders merges, lower first.
    """

    def __init__(self, pairs: np.ndarray):
        pairs = np.asarray(pairs, np.int64).reshape(-1, 4)
        self.size = 1 << max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift = np.uint64(64 - int(np.log2(self.size)))
        self.key = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, NONE, np.int32)
        self.to = np.zeros(self.size, np.int32)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        slot, left, self.probes = self._slot(key), np.arange(len(pairs)), 0
        while len(left):
            self.probes += 1
            free = left[self.key[slot[left]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.key[slot[won]], self.rank[slot[won]], self.to[slot[won]] = key[won], pairs[won, 2], pairs[won, 3]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) % self.size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        out = np.where(self.key[slot] == key, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.key[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % self.size
            hit = self.key[slot[open_]] == key[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (self.key[slot[open_]] != -1)]
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self.find(a, b)
        return np.where((slot >= 0) & (a >= 0) & (b >= 0), self.rank[slot], NONE)

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words: first ids one word after another, and the words' lengths; the same form comes back."""
        base = np.cumsum(lengths) - lengths
        sizes = np.array(lengths, np.int64)
        out = np.array(flat, np.int32)  # merged ids stand at the beginning of their word's place
        buckets = np.where(lengths > LONG, 0, -(-lengths // 4) * 4)
        for i in np.flatnonzero(lengths > LONG):
            ids = self._merge_long(flat[base[i] : base[i] + lengths[i]])
            out[base[i] : base[i] + len(ids)], sizes[i] = ids, len(ids)
        for width in np.unique(buckets[(buckets > 0) & (lengths > 1)]):
            members = np.flatnonzero((buckets == width) & (lengths > 1))
            step = max(1, (1 << 19) // int(width))
            for at in range(0, len(members), step):
                self._merge_bucket(flat, base, lengths, members[at : at + step], int(width), out, sizes)
        at = np.cumsum(sizes) - sizes
        return out[np.repeat(base - at, sizes) + np.arange(sizes.sum())], sizes

    def _merge_bucket(self, flat: np.ndarray, base: np.ndarray, lengths: np.ndarray, rows: np.ndarray, width: int, out: np.ndarray, sizes: np.ndarray) -> None:
        here = np.arange(width) < lengths[rows][:, None]
        cells = np.full((len(rows), width), -1, np.int32)
        cells[here] = flat[(base[rows][:, None] + np.arange(width))[here]]
        ranks = self.ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            n, width = cells.shape
            each = np.arange(n)
            if width > 1:
                best = ranks.argmin(1)  # the first of equal ranks: leftmost
                live = ranks[each, best] < NONE
            else:
                best, live = np.zeros(n, np.int64), np.zeros(n, bool)
            if not live.all():
                done, left = rows[~live], cells[~live]
                here = left >= 0
                sizes[done] = here.sum(1)
                out[(base[done][:, None] + np.arange(width))[here]] = left[here]
                rows, cells, ranks, best = rows[live], cells[live], ranks[live], best[live]
                n = len(rows)
                each = each[:n]
                if not n:
                    break
            at = each * width + best
            line = cells.ravel()
            line[at] = self.to[self.find(line[at], line[at + 1])]
            keep = np.ones(n * width, bool)
            keep[at + 1] = False
            cells = line[keep].reshape(n, width - 1)
            keep = np.ones(n * (width - 1), bool)
            keep[each * (width - 1) + best] = False
            ranks = ranks.ravel()[keep].reshape(n, width - 2)
            # the merged cell has a new pair on either side
            right, left = best < width - 2, best > 0
            at = each * (width - 1) + best
            line, pairs = cells.ravel(), ranks.ravel()
            x = np.concatenate([at[right], at[left] - 1])
            pairs[np.concatenate([(each * (width - 2) + best)[right], (each * (width - 2) + best)[left] - 1])] = self.ranks(line[x], line[x + 1])

    def _merge_long(self, word: np.ndarray) -> np.ndarray:
        """The same order of merges for one very long word, with a heap instead of a matrix row."""
        ids = [int(x) for x in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        slots = self.find(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(self.rank[s]), i, ids[i], ids[i + 1]) for i, s in enumerate(slots) if s >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.to[self.find(np.array([a]), np.array([b]))[0]])
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    s = int(self.find(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if s >= 0:
                        heapq.heappush(heap, (int(self.rank[s]), x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.int32)


class RankFile:
    """A vocabulary of ranked byte strings: any two neighbours whose bytes together are in it may merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = np.full(256, -1, np.int32)
        pairs = []
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.first[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank, rank))
        self.merges = Merges(np.array(pairs))
        ids = np.fromiter(self.ranks.values(), np.int64)
        lengths = np.zeros(ids.max() + 2, np.int64)
        lengths[ids + 1] = [len(t) for t in self.ranks]
        self.offsets = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids; a word in the vocabulary is one token."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        rest = [w for w, r in zip(words, whole, strict=True) if r < 0]
        ids, sizes = self.merges.merge(self.first[np.frombuffer(b"".join(rest), np.uint8)], np.array([len(w) for w in rest], np.int64))
        all_sizes = np.ones(len(words), np.int64)
        all_sizes[whole < 0] = sizes
        out = np.empty(all_sizes.sum(), np.int32)
        known = np.repeat(whole >= 0, all_sizes)
        out[known], out[~known] = whole[whole >= 0], ids
        return out, all_sizes

    def decode(self, ids: np.ndarray) -> bytes:
        at, to = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        size = to - at
        if not len(ids):
            return b""
        where = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.bytes[where].tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabulary files: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class JsonBpe:
    """The merges of a tokenizer file: first ids of a word's bytes (the last with the file's word ending), then merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)], np.int32)
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append((vocabulary[a], vocabulary[b], rank, vocabulary[a + b]))
        self.merges = Merges(np.array(pairs))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first[data]
        last = np.cumsum(lengths)[lengths > 0] - 1
        ids[last] = self.last[data[last]]
        return self.merges.merge(ids, lengths)


def cut_bytes(ids: np.ndarray, sizes: np.ndarray, counts: list[int]) -> list[bytes]:
    """The ids of each piece as little-endian 32-bit integers, a piece being the next `count` words."""
    data = ids.astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])] * 4
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Memory(dict):
    """Results of pieces already met by this worker, in two generations so that its size stays bounded."""

    def __init__(self, compute: Callable[[list[str]], Iterable], size: int = 400_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Makes every piece present."""
        new = []
        for p in pieces:
            if p not in self:
                known = self.old.get(p)
                if known is None:
                    new.append(p)
                else:
                    self[p] = known
        if len(self) > self.size:
            keep = {p: self[p] for p in pieces if p in self}
            self.old = dict(self)
            self.clear()
            self.update(keep)
        if new:
            self.update(zip(new, self.compute(new), strict=True))


def pieces_of(text: str) -> list[str]:
    """The text cut before every single space that follows a non-space: no token of a byte-level pattern spans such a cut.

    A run of white space stays with the word after it, so every piece splits and merges as it does inside the text.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    out = [parts[0]]
    glued = not parts[0] or parts[0][-1].isspace()
    for p in parts[1:]:
        if glued:
            out[-1] += " " + p
        else:
            out.append(" " + p)
        glued = not p or p[-1].isspace()
    return out
