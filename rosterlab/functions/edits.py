"""Edit-distance scores of many pairs of texts at once, for workers: `names.text_similarity` in vectors."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Pairs of one step of vectors, so that they stay in a core's cache.
PAIRS = 1 << 16
#: What rounding to six digits can move a score by, and more.
SLACK = 2e-6


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the texts' lengths."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.array([len(t) for t in texts], np.int64)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To six digits, halves up, as SQL rounds."""
    values, at = np.unique(scores, return_inverse=True)
    exact = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values.tolist()]
    return np.array(exact, float)[at]


class Offered:
    """Texts to be compared with, longest first, as columns of character numbers: column j has the texts longer than j.

    A missing text has the score 1 with all, as in SQL, where the least of null and 1 is 1.
    """

    def __init__(self, texts: list[str | None]):
        self.order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i] or "")), np.int64)
        self.texts = [texts[i] or "" for i in self.order]
        self.missing = np.array([texts[i] is None for i in self.order], bool)
        flat, self.sizes = _codes(self.texts)
        self.letters, codes = np.unique(flat, return_inverse=True)
        starts = np.cumsum(self.sizes) - self.sizes
        longer = np.searchsorted(-self.sizes, -np.arange(self.sizes.max(initial=0)), "left")
        self.columns = [codes[starts[:k] + j].astype(np.int32) for j, k in enumerate(longer)]

    def distances(self, asked: list[str]) -> np.ndarray:
        """(texts, asked): Levenshtein distances, by Myers' vectors of row differences in blocks of Hyyro's form."""
        flat, sizes = _codes(asked)
        longest = int(sizes.max(initial=0))
        kind, bits = next(((k, b) for k, b in ((np.uint16, 16), (np.uint32, 32)) if longest <= b), (np.uint64, 64))
        blocks = max(1, -(-longest // bits))
        place = np.searchsorted(self.letters, flat)
        found = np.zeros(len(flat), bool)
        inside = place < len(self.letters)
        found[inside] = self.letters[place[inside]] == flat[inside]
        who = np.repeat(np.arange(len(asked)), sizes)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        equal = np.zeros((blocks, max(1, len(self.letters)), len(asked)), kind)
        bit = kind(1) << (row % bits).astype(kind)
        np.bitwise_or.at(equal, ((row // bits)[found], place[found], who[found]), bit[found])
        shape = (len(self.texts), len(asked))
        up, down = [np.full(shape, ~kind(0), kind) for _ in range(blocks)], [np.zeros(shape, kind) for _ in range(blocks)]
        one, top = kind(1), kind(bits - 1)
        spare = [np.empty(shape, kind) for _ in range(4)]
        for column in self.columns:
            k = len(column)
            at = column.astype(np.intp)
            xv, xh, ph, mh = (s[:k] for s in spare)
            plus, minus = None, None
            for b in range(blocks):
                pv, mv = up[b][:k], down[b][:k]
                eq = equal[b].take(at, axis=0, mode="clip")
                np.bitwise_or(eq, mv, out=xv)
                if minus is not None:
                    eq |= minus
                np.bitwise_and(eq, pv, out=xh)
                xh += pv
                xh ^= pv
                xh |= eq
                np.bitwise_or(xh, pv, out=ph)
                np.invert(ph, out=ph)
                ph |= mv
                np.bitwise_and(pv, xh, out=mh)
                carried = (ph >> top, mh >> top) if b + 1 < blocks else None
                ph <<= one
                ph |= one if plus is None else plus
                mh <<= one
                if minus is not None:
                    mh |= minus
                np.bitwise_or(xv, ph, out=pv)
                np.invert(pv, out=pv)
                pv |= mh
                np.bitwise_and(ph, xv, out=mv)
                if carried:
                    plus, minus = carried
        out = np.repeat(self.sizes.astype(np.int32)[:, None], len(asked), 1)
        for b in range(blocks):
            held = np.clip(sizes - b * bits, 0, bits)
            mask = np.array([(1 << int(h)) - 1 for h in held], kind)
            out += np.bitwise_count(up[b] & mask)
            out -= np.bitwise_count(down[b] & mask)
        return out

    def best(self, asked: list[str], rank: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked text, number of the offered text) of each asked text's n best above the threshold.

        Best is the higher score, then the smaller `rank`, a number of each offered text.
        """
        order = sorted(range(len(asked)), key=lambda i: len(asked[i]))
        step = min(1024, max(1, PAIRS // max(1, len(self.texts))))
        rank = rank[self.order]
        some = []
        for at in range(0, len(order) if self.texts else 0, step):
            part = order[at : at + step]
            who, what = self._best([asked[i] for i in part], rank, n, threshold)
            some.append((np.array(part, np.int64)[who], self.order[what]))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *[s[i] for s in some]]) for i in (0, 1))

    def _best(self, asked: list[str], rank: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        apart = self.distances(asked)
        sizes = np.array([len(a) for a in asked], np.int32)
        own = self.sizes.astype(np.int32)[:, None]
        longest = np.maximum(np.maximum(own, sizes), 1)
        scores = 1.0 - apart / longest
        # only a text whose distance is the difference of lengths can contain the other
        near = (apart == longest - np.minimum(own, sizes)) & (own != sizes) & (scores + 0.2 > threshold - SLACK)
        for i, j in zip(*np.nonzero(near), strict=True):
            if self.texts[i] in asked[j] or asked[j] in self.texts[i]:
                scores[i, j] = min(scores[i, j] + 0.2, 1.0)
        scores[self.missing] = 1.0
        scores = np.ascontiguousarray(scores.T)
        cut = np.full(len(asked), threshold)
        if scores.shape[1] > n:
            cut = np.maximum(cut, np.partition(scores, -n, axis=1)[:, -n])
        who, what = np.nonzero(scores >= cut[:, None] - SLACK)
        exact = _rounded(scores[who, what])
        kept = exact > threshold
        who, what, exact = who[kept], what[kept], exact[kept]
        order = np.lexsort((rank[what], -exact, who))
        who, what = who[order], what[order]
        first = np.searchsorted(who, np.arange(len(asked)), "left")
        kept = np.arange(len(who)) - first[who] < n
        return who[kept], what[kept]
