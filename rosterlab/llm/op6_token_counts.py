"""Exact token counts of texts of any length, with overlapping chunks for huge ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Encoding, Tokenizer

from rosterlab.llm import common as C
from rosterlab.llm.bpe import JsonBpe, Memory, pieces_of

VOCABULARY = "byte_bpe_50k.json"
#: Texts of more characters are encoded in overlapping chunks.
CHUNK, OVERLAP = 24_576, 256
_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Token counts under one tokenizer file; kept by a worker between tasks."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.special = [str(t.content) for t in added]
        self.margin = max(map(len, self.special), default=0) + 2
        self.bpe, self.pattern = JsonBpe(path), regex.compile(public_tokenizers.PATTERN)
        self.plain = regex.compile(r"[\x00-\xff]*")
        self.memory = Memory(self._counts)

    # -- short texts: pieces between cuts that no token can span

    def _counts(self, pieces: list[str]) -> list[int]:
        words: list[bytes] = []
        sizes: list[int] = []  # words, or the negative number of tokens where the library counted
        for p in pieces:
            if any(s in p for s in self.special) or not self.plain.fullmatch(p):
                sizes.append(-len(self.library.encode(p, add_special_tokens=False)))
                continue
            found = [p] if p[1:].isalpha() and (p[0] == " " or p.isalpha()) else self.pattern.findall(p)
            words += [w.encode() for w in found]
            sizes.append(len(found))
        ends = np.concatenate([[0], np.cumsum(self.bpe.encode(words)[1])])
        words_of = np.maximum(sizes, 0)
        to = np.cumsum(words_of)
        return np.where(np.array(sizes) < 0, -np.array(sizes), ends[to] - ends[to - words_of]).tolist()

    # -- huge texts: overlapping chunks, spliced where both encodings agree

    def _stable(self, e: Encoding, shift: int, length: int, last: bool) -> dict[int, int]:
        """Text position -> tokens before it, where the chunk's splitting is that of the whole text from there on.

        Splitting matches from left to right and looks at most one character ahead, so what a chunk says is right up to
        its last words; only positions where a new word begins count, and those within a special token's length of the
        chunk's end do not.
        """
        words, spans = e.word_ids, e.offsets
        reach = length if last else length - self.margin
        return {shift + spans[i][0]: i for i in range(1, len(spans)) if words[i] != words[i - 1] and spans[i][0] < reach and spans[i][0] >= spans[i - 1][1]}

    def _chunked(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of the text, encoding `chunk` characters at a time.

        Neighbours share `overlap` characters.  At the first word beginning inside the overlap that both chunks have, the
        count goes over from one to the next: to its left the earlier chunk is right, and from it on the later chunk splits
        the same characters from the same state as the whole text.  Without such a place the next chunk begins earlier, by
        a doubled overlap, and at last the two chunks are encoded as one.
        """
        n, at, total = len(text), 0, 0
        end = min(n, chunk)
        encoding = self.library.encode(text[:end], add_special_tokens=False)
        begin_tokens = 0  # of the present chunk, counted before it
        while end < n:
            mine = self._stable(encoding, at, end - at, False)
            wide = overlap
            while True:
                start = end - wide
                if start <= at or wide > 4 * chunk:  # no common boundary: one larger chunk in place of two
                    end = min(n, end + chunk)
                    encoding = self.library.encode(text[at:end], add_special_tokens=False)
                    break
                stop = min(n, start + chunk + wide)
                after = self.library.encode(text[start:stop], add_special_tokens=False)
                theirs = self._stable(after, start, stop - start, stop == n)
                # the first word of the later chunk may be cut: only boundaries that both have are used
                common = [p for p in theirs if p in mine and mine[p] >= begin_tokens]
                if common:
                    p = min(common)
                    total += mine[p] - begin_tokens
                    begin_tokens, at, end, encoding = theirs[p], start, stop, after
                    break
                wide *= 2
        return total + len(encoding) - begin_tokens

    def count(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        cut = [pieces_of(t) if len(t) <= chunk else [] for t in texts]
        self.memory.learn(set().union(*cut) if cut else set())
        return [sum(map(self.memory.__getitem__, c)) if len(t) <= chunk else self._chunked(t, chunk, overlap) for t, c in zip(texts, cut, strict=True)]


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(
    df: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens"
) -> DataFrame:
    """Replaces the text by its UTF-8 length and its exact number of tokens; other columns stay.

    As the tokenizers library counts them, without added special tokens; special strings inside a text count as the
    library's default has them.  Null and empty texts have no tokens.  No shuffle; long texts never need one encoding call
    for all their characters.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [c for c in df.columns if c not in (text, n_bytes, n_tokens)]
    df = df.select(*keep, text)
    schema = C.widened(df.select(*keep), **{n_bytes: "long", n_tokens: "long"})

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in block.column(text).to_pylist()]
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        counts = pa.array(counter(path).count(texts, chunk, overlap), pa.int64())
        yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], sizes, counts], [*keep, n_bytes, n_tokens])

    return df.mapInArrow(C.in_arrow(step, text, after=lambda: counter(path).memory.forget()), schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 512 AS over_limit")
