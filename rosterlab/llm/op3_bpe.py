"""Byte-level BPE encoding and decoding on padded matrices (see bpe.py), for any ranked vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rosterlab.llm import common as C
from rosterlab.llm.bpe import Memory, RankFile, cut_bytes, pieces_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Text to ids and back under one vocabulary file and one splitting pattern; kept by a worker between tasks."""

    def __init__(self, path: str, pattern: str):
        self.file, self.pattern = RankFile(path), regex.compile(pattern)
        self.memory = Memory(self._ids_of)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        words: list[bytes] = []
        counts = []
        for p in pieces:
            found = [p] if p[1:].isalpha() and (p[0] == " " or p.isalpha()) else self.pattern.findall(p)
            words += [w.encode() for w in found]
            counts.append(len(found))
        return cut_bytes(*self.file.encode(words), counts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [pieces_of(t) for t in texts]
        self.memory.learn(set().union(*cut) if cut else set())
        return [b"".join(map(self.memory.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return self.file.decode(np.frombuffer(ids, "<u4"))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _texts(block: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in block.column(column).to_pylist()]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds binary `out`: the ids of the whole text, 4 bytes each, little-endian.

    Each match of the pattern is merged by itself; special tokens are not recognised.  Null and empty texts have no ids;
    repeated rows are encoded each; other columns stay, whatever their names (an existing `out` is replaced).
    Works inside the scan's partitions, without a shuffle; a worker remembers a bounded number of words.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    df = df.drop(out)

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = codec(path, pattern).encode(_texts(block, text))
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(ids, pa.binary())], [*block.schema.names, out])

    return df.mapInArrow(C.in_arrow(step, text, after=lambda: codec(path, pattern).memory.forget()), C.widened(df, **{out: "binary"}))


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", path: str | None = None) -> DataFrame:
    """Adds binary `out`: the bytes that the ids stand for.  Null ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    df = df.drop(out)

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        use = codec(path, public_tokenizers.PATTERN)
        found = [use.decode(x or b"") for x in block.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.binary())], [*block.schema.names, out])

    return df.mapInArrow(C.in_arrow(step, ids), C.widened(df, **{out: "binary"}))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, sha256 of the ids and of the bytes decoded from them: encode and decode in one pass over the texts."""
    path = path or public_tokenizers.path(VOCABULARY)
    df = df.select(key, text)

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        use = codec(path, public_tokenizers.PATTERN)
        ids = use.encode(_texts(block, text))
        yield pa.RecordBatch.from_arrays(
            [
                block.column(key),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(use.decode(x)).hexdigest() for x in ids], pa.string()),
            ],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(C.in_arrow(step, text, after=lambda: codec(path, public_tokenizers.PATTERN).memory.forget()), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.table(spark, sf_dir, "documents"))
