"""Document fingerprints by winnowing: the minimum of every window of rolling k-gram hashes, with its position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterlab.llm import common as C

#: Code points of a gram and grams of a window: every match of at least GRAM + WINDOW - 1 code points shares a print.
GRAM, WINDOW = 12, 20
_LETTERS = C.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, position) of every print, in order of text and position.

    Hashes have 32 bits.  Of equal minima in a window the rightmost is chosen.  A text with fewer grams than a window has the
    minimum of all; one shorter than a gram has the hash of the whole text at position 0; an empty one has none.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    values = _LETTERS[points & 0xFFFF] + (points >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.flatnonzero((size > 0) & (size < gram))
    picked = [(C.span_hashes(values, base[whole], base[whole + 1]) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - base[whole].astype(np.uint64))]
    at = np.arange(max(0, len(points) - gram + 1))
    if len(at):
        hashes = C.span_hashes(values, at, at + gram)
        # the hash above, the position from the right below: a plain minimum breaks ties to the right
        keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
        grams = np.maximum(size - gram + 1, 0)
        low, span = keys, 1
        while span * 2 <= window:
            low, span = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0], span * 2
        if span < window:
            rest = window - span
            low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
        inside = np.zeros(len(points) + 1, np.int64)
        full = grams >= window
        np.add.at(inside, base[:-1][full], 1)
        np.add.at(inside, (base[:-1] + grams - window + 1)[full], -1)
        chosen = low[np.cumsum(inside)[: len(low)] > 0]
        picked.append(chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen)
        few = np.flatnonzero((grams > 0) & (grams < window))
        if len(few):
            edges = np.stack([base[few], base[few] + grams[few]], 1).ravel()
            picked.append(np.minimum.reduceat(np.append(keys, np.uint64(2**64 - 1)), np.minimum(edges, len(keys)))[::2])
    keys = np.concatenate(picked)
    where = (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where, keys = where[order], keys[order]
    doc = np.searchsorted(base, where, "right") - 1
    return doc, (keys >> np.uint64(32)).astype(np.uint32), where - base[doc]


def fingerprints(df: DataFrame, text: str = "text", out: str = "prints", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds `out`: array of (hash, position) of each text's prints, in order.

    Null and empty texts have an empty array; equal texts have equal arrays; other columns stay.  No shuffle.
    """
    df = df.drop(out)
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, hashes, where = winnow([t or "" for t in block.column(text).to_pylist()], gram, window)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.num_rows))]).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(where)], fields=list(kind.value_type))
        yield pa.RecordBatch.from_arrays([*block.columns, pa.ListArray.from_arrays(pa.array(ends), rows)], [*block.schema.names, out])

    return df.mapInArrow(C.in_arrow(step, text), C.widened(df, **{out: "array<struct<hash:long,position:long>>"}))


def _keys(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.unique(doc.astype(np.uint64) << np.uint64(32) | hashes)


def _likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard similarity of the print sets of each of n texts; of two empty sets 1."""
    count = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    both = count(np.intersect1d(a, b, assume_unique=True))
    either = count(a) + count(b) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def _digests(doc: np.ndarray, hashes: np.ndarray, where: np.ndarray, n: int) -> list[str]:
    """One string for each text's prints and their positions."""
    rows = np.stack([hashes.astype("<u4"), where.astype("<u4")], 1)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    data = rows.tobytes()
    return [hashlib.md5(data[8 * a : 8 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def compare(texts: list[str], after: list[str]) -> list[pa.Array]:
    """Columns n_chars .. near_next for texts and the documents that follow them."""
    n = len(texts)
    edited = []
    for t, x in zip(texts, after, strict=True):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + x[:half])
    mine, changed, following = winnow(texts), winnow(edited), winnow(after)
    own = _keys(*mine[:2])
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(_digests(*mine, n), pa.string()),
        pa.array(_digests(*changed, n), pa.string()),
        pa.array(_likeness(own, _keys(*changed[:2]), n), pa.float64()),
        pa.array(_likeness(own, _keys(*following[:2]), n), pa.float64()),
        pa.array(np.bincount(mine[0], minlength=n), pa.int64()),
    ]


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_prints long"
_NAMES = [c.split(" ")[0] for c in _COLUMNS.split(", ")]


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and the likeness to the next document, in descending order of the key.

    The last half of a text's code points is replaced by as many of the next document's first; the last document is followed
    by the first, a single one by itself.  Null texts are empty; a null key is the smallest; rows with equal keys follow one
    another in order of a hash of their texts.  Texts move once, to be sorted by range of the key; only the first and last
    text of each range are handed on to the neighbouring range.
    """
    rows = df.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    tie = F.xxhash64("_t")
    sorted_rows = rows.repartitionByRange("_k", tie).sortWithinPartitions("_k", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), None, None  # type: ignore[union-attr]

        def edge(kind: int, k: pa.Scalar, t: str) -> pa.RecordBatch:
            head = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([k.as_py()], pa.int64()), pa.array([t], pa.string())]
            return pa.RecordBatch.from_arrays([*head, *[pa.nulls(1, f.type) for f in empty]], names)

        empty = [pa.field(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split(" ")[1]]) for n, c in zip(_NAMES, _COLUMNS.split(", "), strict=True)]
        names = ["part", "kind", "k", "t", *_NAMES]
        for block in C.blocks(batches, "_t"):
            keys, texts = block.column("_k"), block.column("_t").to_pylist()
            if before is None:
                yield edge(1, keys[0], texts[0])
                keys, pairs = keys.slice(1), list(zip(texts[1:], texts[:-1], strict=True))
            else:
                pairs = list(zip(texts, [before, *texts[:-1]], strict=True))
            before, last = texts[-1], block.column("_k")[len(texts) - 1]
            if pairs:
                n = len(pairs)
                head = [pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), keys, pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *compare([p[0] for p in pairs], [p[1] for p in pairs])], names)
        if before is not None:
            yield edge(2, last, before)

    found = C.staged(sorted_rows.mapInArrow(run, f"part int, kind int, k long, t string, {_COLUMNS}"))
    # the text before a range's first one is the last of the range before; before the first range stands the last one
    parts = found.where("kind = 1").select("part")
    order = parts.select("part", F.lag("part").over(Window.orderBy("part")).alias("p"))
    order = order.crossJoin(parts.agg(F.max("part").alias("top"))).select("part", F.coalesce("p", "top").alias("p"))
    first = found.where("kind = 1").select("part", "k", "t").join(order, "part")
    last = found.where("kind = 2").select(F.col("part").alias("p"), F.col("t").alias("x"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.blocks(batches, "t"):
            yield pa.RecordBatch.from_arrays([block.column("k"), *compare(block.column("t").to_pylist(), block.column("x").to_pylist())], ["k", *_NAMES])

    joined = first.join(last, "p").select("k", "t", "x").mapInArrow(edges, f"k long, {_COLUMNS}")
    return found.where("kind = 0").select("k", *_NAMES).union(joined).withColumnRenamed("k", key)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(C.table(spark, sf_dir, "documents"))
