"""Removal of repeated passages: seeds are winnowed anchors that documents share, extended both ways to whole windows.

Every window of `length` words holds exactly one chosen anchor: the word gram of least hash in it, of equal ones the
rightmost.  Equal windows therefore choose equal anchors at equal distances, so joining documents on anchors loses no
match.  An occurrence brings a 48-bit hash for each way to extend it left and right to the full length; two occurrences
agree on a window where anchor, distance and that hash agree (112 bits and the distance).  Anchors are counted in slots
first: one that very many places share is dealt by anchor and extension, so no task holds all its places.  Repeated windows that overlap are one maximal repeat of at least `length` words, whose words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import common as C

#: Words of a window that must repeat, and words of an anchor.
LENGTH, ANCHOR = 20, 6
#: Slots that anchors are counted in by their hash; a slot is hot beyond HOT places and CROWDED times the mean slot.
#: Extensions of its anchors are dealt one by one; which slots are decides the work, never the result.
SLOT_BITS, HOT, CROWDED = 16, 4096, 4
#: Column of the rows' numbers while a job runs.
ROW = "_row_of_repeats"
_CELL = 7  # bytes of an extension: words from the window's start to its anchor, and its hash
_COLUMNS = ["kind", "h", "id", "row", "at", "n", "windows"]
_SCHEMA = "kind int, h long, id long, row long, at long, n long, windows binary"


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """For every start, the place of the least of `width` grams; of equal ones the rightmost."""
    at, span = np.arange(len(grams)), 1
    pick = lambda a, b: np.where(grams[b] <= grams[a], b, a)
    while span * 2 <= width:
        at, span = (pick(at[:-span], at[span:]) if len(at) > span else at[:0]), span * 2
    rest = width - span
    if rest:
        at = pick(at[:-rest], at[rest:]) if len(at) > rest else at[:0]
    return at


class _Places:
    """The windows of a block of documents in the order of (key, row, place), with their anchors."""

    def __init__(self, block: pa.RecordBatch, key: str, text: str, length: int, anchor: int):
        ids, rows = C.ids_of(block.column(key)), block.column(ROW).to_numpy()
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.words = C.Words(*C.buffers(block.column(text).take(pa.array(order))))
        self.at, self.full = self.words.grams(length)
        n = len(self.words.doc) - anchor + 1 if len(self.at) else 0
        self.gram = C.span_hashes(self.words.hash, np.arange(n), np.arange(n) + anchor)
        self.place = _least(self.gram, length - anchor + 1)[self.at]
        _, first, same = np.unique(self.full, return_index=True, return_inverse=True)
        self.first = first[same] == np.arange(len(self.at))  # the window's first place in the block

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors whose windows are first places: the index of the first such window, how many, and the anchor's hash."""
        new = np.flatnonzero(self.first)
        begin = np.flatnonzero(np.diff(self.place[new], prepend=-1) != 0)
        return new[begin], np.diff(np.append(begin, len(new))), self.gram[self.place[new[begin]]]


def _slots(key: str, text: str, length: int, anchor: int):
    """(slot, n): how many places of a task's blocks bring anchors of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for block in C.blocks(batches, text):
            total += np.bincount((_Places(block, key, text, length, anchor).anchors()[2] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "n"])

    return run


def hot_slots(rows: DataFrame, key: str, text: str, length: int, anchor: int, hot: int) -> np.ndarray:
    """Which of the 2**SLOT_BITS slots are hot."""
    counted = rows.mapInArrow(_slots(key, text, length, anchor), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for r in counted.collect():  # one row a slot
        total[r["slot"]] = r["n"]
    return (total > hot) & (total > CROWDED * total.mean())


def _seeds(key: str, text: str, length: int, anchor: int, hot: np.ndarray):
    """Anchors with their extensions (kind 0), and runs of `n` windows from word `at` on whose first
    place is in the same block (kind 1)."""

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _Places(block, key, text, length, anchor)
        doc, start = p.words.doc[p.at], p.at - p.words.base[p.words.doc[p.at]]
        run = np.flatnonzero(~p.first)
        b = run[np.flatnonzero(np.concatenate([[True], (np.diff(p.at[run]) != 1) | (np.diff(doc[run]) != 0)]))] if len(run) else run
        n = np.diff(np.append(np.searchsorted(run, b), len(run)))
        none = np.zeros(len(b), np.int64)
        deal = C.mix(p.rows[doc[b]].astype(np.uint64)).view(np.int64) if len(b) else none
        parts = [(none + 1, deal, p.ids[doc[b]], p.rows[doc[b]], start[b], n, np.zeros((0, _CELL), np.uint8), none)]
        lead, size, h = p.anchors()
        new = np.flatnonzero(p.first)
        cells = np.empty((len(new), _CELL), np.uint8)
        cells[:, 0] = p.place[new] - p.at[new]
        cells[:, 1:] = p.full[new].view(np.uint8).reshape(-1, 8)[:, : _CELL - 1]
        split = hot[h >> np.uint64(64 - SLOT_BITS)]
        each = np.repeat(split, size)
        # a hot anchor's extensions travel alone, and equal ones meet
        for b, n, cell, name in (
            (lead[~split], size[~split], cells[~each], h[~split]),
            (new[each], np.ones(int(each.sum()), np.int64), cells[each], C.mix(np.repeat(h, size)[each] ^ C.mix(p.full[new[each]]))),
        ):
            parts.append((np.zeros(len(b), np.int64), name.view(np.int64), p.ids[doc[b]], p.rows[doc[b]], p.place[b] - p.words.base[doc[b]], n, cell, n * _CELL))
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
        columns = [pa.array(joined[0], pa.int32()), *[pa.array(c, pa.int64()) for c in joined[1:6]]]
        yield pa.RecordBatch.from_arrays([*columns, C.binary_column(joined[6].ravel(), np.concatenate([[0], np.cumsum(joined[7])]))], _COLUMNS)

    return step


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows (row, at, n) that begin earlier elsewhere, from seeds in order of anchor, key, row and place.

    Between batches only the extensions already met under the last anchor are kept; an anchor of more places than a hot slot
    has is dealt by extension.
    """
    names = ["row", "at", "n"]
    last, seen = None, np.zeros((2, 0), np.uint64)
    for batch in batches:
        kind, deal, _, rows, at, n = (batch.column(i).to_numpy() for i in range(6))
        ready = kind == 1
        yield pa.RecordBatch.from_arrays([pa.array(x[ready]) for x in (rows, at, n)], names)
        use = np.flatnonzero(~ready)
        if not len(use):
            continue
        data, offsets = C.buffers(batch.column(6))
        dealt = deal[use]
        alone = np.ones(len(use), bool)
        alone[1:] &= dealt[1:] != dealt[:-1]
        alone[:-1] &= dealt[1:] != dealt[:-1]
        alone &= (dealt != dealt[-1]) & (dealt != (dealt[-1] if last is None else last))  # these may go on in the next batch, or have begun before
        use = use[~alone]
        size = n[use]
        row = np.repeat(use, size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        cells = data[(offsets[row] + inside * _CELL)[:, None] + np.arange(_CELL)]
        wide = np.zeros((len(row), 8), np.uint8)
        wide[:, :_CELL] = cells  # distance and hash
        start = at[row] - cells[:, 0]
        keys = np.concatenate([seen, np.stack([deal[row].view(np.uint64), wide.view(np.uint64).ravel()])], 1)
        order = np.lexsort((np.arange(keys.shape[1]), keys[1], keys[0]))
        same = np.zeros(keys.shape[1], bool)
        same[order[1:]] = (keys[:, order[1:]] == keys[:, order[:-1]]).all(0)  # the first met of equal ones is the earliest
        later = same[seen.shape[1] :]
        found_row, found_start = rows[row][later], start[later]
        if len(found_row):
            by = np.lexsort((found_start, found_row))
            found_row, found_start = found_row[by], found_start[by]
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(found_row) != 0) | (np.diff(found_start) > 1)]))
            stop = np.append(begin[1:], len(found_row)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(found_row[begin]), pa.array(found_start[begin]), pa.array(found_start[stop] - found_start[begin] + 1)], names)
        mine = np.concatenate([np.full(seen.shape[1], last == dealt[-1]), deal[row] == dealt[-1]]) & ~same
        last, seen = dealt[-1], keys[:, mine]


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(row, at, n): runs of n windows from word `at` on whose words also begin earlier: under a smaller key, under the same
    key in a row of smaller number, or before in the same row.

    df has a distinct number for each row in ROW.  A null key is the smallest.  Blocks of text settle their own repeats
    first, so of a passage with many copies a task sends one.
    """
    rows = df.select(key, ROW, text)
    seeds = rows.mapInArrow(C.in_arrow(_seeds(key, text, length, anchor, hot_slots(rows, key, text, length, anchor, hot)), text), _SCHEMA)
    return seeds.repartition("h").sortWithinPartitions("h", "id", "row", "at").mapInArrow(_extended, "row long, at long, n long")


def _without(data: bytes, text_runs: list[dict] | None, length: int) -> tuple[int, int, bytes]:
    """Number of words, of words removed, and what is kept, joined by single spaces."""
    words = data.split()
    if not text_runs:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for r in text_runs:
        gone[r["at"]] += 1
        gone[r["at"] + r["n"] + length - 1] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    return len(words), int(len(words) - kept.sum()), b" ".join(w for w, k in zip(words, kept, strict=True) if k)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """df with `text` cut down to the words that no repeated window covers, and n_words and n_removed.

    Words are runs of other characters than space, tab, line feed, vertical tab, form feed and return.  A null text has
    no words and stays null; a text without repeats keeps its words, joined by single spaces.  Every row is a document of its
    own, also where rows share or lack a key: of equal keys the row read first is the earlier one, so a repeated row loses
    what repeats.  Only texts that may have repeats are moved; the others are cut where they are read.
    """
    df = df.drop("n_words", "n_removed")
    numbered = C.staged(df.withColumn(ROW, F.monotonically_increasing_id()), "zstd")  # written, so that a row keeps its number
    found = C.staged(repeated_windows(numbered, key, text, length, anchor, hot))
    runs = found.groupBy(F.col("row").alias(ROW)).agg(F.collect_list(F.struct("at", "n")).alias("_runs"))  # at most one document's windows
    tagged = C.maybe_in(numbered, ROW, C.bitmap(found, "row"))
    joined = tagged.where("_maybe").join(runs, ROW, "left")
    rest = tagged.where(~F.col("_maybe")).withColumn("_runs", F.lit(None).cast(runs.schema["_runs"].dataType))

    names = df.columns

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = block.column(text).to_pylist()
        parts = [_without((t or "").encode(), r, length) for t, r in zip(texts, block.column("_runs").to_pylist(), strict=True)]
        kept = pa.array([None if t is None else p[2].decode() for t, p in zip(texts, parts, strict=True)], pa.string())
        counts = [pa.array([p[i] for p in parts], pa.int64()) for i in (0, 1)]
        columns = [kept if c == text else block.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, "n_words", "n_removed"])

    schema = C.widened(df, n_words="long", n_removed="long")
    cut = C.in_arrow(step, text)
    out = [part.select(*df.columns, "_runs").mapInArrow(cut, schema) for part in (rest, joined)]
    return out[0].union(out[1])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, in the columns they came with; n_chars follows the text."""
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
