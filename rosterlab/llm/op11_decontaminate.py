"""Benchmark passages in documents, found with one FM-index per shard of documents.

A shard is a run of whole documents.  Its words become symbols, its suffixes are sorted, and the Burrows-Wheeler transform is
held as a wavelet matrix (the level-wise form of a wavelet tree) of packed bits with ranks, next to suffix positions sampled
from the text.  All test phrases are searched backward at once; the rows of a found range are walked back to the next
sampled position, which locates every occurrence.  Spans of occurrences are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlab.llm import common as C

WINDOW = 10
#: Bytes of text of a shard (a longer document is a shard of its own), and one sampled position every so many words.
SHARD_BYTES, SAMPLE = 3 << 20, 8
#: Test phrases that a task holds at a time; more are searched block after block over the stored index.
PHRASES = 1 << 16
#: Located rows handled at a time.
LOCATED = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_HASH = C._BYTE[C._LOWER]
_INDEX = "shard long, ids array<long>, counts array<int>, vocabulary binary, before binary, bits binary, marked binary, sampled binary"
_HITS = "shard long, doc int, starts array<int>, ends array<int>, phrases array<long>"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [0-9a-z and non-ASCII, A-Z lower-cased] of all texts, and the number of words of each text."""
    word = _WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    if len(data):
        edge[0], edge[-1] = word[0], word[-1]
    # a text's edge inside a run of word bytes ends one word and begins another
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    both = inner[word[inner] & word[inner - 1]]
    at = np.flatnonzero(edge) if len(data) else np.zeros(0, np.int64)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    start, end = at[::2], at[1::2]
    count = np.diff(np.searchsorted(start, offsets, "left"))
    return C.span_hashes(_HASH[data], start, end), count


# --- suffix order ----------------------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order: three symbols a key first, then doubled prefixes of what is still equal.

    The last symbol must be unique.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    padded = np.concatenate([symbols, [0, 0]]).astype(np.int64)
    key = padded[:n] << (2 * bits) | padded[1 : n + 1] << bits | padded[2:]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def regroup(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks the suffixes at sorted places by the first place of their group; the places still in groups come back."""
        new = np.empty(len(keys), bool)
        new[:1] = True
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        rank[order[places]] = np.repeat(places[starts], np.diff(np.append(starts, len(keys))))
        alone = new & np.append(new[1:], True)
        return places[~alone]

    left, depth = regroup(np.arange(n), key), 3
    while len(left):
        here = order[left]
        key = rank[here] << 32 | (rank[np.minimum(here + depth, n)] + 1)
        by = np.argsort(key)
        order[left] = here[by]
        left, depth = regroup(left, key[by]), depth * 2
    return order


# --- ranks -----------------------------------------------------------------------------------------------------------


class Bits:
    """Packed bits with the number of ones before every 64th."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @staticmethod
    def pack(flags: np.ndarray) -> np.ndarray:
        size = len(flags) // 64 + 1  # always a word more than is full, so that the rank of the end can be asked
        packed = np.zeros(size * 8, np.uint8)
        some = np.packbits(flags, bitorder="little")
        packed[: len(some)] = some
        return packed.view(np.uint64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def wavelet(sequence: np.ndarray, depth: int) -> np.ndarray:
    """One row of packed bits for each of `depth` levels, highest bit first; a level keeps zeros before ones."""
    rows = []
    for level in range(depth - 1, -1, -1):
        one = (sequence >> level & 1).astype(bool)
        rows.append(Bits.pack(one))
        sequence = np.concatenate([sequence[~one], sequence[one]])
    return np.concatenate(rows)


class Index:
    """The FM-index of one shard, from its stored columns."""

    def __init__(self, row: dict):
        self.ids, self.counts = row["ids"], np.asarray(row["counts"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        #: rows of the suffix order before each symbol's; symbol 0 ends a document, words follow from 1
        self.before = np.frombuffer(row["before"], np.int32).astype(np.int64)
        n = int(self.before[-1])
        depth = max(1, len(self.vocabulary).bit_length())
        self.levels = [Bits(b) for b in np.frombuffer(row["bits"], np.uint64).reshape(depth, n // 64 + 1)]
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]
        self.marked = Bits(np.frombuffer(row["marked"], np.uint64))
        self.sampled = np.frombuffer(row["sampled"], np.int32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each position."""
        low = np.zeros(len(at), np.int64)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - level) & 1).astype(bool)
            r, s = bits.rank(at), bits.rank(low)
            at, low = np.where(one, zeros + r, at - r), np.where(one, zeros + s, low - s)
        return at - low

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer; only for rows whose transform holds a word."""
        at, low, symbol = rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            r, s = bits.rank(at), bits.rank(low)
            at, low = np.where(one, zeros + r, at - r), np.where(one, zeros + s, low - s)
            symbol = symbol << 1 | one
        return self.before[symbol] + at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of word hashes): which occur, and their ranges of rows."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
        known = (self.vocabulary[place] == phrases) | (np.arange(phrases.shape[1]) >= lengths[:, None])
        live = np.flatnonzero(known.all(1))
        symbols = place[live] + 1
        last = symbols[np.arange(len(live)), lengths[live] - 1]
        low, high = self.before[last], self.before[last + 1]
        for step in range(2, phrases.shape[1] + 1):
            moving = np.flatnonzero(lengths[live] >= step)
            symbol = symbols[moving, lengths[live[moving]] - step]
            low[moving] = self.before[symbol] + self.rank(symbol, low[moving])
            high[moving] = self.before[symbol] + self.rank(symbol, high[moving])
            some = low < high
            live, low, high, symbols = live[some], low[some], high[some], symbols[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back to the next sampled one; the first word of every document is sampled."""
        out, steps = np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked.get(rows)
            out[open_[hit]] = self.sampled[self.marked.rank(rows[hit])] + steps
            open_, rows = open_[~hit], self.back(rows[~hit])
            steps += 1
        return out


def build(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, shard: int, sample: int = SAMPLE) -> dict:
    """The columns of one shard's index."""
    hashes, counts = words_of(data, offsets)
    docs, n = len(counts), len(hashes) + len(counts)
    vocabulary, word = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(counts + 1) - 1  # every document ends with symbol 0; in the order of suffixes the ends are all different
    text = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = word + 1
    ranked = text + (docs - 1)
    ranked[ends] = np.arange(docs)
    order = suffix_order(ranked)
    small = np.uint16 if len(vocabulary) < 1 << 16 else np.int32
    transform = text.astype(small)[order - 1]  # the symbol before each suffix; the first document's is an end as well
    first = ends - counts
    offset = np.arange(n) - np.repeat(first, counts + 1)
    taken = inside & (offset % sample == 0)
    marked = taken[order]
    before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(vocabulary) + 1))]).astype(np.int32)
    return {
        "shard": shard, "ids": ids, "counts": counts.astype(np.int32), "vocabulary": vocabulary, "before": before,
        "bits": wavelet(transform, max(1, len(vocabulary).bit_length())), "marked": Bits.pack(marked), "sampled": order[marked].astype(np.int32),
    }


def _row(built: dict) -> pa.RecordBatch:
    arrays = [pa.array([built["shard"]], pa.int64()), pa.ListArray.from_arrays([0, len(built["ids"])], built["ids"].cast(pa.int64()))]
    arrays.append(pa.ListArray.from_arrays([0, len(built["counts"])], pa.array(built["counts"])))
    names = ["vocabulary", "before", "bits", "marked", "sampled"]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.array([built[c].tobytes()], pa.binary()) for c in names]], ["shard", "ids", "counts", *names])


def index_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE) -> DataFrame:
    """One row per shard: its documents' keys and numbers of words, and its index.  A task cuts its own rows into shards."""
    C.importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            return _row(build(rows.column(0).combine_chunks(), *C.buffers(rows.column(1)), shard, sample))

        for block in C.blocks(batches, text, shard_bytes):
            more = int(C.buffers(block.column(1))[1][-1])
            if held and size + more > shard_bytes:
                yield flush()
                shard, held, size = shard + 1, [], 0
            held, size = [*held, block], size + more
        if held:
            yield flush()

    return C.staged(df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, _INDEX))


# --- test phrases ----------------------------------------------------------------------------------------------------


def phrases_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, phrase): the distinct runs of `window` words of every item as binary word hashes; a shorter item is one phrase.

    Items without words have none.
    """
    C.importable(benchmark.sparkSession)

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, counts = words_of(*C.buffers(block.column(1)))
        size = np.minimum(counts, window)
        runs = np.where(counts > 0, counts - size + 1, 0)
        row = np.repeat(np.arange(len(counts)), runs)
        at = np.repeat(np.cumsum(counts) - counts - (np.cumsum(runs) - runs), runs) + np.arange(len(row))
        size = size[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = hashes[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        phrase = C.binary_column(flat.view(np.uint8), ends * 8)
        yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), phrase], ["item", "phrase"])

    return benchmark.select(F.col(item).cast("string").alias("item"), text).mapInArrow(C.in_arrow(step, text, 1 << 18), "item string, phrase binary").distinct()


def _find(phrases: list[tuple[int, bytes]], window: int):
    names = np.array([n for n, _ in phrases], np.int64)
    lengths = np.array([len(p) // 8 for _, p in phrases], np.int64)
    table = np.zeros((len(phrases), window), np.uint64)
    table[np.arange(window) < lengths[:, None]] = np.frombuffer(b"".join(p for _, p in phrases), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i].as_py()
                index = Index({c: batch.column(c)[i].as_buffer() for c in ("vocabulary", "before", "bits", "marked", "sampled")} | {"ids": None, "counts": batch.column("counts")[i].values.to_numpy()})
                yield from _hits(index, shard, names, table, lengths)

    return run


def _hits(index: Index, shard: int, names: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents of a shard with the merged spans of words and the phrases that occur in them."""
    live, low, high = index.search(table, lengths)
    if not len(live):
        return
    size = high - low
    ends = np.cumsum(size)
    docs = np.concatenate([[0], np.cumsum(index.counts + 1)])
    cover = np.zeros(docs[-1] + 1, np.int32)
    pairs = []
    for at in range(0, int(ends[-1]), LOCATED):
        number = np.arange(at, min(int(ends[-1]), at + LOCATED))
        which = np.searchsorted(ends, number, "right")
        position = index.locate(high[which] - (ends[which] - number))
        cover += np.bincount(position, minlength=len(cover)).astype(np.int32)
        cover -= np.bincount(position + lengths[live[which]], minlength=len(cover)).astype(np.int32)
        doc = np.searchsorted(docs, position, "right") - 1
        pairs.append(np.unique(doc * len(live) + which))
    edge = np.flatnonzero(np.diff((np.cumsum(cover[:-1]) > 0).astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    pair = np.unique(np.concatenate(pairs))
    doc, phrase = pair // len(live), names[live[pair % len(live)]]
    hit = np.unique(doc)
    spans = np.searchsorted(np.searchsorted(docs, start, "right") - 1, np.append(hit, len(docs)))
    listed = np.searchsorted(doc, np.append(hit, len(docs)))
    base = np.repeat(docs[hit], np.diff(spans))
    columns = [pa.array(np.full(len(hit), shard), pa.int64()), pa.array(hit, pa.int32())]
    columns += [pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(x - base, pa.int32())) for x in (start, end)]
    columns.append(pa.ListArray.from_arrays(pa.array(listed, pa.int32()), pa.array(phrase)))
    yield pa.RecordBatch.from_arrays(columns, ["shard", "doc", "starts", "ends", "phrases"])


def search(index: DataFrame, phrases: DataFrame, window: int = WINDOW, block: int = PHRASES) -> DataFrame:
    """(shard, doc, starts, ends, phrases): where phrases (phrase id, phrase) occur; doc is the place of a document in its shard.

    The stored index is searched once for every `block` phrases, so neither a task nor the driver holds more of them.
    """
    blocks = phrases.agg(F.max("block")).first()[0]
    found = [index.select("shard", "counts", "vocabulary", "before", "bits", "marked", "sampled").mapInArrow(
        _find([(r["id"], bytes(r["phrase"])) for r in phrases.where(F.col("block") == b).collect()], window), _HITS
    ) for b in range(0 if blocks is None else blocks + 1)]
    if not found:
        return index.sparkSession.createDataFrame([], _HITS)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return C.staged(out)


def _numbered(distinct: DataFrame, block: int) -> DataFrame:
    """(phrase, id, block): phrases numbered within hash buckets of at most about `block` phrases, and dealt to blocks of at most that size."""
    n = distinct.count()
    buckets = max(1, -(-2 * n // block))
    placed = distinct.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    at = F.row_number().over(W.partitionBy("bucket").orderBy("phrase")) - 1
    named = placed.withColumn("at", at).withColumn("part", F.floor(F.col("at") / block))
    # a bucket holds half a block on average; the rare one beyond a block gives a further block of its own
    return named.select("phrase", (F.col("bucket") * (1 << 40) + F.col("at")).alias("id"), (F.col("part") * buckets + F.col("bucket")).cast("int").alias("block"))


def contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block: int = PHRASES,
) -> DataFrame:
    """key, n_words, n_hit, spans, items for every row of documents.

    `spans` are the merged removal spans as [start, end) word numbers, n_hit their words, `items` the sorted ids (as strings)
    of benchmark items of which a window occurs.  Null and empty texts have no words; rows that repeat are rows of their own,
    also under one or no key.  A benchmark row without an id hits words and is not listed; rows of one item are one item.  An
    empty benchmark hits nothing.  Other columns are not read.
    """
    index = index_shards(documents, key, text, shard_bytes)
    phrases = C.staged(phrases_of(benchmark, item, item_text, window))
    numbered = C.staged(_numbered(phrases.select("phrase").distinct(), block))
    hits = search(index, numbered, window, block)
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "counts")).alias("doc", "row")).select("shard", "doc", F.col("row.ids").alias(key), F.col("row.counts").cast("long").alias("n_words"))
    if block and numbered.agg(F.max("block")).first()[0]:  # spans of several blocks of phrases are merged again
        each = hits.select("shard", "doc", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("shard", "doc", "s.starts", "s.ends")
        ahead = F.max("ends").over(W.partitionBy("shard", "doc").orderBy("starts", "ends").rowsBetween(W.unboundedPreceding, -1))
        begins = each.withColumn("new", F.when(ahead >= F.col("starts"), 0).otherwise(1))
        group = begins.withColumn("g", F.sum("new").over(W.partitionBy("shard", "doc").orderBy("starts", "ends")))
        merged = group.groupBy("shard", "doc", "g").agg(F.min("starts").alias("start"), F.max("ends").alias("end"))
        spans = merged.groupBy("shard", "doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    else:
        spans = hits.select("shard", "doc", F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end"))).alias("spans"))
    named = phrases.where(F.col("item").isNotNull()).join(numbered.select("phrase", "id"), "phrase").select("id", "item")
    listed = hits.select("shard", "doc", F.explode("phrases").alias("id")).join(named, "id").groupBy("shard", "doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(listed, ["shard", "doc"], "left")
    none = F.array().cast("array<string>")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    joined = rows.join(found, ["shard", "doc"], "left")
    return joined.select(key, "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", none).alias("items"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = f"""WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
phrases AS MATERIALIZED (
  SELECT DISTINCT item_id, w[i : i + least(len(w), {WINDOW}) - 1] AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS n FROM phrases),
windows AS (
  SELECT r, i, n, w[i : i + n - 1] AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT r, i, n, item_id FROM windows JOIN phrases USING (p)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)"""
