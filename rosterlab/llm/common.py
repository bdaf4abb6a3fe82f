"""Helpers the text operators share: tables, Arrow text buffers, hashing, blocks, components and bounded bitmaps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlab.session import shared_folder

#: Bytes of text handled by one vectorised step inside a task; bounds a worker's memory, changes no result.
BLOCK_BYTES = 1 << 21

#: Rows of an Arrow batch; texts of thousands of rows at once are what a worker's memory is spent on.
BATCH_ROWS = 4000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

NULL_ID = -(1 << 63)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this library when it is run from its folder and not installed, and bounds the rows that a
    worker is sent at a time where the session says nothing about it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, a worker is sent at most so many rows at a time."""
    importable(spark)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows written once to the shared folder that the cluster names, and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    importable(spark)
    path = f"{shared_folder(spark).rstrip('/')}/rosterlab-llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "staged_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with more columns, as a new object."""
    importable(df.sparkSession)
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in columns.items()]])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- text as bytes ---------------------------------------------------------------------------------------------------


def ids_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a block holds about `limit` bytes of `column` or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Variable-length binary rows over one byte buffer."""
    data = np.ascontiguousarray(data, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.asarray(offsets, np.int32)), pa.py_buffer(data)])


# --- hashing ---------------------------------------------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = np.array(x, _U, ndmin=1)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent hash of values[start:end] for every span, by prefix sums."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a block of texts, with 64-bit hashes of their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        word = (data != 32) & ((data < 9) | (data > 13))
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = offsets[1:] > offsets[:-1]
        at, to = offsets[:-1][full], offsets[1:][full] - 1
        first[at], last[to] = word[at], word[to]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.base = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = span_hashes(_BYTE[data], self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words inside one text."""
        n = len(self.doc)
        at = np.arange(max(0, n - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, span_hashes(self.hash, at, at + k)


# --- bounded bitmaps -------------------------------------------------------------------------------------------------


def bitmap(df: DataFrame, key: str, bits: int = 22) -> dict[int, int]:
    """Which slots of 2**bits the keys hash to, as 64-bit words: at most 2**(bits-6) rows reach the driver, whatever the data.

    Only ever used to leave out rows that cannot match before an exact join; a full bitmap costs time, not results.
    """
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("s")).selectExpr("shiftright(s, 6) AS w", "shiftleft(1L, int(s % 64)) AS b")
    return {r["w"]: r["m"] for r in rows.groupBy("w").agg(F.bit_or("b").alias("m")).collect()}


def maybe_in(df: DataFrame, key: str, words: dict[int, int], bits: int = 22) -> DataFrame:
    """Adds the boolean `_maybe`: false only where the key is surely not among the bitmap's keys."""
    slots = df.sparkSession.createDataFrame(list(words.items()) or [(-1, 0)], "_w long, _m long")
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    out = df.withColumn("_w", F.shiftright(slot, 6)).withColumn("_b", (slot % 64).cast("int")).join(F.broadcast(slots), "_w", "left")
    hit = F.expr("shiftright(_m, _b) & 1") == 1
    return out.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_w", "_b", "_m")


# --- components ------------------------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) of a spanning forest; the root of a tree is its smallest node."""
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Edges up to which one task joins all that are left, in a few MB.
FEW_EDGES = 1 << 18


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if parts:
        a, b = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach, for every node of an edge.

    While there are more than FEW_EDGES edges: alternating large and small stars on tables of edges; each step is
    aggregations with partial sums and equi-joins that Spark may split, so a hub costs no single task.  So few edges are
    joined by one task.  Steps are written to the shared folder.  No edges give no rows.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    now = staged(edges.mapInArrow(_local_forest, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    seen = (now.count(), None)
    while True:
        if seen[0] <= FEW_EDGES:
            now, few = staged(now.coalesce(1).mapInArrow(_whole_forest, "a long, b long")), now
            release(few)
            break
        # large star: every larger neighbour of a node joins the smallest node around it
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: a node and its smaller neighbours join the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x != y")
        after = staged(small.union(least.select("m", "b")).toDF("a", "b").distinct())
        release(now)
        now = after
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    members = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out = members.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    del spark
    return out


def give_back() -> None:
    """Returns a worker's free memory to the machine: workers are kept, and the next operator's tasks may run in them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_arrow(step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], column: str, limit: int = BLOCK_BYTES, after: Callable[[], None] | None = None):
    """A mapInArrow function that applies `step` to blocks of bounded text, and calls `after` at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column, limit):
            yield from step(block)
        if after:
            after()
        give_back()

    return run
