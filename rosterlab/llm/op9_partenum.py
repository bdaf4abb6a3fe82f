"""Exact similarity join of documents on word shingles with PartEnum signatures, reduced to linked groups.

Sets are dealt to bands of sizes of which each and the next hold all similar sets.  For two neighbouring bands, similar sets
differ in at most k shingles.  The shingle domain is hashed into n1 x n2 parts: of the n1 groups of parts more than
n1 - 1 - k / (k2 + 1) hold at most k2 differences, and of such a group's n2 parts some n2 - k2 agree.  A set has one
signature for each such subset in each group; similar sets share one.  Subsets without shingles would be shared by
everything, so a set leaves them out where one of its agreeing groups surely has none of them, and keeps them otherwise.

Sets that share a signature are compared in stages, each exact in what it drops: a histogram of hashed shingles that bounds
their difference from below, then the sets themselves.  Only links that join two groups not yet joined are looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import common as C

WORDS, SIMILAR = 5, 80  # per cent
#: Members of a signature's run up to which all its pairs are tried at once; longer runs are joined in two steps.
SMALL_RUN = 12
#: Sets that one task compares with each other, and bits of the bitmap that leaves out texts without candidates.
BLOCK, BITS = 256, 22
#: Bytes of signatures and their sets' names for each shingle, and bytes that one task takes of them or of sets.
SIGNATURE_BYTES, TASK_BYTES = 14, 1 << 23
#: Bits of a signature that travel next to its bucket; sets that agree in them by chance are candidates, compared like others.
SENT_BITS = 32
#: Bytes of text whose sets a worker holds at a time.
TEXT_BYTES = 1 << 20


# --- sets ------------------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in ascending order, and the n+1 offsets."""
    n = len(offsets) - 1
    words = C.Words(data, offsets, lower=True)
    at, hashes = words.grams(k)
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    doc = np.concatenate([words.doc[at], few]).astype(np.uint16 if n < 1 << 16 else np.int64)
    hashes = np.concatenate([hashes, C.span_hashes(words.hash, words.base[few], words.base[few + 1])])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _nodes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have one."""
    size = np.diff(offsets).astype(np.uint64)
    return C.mix(_sums(C.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets) + size * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _width(size: int) -> int:
    """Cells of a set's histogram: a power of two, about a fourth of its size."""
    return 1 << min(14, max(3, int(size // 4).bit_length()))


_SEAL = "_seal"  # a hash of the whole text


def _profiles(k: int, key: str, text: str) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, offsets = shingle_sets(*C.buffers(block.column(text)), k)
        size, mixed = np.diff(offsets), C.mix(values)
        cells = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            width = _width(b - a)
            cells.append(np.bincount((mixed[a:b] >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width).astype(np.uint8).tobytes())
        node = pa.array(_nodes(values, offsets), pa.int64(), mask=size == 0)
        yield pa.RecordBatch.from_arrays([block.column(key).cast(pa.int64()), block.column(_SEAL), pa.array(size), node, pa.array(cells, pa.binary())], ["id", "seal", "n", "node", "cells"])

    return step


# --- signatures ------------------------------------------------------------------------------------------------------


def _bands() -> np.ndarray:
    """Least sizes of the bands: a set of one is similar to sets of the same or a neighbouring band only."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * 100 // SIMILAR + 1)
    return np.array(least, np.int64)


BANDS = _bands()


def parameters(band: int) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) for the sets of a band and the next one; n1 = 0 where similar sets are equal."""
    low, high = int(BANDS[band]), int(BANDS[band + 2]) - 1
    k = (100 - SIMILAR) * 2 * high // (100 + SIMILAR)
    if not k:
        return 0, 0, 1, 0
    budget = 3.0 if high <= 64 else 1.8 if high <= 256 else 1.25
    best = (2.0, 0, 0, 0)
    for n2, k2 in ((1, 0), (2, 1), (3, 1), (3, 2), (4, 2)):
        need, ways = k // (k2 + 1), comb(n2, k2)
        for n1 in range(need + 1, need + 2 + max(2, need // 3)):
            if n1 * ways > budget * (k + 1) + 4:
                break
            bare = min(1.0, ways * exp(-1.2 * low / (n1 * n2) * (n2 - k2)))  # a group with an empty subset
            unsafe = bare * n1 / (n1 - need)  # near or over 1: sets often keep empty subsets
            best = min(best, (unsafe, n1, n2, k2))
    return k, *best[1:]


def _signatures(values: np.ndarray, size: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of the chosen sets in one pair of bands."""
    k, n1, n2, k2 = parameters(band)
    if not n1 or not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = size[chosen]
    row = np.repeat(np.arange(len(chosen)), length)
    x = values[np.repeat(offsets[chosen] - np.cumsum(length) + length, length) + np.arange(length.sum())]
    seed = np.uint64((0x9E3779B97F4A7C15 * (band + 1)) & (2**64 - 1))
    part = (((C.mix(x + seed) >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
    cell = row * (n1 * n2) + part
    # sums of hashes by part, with sorted prefix sums
    order = np.argsort(cell, kind="stable")
    count = np.bincount(cell, minlength=len(chosen) * n1 * n2)
    total = _sums(C.mix(x ^ seed)[order], np.concatenate([[0], np.cumsum(count)]))
    total, full = total.reshape(len(chosen), n1, n2), count.reshape(len(chosen), n1, n2) > 0
    subsets = list(combinations(range(n2), n2 - k2))
    signature = np.zeros((len(chosen), n1, len(subsets)), np.uint64)
    some = np.zeros(signature.shape, bool)
    for i, subset in enumerate(subsets):
        name = C.mix(np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(i) + seed)
        s = np.zeros((len(chosen), n1), np.uint64)
        for part_ in subset:
            s = (s + total[:, :, part_]) * np.uint64(0xD6E8FEB86659FD93)
            some[:, :, i] |= full[:, :, part_]
        signature[:, :, i] = C.mix((s + name[None, :]).ravel()).reshape(s.shape)
    agreeing = n1 - k // (k2 + 1)  # groups of a similar pair with at most k2 differences, at least
    unsafe = (~some).any(2).sum(1) >= agreeing
    keep = some | unsafe[:, None, None]
    return signature[keep], np.repeat(chosen, keep.reshape(len(chosen), -1).sum(1))


def _signature_rows(k: int, text: str, buckets: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """For each bucket of signatures one row: the bits of the signatures below the bucket's, and their sets' names."""
    bits = buckets.bit_length() - 1

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, offsets = shingle_sets(*C.buffers(block.column(text)), k)
        size, nodes = np.diff(offsets), _nodes(values, offsets)
        _, one = np.unique(nodes, return_index=True)  # copies within a block are one set
        one = one[size[one] > 0]
        band = np.searchsorted(BANDS, size[one], "right") - 1
        sigs, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in np.unique(np.concatenate([band, band - 1])):
            if b >= 0:
                s, w = _signatures(values, size, offsets, one[(band == b) | (band == b + 1)], int(b))
                sigs.append(s)
                who.append(w)
        sig, node = np.concatenate(sigs), nodes[np.concatenate(who)]
        if not len(sig):
            return
        bucket = (sig >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        sent = (sig >> np.uint64(64 - SENT_BITS - bits)).astype("<u4")[order]
        node, bucket = node[order].astype("<i8"), bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(begin[1:], len(sent))
        rows: tuple[list, list] = ([], [])
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            rows[0].append(sent[a:b].tobytes())
            rows[1].append(node[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *[pa.array(r, pa.binary()) for r in rows]], ["bucket", "sigs", "nodes"])

    return step


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (kind 0: a, b) of sets that share a signature, and members (kind 1: run, set) of long runs, bucket by bucket."""
    met: set[int] = set()

    def flush(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        sig = np.concatenate([np.frombuffer(p[0], "<u4") for p in parts])
        node = np.concatenate([np.frombuffer(p[1], "<i8") for p in parts])
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        near = np.zeros(len(sig), bool)
        near[1:] = sig[1:] == sig[:-1]
        near[:-1] |= near[1:]
        sig, node = sig[near], node[near]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(sig)))
        run_hash = C.mix(_sums(C.mix(node.astype(np.uint64)), np.append(begin, len(sig))) + size.astype(np.uint64)).astype(np.int64) if len(sig) else begin
        _, only = np.unique(run_hash, return_index=True)  # runs with the same members say the same
        only = only[(size[only] > 1) & ~np.isin(run_hash[only], np.fromiter(met, np.int64, len(met)))]
        if len(met) < 200_000:
            met.update(run_hash[only].tolist())
        pair_a, pair_b, run, member = [], [], [], []
        for m in np.unique(size[only]):
            at = begin[only[size[only] == m]]
            if m <= SMALL_RUN:
                i, j = np.triu_indices(int(m), 1)
                pair_a.append(node[at[:, None] + i].ravel())
                pair_b.append(node[at[:, None] + j].ravel())
            else:
                rows = at[:, None] + np.arange(m)
                pair_a += [np.repeat(node[at], m - 1), node[rows[:, :-1]].ravel()]
                pair_b += [node[rows[:, 1:]].ravel(), node[rows[:, 1:]].ravel()]
                run.append(np.repeat(run_hash[only[size[only] == m]], m))
                member.append(node[rows].ravel())
        pairs = np.unique(np.stack([np.concatenate(pair_a), np.concatenate(pair_b)], 1), axis=0) if pair_a else np.zeros((0, 2), np.int64)
        first = np.concatenate([pairs[:, 0], *run])
        second = np.concatenate([pairs[:, 1], *member])
        kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(first) - len(pairs), np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(first), pa.array(second)], ["kind", "a", "b"])

    held: list[tuple[bytes, bytes]] = []
    last = None
    for batch in batches:
        for b, s, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if b != last and held:
                yield flush(held)
                held = []
            last = b
            held.append((s, n))
    if held:
        yield flush(held)


# --- comparison ------------------------------------------------------------------------------------------------------


def _fold(cells: np.ndarray, width: int) -> np.ndarray:
    while len(cells) > width:
        cells = cells[0::2] + cells[1::2]  # modulo 256
    return cells


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles that two sets do not share, from their histograms modulo 256."""
    width = min(len(a), len(b))
    d = _fold(a, width) - _fold(b, width)
    return int(np.minimum(d, -d).sum(dtype=np.int64))


def _near_histograms(n: np.ndarray, cells: list[bytes]):
    """For one set, which of others its histogram does not rule out."""
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([len(c) for c in cells])
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        by[int(width)] = at, np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), width)

    def near(size: int, cell: bytes, among: np.ndarray) -> np.ndarray:
        mine, out = np.frombuffer(cell, np.uint8), np.zeros(len(n), bool)
        fits = among & (100 * np.minimum(n, size) >= SIMILAR * np.maximum(n, size))
        for width, (at, m) in by.items():
            rows = np.flatnonzero(fits[at])
            if not len(rows):
                continue
            low, x, y = min(width, len(mine)), m[rows], _fold(mine, min(width, len(mine)))
            while x.shape[1] > low:
                x = x[:, 0::2] + x[:, 1::2]
            d = x - y
            out[at[rows]] = np.minimum(d, -d).sum(1, dtype=np.int64) * (100 + SIMILAR) <= (100 - SIMILAR) * (n[at[rows]] + size)
        return out

    return near


def _near_sets(n: np.ndarray, sets: list[bytes]):
    """For one set, which of others have an intersection of at least SIMILAR per cent of the union."""
    values = np.frombuffer(b"".join(sets), np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])

    def near(size: int, own: bytes, among: np.ndarray) -> np.ndarray:
        nonlocal values, owner
        live = among[owner]
        x, who = values[live], owner[live]
        mine = np.frombuffer(own, np.uint64)  # ascending
        at = np.minimum(np.searchsorted(mine, x), max(len(mine) - 1, 0))
        both = np.bincount(who[mine[at] == x] if len(mine) else who[:0], minlength=len(n))
        return among & (100 * both >= SIMILAR * (n + size - both))

    return near


def _by_group(keys: list[str], handle: Callable[[pa.Table], pa.RecordBatch | None]):
    """mapInArrow over sorted partitions: each group of rows with equal keys, handled as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(c[a] for c in columns)
                if held and now != last:
                    out = handle(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            out = handle(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def _edges(a: list, b: list) -> pa.RecordBatch:
    x, y = C.forest(np.array(a, np.int64), np.array(b, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _solve(make: Callable) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """A spanning forest of the links among a group's rows: a set is compared with those that nothing has reached yet."""

    def handle(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        node, n, data = rows.column("node").to_numpy(), rows.column("n").to_numpy(), rows.column("data").to_pylist()
        near, left = make(n, data), np.ones(len(node), bool)
        a: list[int] = []
        b: list[int] = []
        for seed in range(len(node)):
            todo = [seed] if left[seed] else []
            left[seed] = False
            while todo and left.any():
                i = todo.pop()
                found = np.flatnonzero(near(int(n[i]), data[i], left))
                left[found] = False
                todo += found.tolist()
                a += [int(node[i])] * len(found)
                b += node[found].tolist()
        return _edges(a, b)

    return handle


def _across(make: Callable) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Links between left and right rows of a tile that lie in different components; joined components count as one."""

    def handle(rows: pa.Table) -> pa.RecordBatch | None:
        left, right = rows.filter(rows.column("left")), rows.filter(rows.column("right"))
        if not left.num_rows or not right.num_rows:
            return None
        component = right.column("component").to_numpy().copy()
        node, near = right.column("node").to_numpy(), make(right.column("n").to_numpy(), right.column("data").to_pylist())
        a: list[int] = []
        b: list[int] = []
        for one, size, own, c in zip(*[left.column(x).to_pylist() for x in ("node", "n", "data", "component")], strict=True):
            while True:
                mine = component[node == one]
                c = mine[0] if len(mine) else c
                found = np.flatnonzero(near(size, own, component != c))
                if not len(found):
                    break
                a.append(one)
                b.append(int(node[found[0]]))
                component[component == component[found[0]]] = c
        return _edges(a, b)

    return handle


def solve(rows: DataFrame, group: list[str], make: Callable, tasks: int) -> DataFrame:
    """Edges (a, b) that span the links within each group of rows (*group, node, n, data)."""
    return rows.repartition(tasks, *group).sortWithinPartitions(*group).mapInArrow(_by_group(group, _solve(make)), "a long, b long")


def across(rows: DataFrame, make: Callable) -> DataFrame:
    """Edges between components within each group of rows (group, component, node, n, data).

    Rows outside a group's largest component meet all rows of the group, in tiles of bounded size.
    """
    counts = rows.groupBy("group", "component").agg(F.count("*").alias("c"))
    tops = counts.groupBy("group").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("k")).where("k > 1")
    tops = tops.select("group", F.col("top.component").alias("most"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("all") / (4 * BLOCK)).cast("int").alias("rights"))
    dealt = rows.join(tops, "group")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("component != most").withColumn("i", number("lefts")).withColumn("j", each("rights")).withColumn("left", F.lit(True)).withColumn("right", F.lit(False))
    right = dealt.withColumn("i", each("lefts")).withColumn("j", number("rights")).withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
    keys = ["group", "i", "j"]
    return left.union(right).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_group(keys, _across(make)), "a long, b long")


# --- the join --------------------------------------------------------------------------------------------------------


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")], strict=True):
            fits = 100 * min(n, m) >= SIMILAR * max(n, m)
            keep.append(fits and _apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + SIMILAR) <= (100 - SIMILAR) * (n + m))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "likely"])


def _set_rows(k: int, text: str, slots: dict[int, int]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    words = np.zeros(1 << (BITS - 6), np.int64)
    for w, m in slots.items():
        words[w] = m

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, offsets = shingle_sets(*C.buffers(block.column(text)), k)
        nodes = _nodes(values, offsets)
        slot = nodes & ((1 << BITS) - 1)
        use = np.flatnonzero(((words[slot >> 6] >> (slot & 63)) & 1).astype(bool) & (np.diff(offsets) > 0))
        _, one = np.unique(nodes[use], return_index=True)
        use = use[one]
        sets = [values[offsets[i] : offsets[i + 1]].tobytes() for i in use.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(np.diff(offsets)[use]), pa.array(sets, pa.binary())], ["node", "n", "data"])

    return step


def _sealed(text: str) -> F.Column:
    return F.xxhash64(F.col(text))


def _tasks(spark: SparkSession, sets: DataFrame, width: int) -> int:
    """Tasks for sets of n elements each, at `width` bytes an element; not fewer than the session's shuffle partitions."""
    return max(C.partitions(spark), (sets.select(F.sum("n")).first()[0] or 0) * width // TASK_BYTES)


def _parted(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b) whose ends lie in different clusters; a node without a cluster is one of its own."""
    for end in ("a", "b"):
        pairs = pairs.join(clusters.withColumnsRenamed({"node": end, "component": f"of_{end}"}), end, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _mixed_runs(members: DataFrame, ends: DataFrame, clusters: DataFrame) -> DataFrame:
    """(group, node, component) of the runs (group, node) whose members lie in several clusters.

    A long run's neighbours are pairs, so that a mixed run has a dropped pair between two clusters: only runs that hold an
    end of such a pair are shuffled and looked up.
    """
    groups = members.join(ends, "node", "left_semi").select("group").distinct()
    runs = members.join(groups, "group", "left_semi").distinct().join(clusters, "node", "left").withColumn("component", F.coalesce("component", "node"))
    runs = C.staged(runs)
    mixed = runs.groupBy("group").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("group")
    return runs.join(mixed, "group")


def _components(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, seal, n, node, group, component_id) for every row of df: its set, the set that names the component, its smallest key."""
    spark = df.sparkSession
    docs = df.select(key, text)
    profile = C.staged(docs.withColumn(_SEAL, _sealed(text)).mapInArrow(C.in_arrow(_profiles(k, key, text), text, TEXT_BYTES), "id long, seal long, n long, node long, cells binary"))
    nodes = C.staged(profile.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("cells").alias("cells")))

    # one bucket a task, and as many as the shingles of all documents call for
    buckets = 1 << (_tasks(spark, profile, SIGNATURE_BYTES) - 1).bit_length()
    rows = docs.mapInArrow(C.in_arrow(_signature_rows(k, text, buckets), text, TEXT_BYTES), "bucket long, sigs binary, nodes binary")
    found = C.staged(rows.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_runs, "kind int, a long, b long"))

    pairs = found.where("kind = 0").select("a", "b").distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cells").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("xb"))
    judged = C.staged(pairs.join(left, "a").join(right, "b").mapInArrow(_prune, "a long, b long, likely boolean"))
    likely = judged.where("likely").select("a", "b")
    clusters = C.staged(C.components(likely))

    # members of long runs that the first pairs left in different clusters
    ends = C.staged(_parted(judged.where("NOT likely").select("a", "b"), clusters))
    if not ends.isEmpty():
        runs = _mixed_runs(found.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("node")), ends, clusters)
        more = C.staged(across(runs.join(nodes.select("node", "n", F.col("cells").alias("data")), "node").select("group", "component", "node", "n", "data"), _near_histograms))
        if not more.isEmpty():
            clusters = C.staged(C.components(likely.union(more)))

    # the sets themselves, of documents with candidates
    slots = {r["w"]: r["m"] for r in clusters.selectExpr(f"node & {(1 << BITS) - 1} AS s").selectExpr("s >> 6 AS w", "shiftleft(1L, int(s & 63)) AS b").groupBy("w").agg(F.bit_or("b").alias("m")).collect()}
    sets = docs.mapInArrow(C.in_arrow(_set_rows(k, text, slots), text, TEXT_BYTES), "node long, n long, data binary")
    members = C.staged(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("data").alias("data")).join(clusters.withColumnRenamed("component", "cluster"), "node"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("m")).select(F.col("component").alias("cluster"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    edges = C.staged(solve(dealt.select("cluster", "block", "node", "n", "data"), ["cluster", "block"], _near_sets, _tasks(spark, members, 8)))

    large = C.staged(sizes.where("blocks > 1").select("cluster"))
    if not large.isEmpty():
        edges = _join_blocks(members.join(large, "cluster"), edges)

    joined = C.components(edges)
    least = nodes.select("node", "least").join(joined, "node")
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    final = C.staged(nodes.select("node", "least").join(joined, "node", "left").join(named, "component", "left").select("node", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "least").alias("component_id")))
    return profile.select("id", "seal", "n", "node").join(final, "node", "left")


def similar_sets(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id) for every row of df.

    A text's set holds the hashes of its runs of k lower-cased (A to Z) words; with fewer words the whole sequence is its
    one element; a null text and one without words has an empty set that nothing links to.  Texts with equal sets are one
    set under one name of 64 bits.  Repeated rows are rows of their own.  A row without a key does not count for the
    smallest key of its component.
    """
    out = _components(df, key, text, k)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _join_blocks(members: DataFrame, edges: DataFrame) -> DataFrame:
    """More edges for clusters of several blocks: first among one set of each part found so far, again in blocks, then
    between all sets of parts that are still separate."""
    tasks = _tasks(members.sparkSession, members, 8)
    for turn in (1, 2):
        parts = C.components(edges)
        roots = members.join(parts, "node", "left").where(F.coalesce("component", "node") == F.col("node")).drop("component")
        sizes = roots.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = roots.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int"))
        edges = C.staged(edges.union(solve(dealt.select("cluster", "block", "node", "n", "data"), ["cluster", "block"], _near_sets, tasks)))
    parts = C.components(edges)
    rows = members.join(parts, "node", "left").select(F.col("cluster").alias("group"), F.coalesce("component", "node").alias("component"), "node", "n", "data")
    return C.staged(edges.union(across(rows, _near_sets)))


def op9_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(C.table(spark, sf_dir, "documents"))


def kept_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """One row of each group of linked documents: of the smallest key, a row without one only where none has a key.

    Of different texts under that key one is taken by its hash, of rows equal in key and text the smallest in all columns.
    Rows whose text is null or has no words link to nothing and all stay.  Columns must be orderable (no maps).
    """
    rows = C.staged(_components(docs, key, text, k).select("id", "seal", "node", "group"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "seal")).alias("_first")
    chosen = rows.where("node IS NOT NULL").groupBy("group").agg(first).select("_first.id", "_first.seal")
    times = rows.where("node IS NOT NULL").groupBy("id", "seal").agg(F.count("*").alias("times"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("seal") == F.col("_own"))
    chosen = chosen.join(times.withColumnsRenamed({"id": "_id", "seal": "_own"}), same).select("id", "seal", (F.col("times") > 1).alias("_again"))
    empty = rows.where("node IS NULL").select("id", "seal").distinct().withColumn("_again", F.lit(False))
    kept = C.staged(chosen.union(empty))

    names = docs.columns
    tagged = docs.withColumn("_id", F.col(key).cast("long")).withColumn("_own", _sealed(text)).join(kept, same)
    # equal rows are folded where they are read
    once = tagged.where("_again").groupBy("_id", "_own").agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    return tagged.where(~F.col("_again")).select(*names).union(once)


