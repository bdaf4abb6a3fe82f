"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by the concatenated signs of random hyperplanes and compares every vector with
the next `window` vectors of that order.  Verified pairs of all passes are joined to components.

A hyperplane through the origin separates two vectors with probability angle / pi whatever the other vectors are.  So a pair
at the limit shares its first b signs in at least one of `passes_for(b)` passes but for a probability MISSED, and is compared
there if no more than `window` vectors share them.  b follows from the number of rows.  Vectors that stand in a longer run of
equal signs in some pass are crowded: they are sorted again under fresh hyperplanes, with b taken from their own runs and as
many passes as that b needs (MOST_PASSES at most, beyond which a crowded pair is missed more often; the README has the
measured recall).

The passes carry 64-bit codes and row names.  The vectors, rounded to 16 bits a component, are joined once the order is known
and a row is sent to one block of the order, every eighth to a second.  Rounding has a proven bound: pairs clearly above the
limit are links, pairs clearly below are not, and pairs in between are decided on the vectors themselves.  Inside a component
links are then counted exactly, in tiles, so a dense group loses no link and no pair of it is written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterlab.llm import common as C

SIMILAR, SEED = 0.9, 5
#: Probability, over the random hyperplanes, that a pair at exactly the limit shares the first signs in no pass.
MISSED = 0.01
#: Following vectors that each is compared with in a pass.
WINDOW = 2048
#: Signs of a code, and most passes over crowded vectors.
BITS, MOST_PASSES = 62, 96
#: Windows in a block of the order, bytes of a block's vectors, rows of a step in it, rows of a tile of a component.
WINDOWS, BLOCK_BYTES, STEP, TILE = 8, 32 << 20, 1024, 4096
#: Cosines in double precision are this near to the true ones; nearer to the limit a pair is decided in whole fractions.
ROUNDING = 1e-12
_LEVEL = 1000


def passes_for(bits: int, similar: float = SIMILAR, missed: float = MISSED) -> int:
    """Passes after which a pair of cosine `similar` has shared the first `bits` signs, but for probability `missed`."""
    alike = (1 - np.arccos(np.clip(similar, -1, 1)) / np.pi) ** bits
    return 1 if alike >= 1 - missed else int(np.ceil(np.log(missed) / np.log1p(-max(alike, 1e-12))))


def bits_for(rows: int, window: int = WINDOW) -> int:
    """Signs after which half a window of `rows` vectors without any structure is left in a run."""
    return 0 if rows <= window else min(BITS, int(np.ceil(np.log2(rows / window))) + 1)


# --- vectors -----------------------------------------------------------------------------------------------------------


def _good(vector: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, size): vectors that can be linked, in double precision.

    Null and empty vectors, zero vectors, and those with a null, infinite or NaN component are left out.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return df.where(_good(vector)).select(F.col(key).cast("long").alias("id"), v.alias("v")).withColumn("size", F.size("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.values.to_numpy()[v.offsets.to_numpy()[0] : v.offsets.to_numpy()[-1]].reshape(len(v), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square overflows or vanishes
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _reaches(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Whether the cosine of a and b is at least `similar`, without rounding."""
    x, y, s = [Fraction(t) for t in a.tolist()], [Fraction(t) for t in b.tolist()], Fraction(str(similar))
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    return dot * abs(dot) >= s * abs(s) * sum(p * p for p in x) * sum(q * q for q in y)


def _decided(cosine: np.ndarray, similar: float, left, right) -> np.ndarray:
    """cosine >= similar, where places within rounding of the limit are settled on the vectors left(i), right(j)."""
    hit = cosine >= similar
    for at in zip(*np.nonzero(np.abs(cosine - similar) < ROUNDING), strict=True):
        hit[at] = _reaches(left(at), right(at), similar)
    return hit


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, size, q): components as 16-bit integers, scaled by the largest one."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for width in np.unique(sizes):
            part = batch.take(pa.array(np.flatnonzero(sizes == width)))
            m = _matrix(part.column("v"))
            q = np.rint(m / np.abs(m).max(1, keepdims=True) * 32767).astype("<i2")
            data = C.binary_column(q.view(np.uint8).ravel(), np.arange(len(q) + 1) * 2 * int(width))
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("size"), data], ["rep", "size", "q"])


def _integers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    data, _ = C.buffers(column)
    return data.view("<i2").reshape(-1, width)


# --- one sorted pass after another -------------------------------------------------------------------------------------


def _codes(first: int, passes: int, seed: int):
    """(pass, size, code, rep): the signs of BITS hyperplanes for every pass, the first sign being the highest bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for width in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                q, n = _integers(part.column("q"), width).astype(np.float64), part.num_rows
                for p in range(first, first + passes):
                    plane = np.random.default_rng([seed, p, width]).standard_normal((width, BITS))
                    code = ((q @ plane) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p), pa.int32()), pa.array(np.full(n, width), pa.int32()), pa.array(code), part.column("rep")], ["pass", "size", "code", "rep"])

    return run


def ordered(reps: DataFrame, first: int, passes: int, seed: int = SEED) -> DataFrame:
    """(pass, size, code, rep, part, at): all rows of all passes in the order of their codes, written once.

    The order is that of (size, pass, code), ties in order of a hash; it is sorted by range, and `at` numbers the rows of a range.
    """
    tie = F.xxhash64(F.lit(seed), "rep")
    rows = reps.select("rep", "size", "q").mapInArrow(_codes(first, passes, seed), "pass int, size int, code long, rep long")
    order = rows.repartitionByRange("size", "pass", "code", tie).sortWithinPartitions("size", "pass", "code", tie)
    number = F.monotonically_increasing_id()
    return C.staged(order.withColumn("part", F.shiftright(number, 33)).withColumn("at", number.bitwiseAND((1 << 33) - 1)))


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = label[p] != label[q]
    if not apart.any():
        return label
    low, node = C.forest(label[p[apart]], label[q[apart]])
    to = np.arange(len(label))
    to[node] = low
    return to[label]


def _window_pairs(similar: float, window: int):
    """Links of a block's rows with the next `window` rows: a forest of the sure ones, and the pairs that rounding leaves open."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        sizes, halo = rows.column("size").to_numpy(), rows.column("halo").to_numpy(zero_copy_only=False)
        out = []
        for width in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == width)
            rep, own = rows.column("rep").to_numpy()[at], int((~halo[at]).sum())
            q = _integers(rows.column("q").take(pa.array(at)), width).astype(np.float32)
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            unit = (q / norm[:, None]).astype(np.float32)
            # half a unit of every component, on both sides, and the sums in single precision
            slack = np.float32(2 * np.sqrt(width) * 0.5 / norm.min() * 1.01 + (width + 8) * 2.4e-7)
            label, step = np.arange(len(at)), min(STEP, window)
            open_p, open_q = [], []
            for x in range(0, own, step):
                near = unit[x : min(x + step, own)] @ unit[x : x + step + window].T
                p, r = np.nonzero(near >= similar - slack)
                later = r > p
                p, r = p[later], r[later]
                sure = near[p, r] >= similar + slack
                label = _joined(label, x + p[sure], x + r[sure])
                apart = ~sure & (label[x + p] != label[x + r]) & (rep[x + p] != rep[x + r])
                open_p.append(x + p[apart])
                open_q.append(x + r[apart])
            low = np.flatnonzero(label != np.arange(len(at)))
            p, r = np.concatenate([*open_p, low[:0]]), np.concatenate([*open_q, low[:0]])
            left = label[p] != label[r]
            p, r = p[left], r[left]
            a, b = np.concatenate([rep[label[low]], rep[p]]), np.concatenate([rep[low], rep[r]])
            sure = np.arange(len(a)) < len(low)
            out.append(pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure}))
        return pa.concat_tables(out)

    return run


def window_pairs(order: DataFrame, reps: DataFrame, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """(a, b, sure): links between rows of `order` that are at most `window` places apart, and pairs still to be decided.

    Blocks of WINDOWS windows of the order are a task's; the first window of a block is also sent to the block before, so
    every two neighbours meet.  A block may span ranges and passes: a verified pair is one wherever it is found.
    """
    counts = order.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    widest = reps.agg(F.max("size")).first()[0] or 1
    span = window * max(1, min(WINDOWS, BLOCK_BYTES // (2 * widest * window)))
    rank = order.join(before, "part").select("rep", "size", (F.col("before") + F.col("at")).alias("rank"))
    block = F.expr(f"rank div {span}")
    ahead = (F.col("rank") % span < window) & (F.col("rank") >= span)
    spread = F.when(ahead, F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")), F.struct((block - 1).alias("block"), F.lit(True).alias("halo"))))
    spread = F.inline(F.coalesce(spread, F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")))))
    rows = rank.join(reps.select("rep", "q"), "rep").select("rep", "size", "rank", "q", spread)
    return rows.groupBy("block").applyInArrow(_window_pairs(similar, window), "a long, b long, sure boolean").where("a != b").distinct()


def _prefix(bits: F.Column | int) -> F.Column:
    return F.call_function("shiftright", F.col("code"), (F.lit(BITS) - bits).cast("int"))


def crowded(order: DataFrame, bits: int, window: int = WINDOW) -> DataFrame:
    """(rep): rows that in some pass share their first `bits` signs with more rows than a window holds."""
    coded = order.withColumn("prefix", _prefix(bits))
    keys = ["size", "pass", "prefix"]
    return coded.join(coded.groupBy(*keys).count().where(F.col("count") > window).select(*keys), keys, "left_semi").select("rep").distinct()


def crowded_bits(order: DataFrame, reps: DataFrame, first: int, bits: int, window: int = WINDOW) -> int:
    """The least number of signs from `bits` on that leaves at most a twentieth of `reps` in runs longer than a window, in one pass."""
    rows = order.where(F.col("pass") == first).join(reps.select("rep"), "rep", "left_semi")
    tried = rows.select("size", "code", F.explode(F.sequence(F.lit(bits), F.lit(BITS), F.lit(2))).alias("k"))
    runs = tried.groupBy("size", "k", _prefix(F.col("k")).alias("prefix")).count()
    shares = runs.groupBy("k").agg((F.sum(F.when(F.col("count") > window, F.col("count")).otherwise(0)) / F.sum("count")).alias("share")).collect()
    return min((r["k"] for r in shares if r["share"] <= 0.05), default=BITS)


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for width in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                x, y = _matrix(part.column("x")), _matrix(part.column("y"))
                hit = _decided((_unit(x) * _unit(y)).sum(1), similar, lambda i, x=x: x[i[0]], lambda i, y=y: y[i[0]])
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(hit)), part.column("b").filter(pa.array(hit))], ["a", "b"])

    return run


def sorted_pass_pairs(reps: DataFrame, window: int = WINDOW, similar: float = SIMILAR, passes: int | None = None, seed: int = SEED) -> DataFrame:
    """Pairs (a, b) of reps (rep, v, size), cosine at least `similar`, that join what the passes found to its components.

    `passes` fixes the passes over all rows; by default they follow from the number of rows (see the module's text).
    """
    small = C.staged(reps.select("rep", "v", "size").mapInArrow(_rounded, "rep long, size int, q binary"))
    found, rows, first = [], small, 0
    bits = bits_for(small.count(), window)
    need = passes or passes_for(bits, similar)
    for level in range(2):
        order = ordered(rows, first, need, seed)
        found.append(C.staged(window_pairs(order, rows, window, similar)))
        if level:
            C.release(order)
            break
        more = C.staged(crowded(order, bits, window))
        if more.isEmpty():
            C.release(order)
            break
        bits = crowded_bits(order, more, first, bits + 1, window)
        need, first = min(MOST_PASSES, passes_for(bits, similar)), _LEVEL
        C.release(order)
        rows = C.staged(small.join(more, "rep", "left_semi"))
    pairs = reduce(DataFrame.union, found)
    x = reps.select(F.col("rep").alias("a"), F.col("v").alias("x"), "size")
    y = reps.select(F.col("rep").alias("b"), F.col("v").alias("y"))
    decided = pairs.where("not sure").select("a", "b").distinct().join(x, "a").join(y, "b").mapInArrow(_verify(similar), "a long, b long")
    return pairs.where("sure").select("a", "b").union(decided).distinct()


# --- links inside components -------------------------------------------------------------------------------------------


def _count_tile(similar: float):
    def run(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(rows.column("left")), rows.filter(rows.column("right"))
        rep, total = left.column("rep").to_numpy(), np.zeros(left.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            other, copies = right.column("rep").to_numpy(), right.column("copies").to_numpy()
            x, y = _matrix(left.column("v")), _matrix(right.column("v"))
            ux, uy = _unit(x), _unit(y)
            for s in range(0, len(rep), STEP):
                hit = _decided(ux[s : s + STEP] @ uy.T, similar, lambda i, s=s: x[s + i[0]], lambda i: y[i[1]])
                hit &= rep[s : s + STEP, None] != other
                total[s : s + STEP] = hit @ copies
        return pa.Table.from_arrays([pa.array(rep, pa.int64()), pa.array(total)], ["rep", "n"])

    return run


def link_counts(members: DataFrame, similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """(rep, n): how many vectors of its component each rep of members (component, rep, v, copies) is similar to, but itself.

    A component of m rows is dealt to ceil(m / tile) tiles, and every two tiles meet in one task; only counts leave it.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = dealt.select("component", "rep", "v", "copies", F.col("tile").alias("i"), each.alias("j"), F.lit(True).alias("left"), (F.col("j") == F.col("i")).alias("right"))
    right = dealt.where("tiles > 1").select("component", "rep", "v", "copies", each.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")).where("i != j")
    counted = left.union(right).groupBy("component", "i", "j").applyInArrow(_count_tile(similar), "rep long, n long")
    return counted.groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", similar: float = SIMILAR, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """key, n_links, component_id, kept for every row of df: links are pairs with cosine of at least `similar`, exactly.

    Links inside a component are counted without loss; a pair that no pass compares and no other links join is missed, with
    the probability stated above.

    Vectors that cannot be linked (see `usable`) and rows without a key stand alone with no links; vectors of different lengths are not compared.
    Equal vectors are one representative with a number of copies, which link to each other.  Rows with equal keys are rows
    of their own with the same component.  A row's component is the smallest key that links reach.
    """
    good = usable(df.where(F.col(key).isNotNull()), key, vector).withColumn("h", F.xxhash64("v", F.lit(1))).withColumn("g", F.xxhash64(F.lit(2), "v"))
    # equal vectors are told by 128 bits; the vector itself travels once
    groups = good.groupBy("h", "g", "size").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = C.staged(groups.withColumnRenamed("low", "rep").withColumn("row", F.monotonically_increasing_id()))
    named = groups.select("h", "g", "size", F.col("row").alias("node"), "rep", "copies")
    pairs = C.staged(sorted_pass_pairs(groups.select(F.col("row").alias("rep"), "v", "size"), window, similar, passes))
    found = C.staged(C.components(pairs))
    members = found.join(groups.select(F.col("row").alias("node"), "v", "copies"), "node").select("component", F.col("node").alias("rep"), "v", "copies")
    counts = link_counts(members, similar).withColumnRenamed("rep", "node")
    linked = named.join(found, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = C.staged(linked.join(lows, "component").select("h", "g", "size", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = good.select("id", "h", "g", "size").join(classes, ["h", "g", "size"]).select("id", "n_links", "component_id")
    alone = df.select(F.col(key).cast("long").alias("id"), vector).where(~_good(vector) | F.col("id").isNull())
    alone = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return rows.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(C.table(spark, sf_dir, "embeddings"))
