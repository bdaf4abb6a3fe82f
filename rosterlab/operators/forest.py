"""Random forests whose trees grow with the rows: grown and applied by tasks, kept as a table of nodes.

The method is Spark ML's (at most 32 bins a feature, Poisson(1) bootstrap, a third of the features per node, best variance
gain, down to pure nodes), but no node passes the driver.  Rows are told apart by their bins only, so a tree needs one
weight and one sum for each cell (combination of bins) instead of a histogram for each node from each task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.session import cut_lineage

BITS = 5
BINS = 1 << BITS
#: Trees that one task grows or applies, one after the other.
GROUP_TREES = 5
#: Training rows whose weights are summed at once.
CHUNK_ROWS = 1 << 17
#: Nodes whose histograms are held at once.
CHUNK_NODES = 1 << 14
#: Rows of one cell from which on its prediction is broadcast.
CROWDED_CELL = 1 << 16
POISSON_CDF = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
SAMPLES = "grp int, cell bigint, w array<int>, s array<double>"
NODES = "grp int, tree int, node int, feature int, bin int, child int, value double"


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, tree: int, use: int) -> np.uint64:
    return _mix(_mix(np.array([seed], dtype=np.int64).astype(np.uint64)) + np.uint64(2 * tree + use))[0]


def split_points(rows: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """At most 31 thresholds per feature: between all values where there are few, else the 32-quantiles."""
    fractions = [i / BINS for i in range(1, BINS)]
    quantiles = rows.select(*[F.percentile_approx(c, fractions, 10000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns]))).distinct()
    few = values.groupBy("pos").count().filter(F.col("count") <= BINS)
    listed = values.join(F.broadcast(few), "pos", "left_semi").groupBy("pos").agg(F.sort_array(F.collect_list("col")).alias("v"))
    points = [sorted({float(v) for v in q or []}) for q in quantiles]
    for r in listed.collect():  # at most 32 values per feature
        points[r["pos"]] = [(a + b) / 2 for a, b in zip(r["v"], r["v"][1:], strict=False)]
    return points


def cell_of(columns: Sequence[str], points: Sequence[Sequence[float]]) -> Column:
    """The bins of all features in one number, five bits each; as in Spark ML's assembler a null or NaN is an error."""
    def below(value: Column):
        return lambda threshold: threshold < value

    cell = F.lit(0).cast("bigint")
    for i, (c, thresholds) in enumerate(zip(columns, points, strict=True)):
        value = F.col(c).cast("double")
        limits = F.array(*[F.lit(float(t)) for t in thresholds]).cast("array<double>")
        bin_ = F.size(F.filter(limits, below(value))).cast("bigint")
        checked = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"null or NaN in feature {c}")).cast("bigint")).otherwise(bin_)
        cell = cell + F.shiftleft(checked, BITS * i)
    return cell


def sample_cells(batches: Iterator[pa.RecordBatch], trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Bootstrap weight and weighted target sum of each cell in each tree; a row's draws follow from its hash alone."""

    def chunks():
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held)

    for rows in chunks():
        cell, y, row = (rows.column(c).to_numpy() for c in ("cell", "y", "row"))
        order = np.argsort(cell, kind="stable")
        cell, y, row = cell[order], y[order], row[order].astype(np.uint64)
        cells, first = np.unique(cell, return_index=True)
        for start in range(0, trees, GROUP_TREES):
            several = range(start, min(start + GROUP_TREES, trees))
            weights, sums = [], []
            for tree in several:
                draw = (_mix(row ^ _stream(seed, tree, 0)) >> np.uint64(11)) * 2.0**-53
                w = np.searchsorted(POISSON_CDF, draw, side="right")
                weights.append(np.add.reduceat(w, first))
                sums.append(np.add.reduceat(w * y, first))
            w, s = np.stack(weights, axis=1).astype(np.int32), np.stack(sums, axis=1)
            kept = w.any(axis=1)
            offsets = pa.array(np.arange(0, kept.sum() * len(several) + 1, len(several), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(kept.sum(), start // GROUP_TREES, dtype=np.int32)), pa.array(cells[kept]),
                    pa.ListArray.from_arrays(offsets, pa.array(w[kept].ravel())), pa.ListArray.from_arrays(offsets, pa.array(s[kept].ravel())),
                ],
                names=["grp", "cell", "w", "s"],
            )


def best_splits(cell, node, w, s, weight, total, features: int, stream: np.uint64, first_id: int):
    """Feature (-1: none) and bin of the best split of nodes 0 to k-1; the cells are sorted by node."""
    k = len(weight)
    drawn = _mix((np.arange(first_id, first_id + k, dtype=np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)) ^ stream)
    offered = drawn.argsort(axis=1).argsort(axis=1) < -(-features // 3)
    # A gain below this is rounding: the node is pure.
    best = 1e-24 * total * total / weight
    feature, split = np.full(k, -1), np.zeros(k, dtype=np.int64)
    starts = np.searchsorted(node, np.arange(0, k + CHUNK_NODES, CHUNK_NODES))
    for n, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        low = n * CHUNK_NODES
        for f in range(features):
            chosen = np.flatnonzero(offered[low : low + CHUNK_NODES, f])
            place = np.full(min(CHUNK_NODES, k - low), -1)
            place[chosen] = np.arange(len(chosen))
            at = place[node[a:b] - low]
            use = at >= 0
            slot = at[use] * BINS + ((cell[a:b][use] >> (BITS * f)) & (BINS - 1))
            left_w = np.bincount(slot, w[a:b][use], len(chosen) * BINS).reshape(-1, BINS).cumsum(axis=1)
            left_s = np.bincount(slot, s[a:b][use], len(chosen) * BINS).reshape(-1, BINS).cumsum(axis=1)
            nodes = chosen + low
            all_w, all_s = weight[nodes][:, None], total[nodes][:, None]
            product = all_w * left_w * (all_w - left_w)
            gain = np.divide((left_s * all_w - all_s * left_w) ** 2, product, out=np.zeros_like(product), where=product > 0)
            bin_ = gain.argmax(axis=1)
            gain = gain[np.arange(len(nodes)), bin_]
            better = gain > best[nodes]
            nodes = nodes[better]
            best[nodes], feature[nodes], split[nodes] = gain[better], f, bin_[better]
    return feature, split


def grow_tree(cell: np.ndarray, w: np.ndarray, s: np.ndarray, features: int, depth: int, stream: np.uint64) -> list[np.ndarray]:
    """Feature, bin, left child (-1: leaf; the right one follows it) and mean of each node, level by level."""
    node = np.zeros(len(cell), dtype=np.int64)
    levels, first_id, k = [], 0, 1
    for level in range(depth + 1):
        weight, total = np.bincount(node, w, k), np.bincount(node, s, k)
        if level < depth:
            feature, split = best_splits(cell, node, w, s, weight, total, features, stream, first_id)
        else:
            feature, split = np.full(k, -1), np.zeros(k, dtype=np.int64)
        inner = feature >= 0
        rank = np.cumsum(inner) - 1
        levels.append([feature, split, np.where(inner, first_id + k + 2 * rank, -1), total / weight])
        first_id, k = first_id + k, 2 * int(inner.sum())
        if not k:
            break
        stays = inner[node]
        cell, w, s, node = cell[stays], w[stays], s[stays], node[stays]
        right = ((cell >> (BITS * feature[node])) & (BINS - 1)) > split[node]
        child = 2 * rank[node] + right
        # The cells are sorted by parent, so those of a child follow each other once left and right ones are counted.
        sizes = np.bincount(child, minlength=k)
        begins = np.cumsum(sizes) - sizes
        rights = np.cumsum(right)
        begin = begins[child - right]
        rights_in = rights - (rights - right)[begin]
        place = np.where(right, begins[child] + rights_in - 1, np.arange(len(cell)) - rights_in)
        moved = np.empty(len(cell), dtype=np.int64)
        moved[place] = np.arange(len(cell))
        cell, w, s, node = cell[moved], w[moved], s[moved], child[moved]
    return [np.concatenate(column) for column in zip(*levels, strict=True)]


def grow_group(samples: pa.Table, features: int, depth: int, seed: int) -> pa.Table:
    """The trees of one group, from the weights and sums of all cells."""
    group = samples.column("grp")[0].as_py()
    cell = samples.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    cells, first = np.unique(cell[order], return_index=True)
    flat = [samples.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1) for c in ("w", "s")]
    grown = []
    for i in range(flat[0].shape[1]):
        tree = group * GROUP_TREES + i
        w, s = (np.add.reduceat(column[order, i].astype(np.float64), first) for column in flat)
        drawn = w > 0
        if not drawn.any():
            continue
        feature, split, child, value = grow_tree(cells[drawn], w[drawn], s[drawn], features, depth, _stream(seed, tree, 1))
        n = len(value)
        ints = [np.full(n, group), np.full(n, tree), np.arange(n), feature, split, child]
        grown.append(pa.table([*[pa.array(c.astype(np.int32)) for c in ints], pa.array(value)], names=["grp", "tree", "node", "feature", "bin", "child", "value"]))
    return pa.concat_tables(grown) if grown else pa.table({c: pa.array([], pa.int32()) for c in ("grp", "tree", "node", "feature", "bin", "child")} | {"value": pa.array([], pa.float64())})


def apply_group(nodes: pa.Table, cells: pa.Table) -> pa.Table:
    """Sum of the predictions of a group's trees for each cell."""
    cell = cells.column("cell").to_numpy()
    tree, node, feature, bin_, child, value = (nodes.column(c).to_numpy() for c in ("tree", "node", "feature", "bin", "child", "value"))
    total = np.zeros(len(cell))
    trees = np.unique(tree)
    for t in trees:
        mine = np.flatnonzero(tree == t)
        at_node = np.empty(len(mine), dtype=np.int64)
        at_node[node[mine]] = mine
        at, open_ = np.zeros(len(cell), dtype=np.int64), np.arange(len(cell))
        while len(open_):
            place = at_node[at[open_]]
            inner = child[place] >= 0
            open_, place = open_[inner], place[inner]
            at[open_] = child[place] + (((cell[open_] >> (BITS * feature[place]).astype(np.int64)) & (BINS - 1)) > bin_[place])
        total += value[at_node[at]]
    counts = pa.array(np.full(len(cell), len(trees), dtype=np.int32))
    return pa.table([pa.array(cell), cells.column("n"), pa.array(total), counts], names=["cell", "n", "total", "trees"])


@dataclass
class TableForest:
    """A forest kept as a table of nodes in the shared folder."""

    columns: list[str]
    points: list[list[float]]
    nodes: DataFrame

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the mean over the trees; equal bins are predicted once."""
        binned = rows.withColumn("_cell", cell_of(self.columns, self.points))
        groups = [r["grp"] for r in self.nodes.select("grp").distinct().collect()]  # one number for each five trees
        cells = binned.groupBy(F.col("_cell").alias("cell")).agg(F.count("*").alias("n"))
        cells = cells.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in groups])))
        parts = 2 * len(groups)
        scored = self.nodes.repartition(parts, "grp").groupBy("grp").cogroup(cells.repartition(parts, "grp").groupBy("grp")).applyInArrow(
            apply_group, "cell bigint, n bigint, total double, trees int"
        )
        means = scored.groupBy(F.col("cell").alias("_cell")).agg(F.max("n").alias("_n"), (F.sum("total") / F.sum("trees")).alias("prediction"))
        means = cut_lineage(means)
        crowded = means.filter(F.col("_n") > CROWDED_CELL)
        hot = binned.join(F.broadcast(crowded), "_cell")
        rest = binned.join(F.broadcast(crowded.select("_cell")), "_cell", "left_anti").join(means, "_cell")
        return hot.unionByName(rest).select(*rows.columns, "prediction")

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        layout = [(i, c, p) for i, (c, p) in enumerate(zip(self.columns, self.points, strict=True))]
        spark.createDataFrame(layout, "i int, feature string, points array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/splits")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TableForest:
        layout = spark.read.parquet(f"{path}/splits").orderBy("i").collect()  # one row per feature
        return TableForest([r["feature"] for r in layout], [list(r["points"]) for r in layout], spark.read.parquet(f"{path}/nodes"))


def fit(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str, trees: int, depth: int, seed: int) -> TableForest:
    """A forest over the rows; its draws follow from keys, target and features, so they are the same for any partitioning."""
    points = split_points(rows, columns)
    endless = F.isnan(label)
    for c in columns:
        endless = endless | (F.abs(F.col(c).cast("double")) == float("inf"))
    y = F.when(endless, F.raise_error(F.lit("NaN target or infinite feature")).cast("double")).otherwise(F.col(label).cast("double"))
    marked = rows.select(cell_of(columns, points).alias("cell"), y.alias("y"), F.xxhash64(*keys, label, *columns).alias("row"))
    # Copies of a row are drawn one by one.
    copies = marked.groupBy("cell", "y", "row").agg(F.count("*").alias("n")).select("cell", "y", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "row")
    drawn = copies.select("cell", "y", F.when(F.col("copy") == 1, F.col("row")).otherwise(F.xxhash64("row", "copy")).alias("row"))
    samples = drawn.mapInArrow(lambda batches: sample_cells(batches, trees, seed), SAMPLES)
    n_features = len(columns)
    groups = -(-trees // GROUP_TREES)
    grown = samples.repartition(2 * groups, "grp").groupBy("grp").applyInArrow(lambda t: grow_group(t, n_features, depth, seed), NODES)
    return TableForest(list(columns), points, cut_lineage(grown))
