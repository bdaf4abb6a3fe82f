"""Centroid clustering of whole-number vectors, with distances filtered by a PCA rotation.

Every kept vector is stored once with its leading rotated coordinates and the norm of what is left.  For a vector x and a
centroid c, the squared distance of the leading coordinates plus the squared difference of the two residual norms is never
more than the squared distance.  So a round takes the centroid with the least such bound, computes that one distance in
whole numbers, and verifies in whole numbers only the centroids whose bound does not exceed it.  The rotation decides how
many survive, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import common as C

K, ROUNDS, SCALE, SEED, WIDTH, LEAD = 40, 5, 256, 2, 64, 12
#: Largest absolute component whose squared distances fit a long integer at every allowed width.
LARGEST = 1 << 25
#: Widest vectors; bounds the covariance matrix.
WIDEST = 1024
#: Slack of the bound for rounding, relative to the squared norms; far above what double precision loses.
SLACK = 1e-9
STEP = 4096


def _matrix(column: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def whole_vectors(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, v): vectors of exactly `width` finite components as floor(scale * x); the others are left out.

    A component beyond LARGEST is left out with its vector: its squared distances would not fit the result's long integers.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * scale <= float(LARGEST)))
    good = df.where(F.coalesce((F.size(x) == width) & finite, F.lit(False)))
    return good.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose id hashes lowest; rows of one id are ordered by their components, rows without an id never drawn."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the vectors, strongest first; from sums of products that tasks gather and Spark adds up."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            m = _matrix(batch.column("v"), width, np.float64)
            m = np.column_stack([np.ones(len(m)), m])
            total += m.T @ m
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], ["at", "x"])

    sums = np.zeros((width + 1) ** 2)
    for r in vectors.select("v").mapInArrow(moments, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        sums[r["at"]] = r["x"]
    sums = sums.reshape(width + 1, width + 1)
    mean = sums[0, 1:] / max(sums[0, 0], 1)
    _, axes = np.linalg.eigh(sums[1:, 1:] / max(sums[0, 0], 1) - np.outer(mean, mean))
    return axes[:, ::-1]


def rotated(vectors: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of the other ones."""
    m = vectors @ axes
    return m[:, :lead], np.sqrt((m[:, lead:] ** 2).sum(1))


class Nearest:
    """Exact nearest centroids of whole-number vectors; equal distances go to the smaller number."""

    def __init__(self, centroids: np.ndarray, axes: np.ndarray, lead: int):
        self.c = centroids
        self.lead, self.rest = rotated(centroids.astype(np.float64), axes, lead)
        self.norm = (self.lead**2).sum(1) + self.rest**2
        self.verified = 0

    def __call__(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = (lead**2).sum(1) + rest**2
        bound = norm[:, None] + self.norm - 2 * (lead @ self.lead.T) - 2 * rest[:, None] * self.rest
        best = bound.argmin(1)
        distance = ((v - self.c[best]) ** 2).sum(1)
        slack = SLACK * (norm[:, None] + self.norm + 1)
        open_ = bound - slack <= distance[:, None]
        open_[np.arange(len(v)), best] = False
        for c in np.flatnonzero(open_.any(0)):
            rows = np.flatnonzero(open_[:, c])
            self.verified += len(rows)
            d = ((v[rows] - self.c[c]) ** 2).sum(1)
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
            best[rows[nearer]], distance[rows[nearer]] = c, d[nearer]
        return best, distance


def _stored(axes: np.ndarray, width: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, rest = rotated(_matrix(batch.column("v"), width, np.float64), axes, lead)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * lead), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), near, pa.array(rest)], ["id", "v", "lead", "rest"])

    return run


def _assigned(batch: pa.RecordBatch, nearest: Nearest, width: int, lead: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        v = _matrix(part.column("v"), width, np.int64)
        yield part, v, *nearest(v, _matrix(part.column("lead"), lead, np.float64), part.column("rest").to_numpy())


def _sums(centroids: np.ndarray, axes: np.ndarray, width: int, lead: int):
    """Per task and centroid: how many vectors are nearest to it, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, k = Nearest(centroids, axes, lead), len(centroids)
        for batch in batches:
            total = np.zeros((k, width + 1), np.int64)
            for _, v, best, _ in _assigned(batch, nearest, width, lead):
                np.add.at(total, best, np.column_stack([np.ones(len(v), np.int64), v]))
            used = np.flatnonzero(total[:, 0])
            names = [np.repeat(used, width + 1), np.tile(np.arange(width + 1), len(used)), total[used].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(names[0], pa.int32()), pa.array(names[1], pa.int32()), pa.array(names[2], pa.int64())], ["c", "at", "x"])

    return run


def _labels(centroids: np.ndarray, axes: np.ndarray, width: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, axes, lead)
        for batch in batches:
            for part, _, best, distance in _assigned(batch, nearest, width, lead):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE,
    width: int = WIDTH, seed: int = SEED, lead: int = LEAD,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every kept vector after `rounds` rounds, and the final centroids as whole numbers.

    Kept are vectors of exactly `width` components, none null or non-finite; see `whole_vectors`.  Rows that repeat count as
    often as they occur, a row without a key is clustered but never a first centroid, and with fewer than k keyed vectors
    there are fewer centroids; without any there are no rows.  A round sends one row per task, centroid and component.
    Other columns of df are not read.
    """
    if not 0 < lead <= width <= WIDEST:
        raise ValueError("lead and width must satisfy 0 < lead <= width <= WIDEST")
    C.importable(df.sparkSession)
    vectors = C.staged(whole_vectors(df, key, vector, width, scale))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.selectExpr(f"id AS `{key}`", "0 AS cluster", "0L AS distance").where("false"), centroids.reshape(0, width)
    axes = rotation(vectors, width)
    stored = C.staged(vectors.mapInArrow(_stored(axes, width, lead), "id long, v array<long>, lead array<double>, rest double"))
    C.release(vectors)
    for _ in range(rounds):
        parts = stored.mapInArrow(_sums(centroids, axes, width, lead), "c int, at int, x long")
        total = {(r["c"], r["at"]): int(r["x"]) for r in parts.groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
        for c in {c for c, _ in total}:
            centroids[c] = [total[c, i] // total[c, 0] for i in range(1, width + 1)]
    out = C.staged(stored.mapInArrow(_labels(centroids, axes, width, lead), "id long, cluster int, distance long").withColumnRenamed("id", key))
    C.release(stored)
    return out, centroids


def with_inertia(labels: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of `cluster` with the distances summed over their cluster and over all, and a hash of their centroid.

    A sum that no long integer holds is null.
    """
    spark = labels.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole, fits = sum(sums.values()), lambda x: x if x < 1 << 63 else None
    named = [(c, fits(s), fits(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(table), "cluster")  # one row a centroid


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_inertia(*cluster(C.table(spark, sf_dir, "embeddings")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same rounds as one chain of common table expressions."""
    seed = f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS w FROM (
  SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {K})"""
    near = """a{i} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT n, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM (SELECT row_number() OVER () AS n, vec_id, v FROM kept), c{i}) GROUP BY n, vec_id, v)"""
    moved = """c{j} AS MATERIALIZED (SELECT c, coalesce(m, w) AS w FROM c{i} LEFT JOIN (
  SELECT c, list(CAST(floor_sum AS BIGINT) ORDER BY k) AS m FROM (
    SELECT c, k, CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS floor_sum
    FROM (SELECT best.c AS c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY best.c, k)) GROUP BY c) USING (c))"""
    steps = [seed]
    for i in range(ROUNDS):
        steps += [near.format(i=i), moved.format(i=i, j=i + 1)]
    steps.append(near.format(i=ROUNDS))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON best.c = c{ROUNDS}.c"""


ORACLE = _sql()
