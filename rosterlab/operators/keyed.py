"""Keyed building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key.  The rank limit is applied before the shuffle too, so a hot key sends n rows per task."""
    rank_column = rank or "_rank"
    ranked = df.withColumn(rank_column, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank_column) <= n)
    return kept if rank else kept.drop(rank_column)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write wins: the row that comes first in the given (descending) order."""
    return top_per_key(df, keys, order, 1)


def running_number(df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """1-based position of each row within its key by a unique whole-number column.

    The key is cut into ranges of ``width`` ids: rows are numbered inside a range, and the ranges' row counts give
    the offset, so no task ever holds a whole key.
    """
    chunked = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = chunked.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order))
    numbered = chunked.withColumn("_within", within).join(offsets, [*keys, "_range"])
    return numbered.withColumn(name, (F.col("_offset") + F.col("_within")).cast("bigint")).drop(
        "_range", "_offset", "_within"
    )


def hashed_number(df: DataFrame, text_key: str, name: str) -> DataFrame:
    """1-based position of each row by the digest of a unique text column.

    Numbering runs inside 4096 digest buckets of near-equal size; the bucket offsets are a table of at most 4096 rows.
    """
    hashed = df.withColumn("_digest", F.md5(F.col(text_key))).withColumn("_bucket", F.substring("_digest", 1, 3))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy("_bucket").orderBy("_digest", text_key))
    numbered = hashed.withColumn("_within", within).join(offsets, "_bucket")
    return numbered.withColumn(name, (F.col("_offset") + F.col("_within")).cast("bigint")).drop(
        "_digest", "_bucket", "_offset", "_within"
    )
