"""Two-pass external shuffle of a table into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterlab.llm import common as C

SHARDS, SEED = 24, 20_240_601
#: Bytes of text and rows that one bucket holds on average at most: what a task keeps in memory for the second pass.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 1 << 16


def scattered(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """The rows of df with `_bucket`, written once, and the number of buckets: a seeded hash of the key, the text and the row's number.

    The number spreads rows that are alike over all buckets; it is written with the row, so a task run again finds the same.
    """
    rows = C.staged(df.withColumn("_row", F.monotonically_increasing_id()))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-total // bucket_bytes), -(-count // bucket_rows))
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), key, text, "_row"), F.lit(n)).cast("int")), n


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of df in random order over `shards` shards: adds `shard` and `slot`, keeps every other column.

    Pass one scatters rows to buckets of bounded size by a seeded hash of the key, the text and the row's
    place in the table; pass two makes each bucket a partition of its own, puts it into a fixed order and applies Spark's seeded
    Fisher-Yates `shuffle` to it, whose draws follow from the seed and the partition, hence the bucket.  The rows of all buckets, one bucket after
    another, are dealt to the shards in turn, so row counts differ by one at most and slots run from 0 without gaps.
    A null key or text is a value like any other; an empty table has no rows; rows that are alike are spread over the
    buckets like others.  The result follows from the seed and the places of the rows as they are read (file and split),
    not from the number of shuffle partitions or the order in which tasks run.
    Columns must be orderable (no maps).  Existing columns `shard` and `slot` are replaced.
    """
    df = df.drop("shard", "slot")
    names = df.columns
    df, buckets = scattered(df, key, text, seed, bucket_bytes)

    counts = df.groupBy("_bucket").agg(F.count("*").alias("n")).withColumn("hi", F.expr("_bucket div 1024"))
    inner = Window.partitionBy("hi").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("hi").agg(F.sum("n").alias("t")).select("hi", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("base"))
    before = counts.withColumn("in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, "hi").select("_bucket", (F.col("base") + F.col("in")).alias("_before"))

    # a fixed order first, and one bucket a partition: its draws are the generator's first ones, whenever it is computed
    rows = df.select("_bucket", F.struct(F.xxhash64(F.lit(seed + 1), key, "_row").alias("h"), "_row", F.struct(*names).alias("row")).alias("_r"))
    # what stands before a bucket travels with its rows, which spares a join and its shuffle
    rows = rows.withColumn("_before", F.lit(None).cast("long"))
    rows = rows.union(before.select("_bucket", F.lit(None).cast(rows.schema["_r"].dataType), "_before"))
    dealt = rows.repartitionById(buckets, "_bucket").groupBy("_bucket")
    dealt = dealt.agg(F.shuffle(F.sort_array(F.collect_list("_r")), seed).alias("_rows"), F.max("_before").alias("_before"))
    placed = dealt.select("_before", F.posexplode("_rows").alias("_at", "_r"))
    at = F.col("_before") + F.col("_at")
    return placed.select("_r.row.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.expr(f"(_before + _at) div {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffles df and writes each shard to its own folder of `path`, rows in order of their slots within a bucket's file."""
    external_shuffle(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(C.table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
