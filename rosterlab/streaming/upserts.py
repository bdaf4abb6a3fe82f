"""The bulk upserts applied to a stream of batches, as a bucketed log of changes.

Layout below one path (a table row's bucket is the hash of its key):

* ``base/batch=M/bucket=B``     all rows of a bucket as of batch M (the table before the first batch is M = -1)
* ``changes/batch=N/bucket=B``  the rows that batch N added or replaced
* ``state/batch=N``             one row per bucket: its base, the batch up to which the base is current, row counts
* ``settings``                  the key and the row schema

A batch reads the buckets its keys fall into and writes only rows it changed, so what it writes follows the batch's size.
A bucket is compacted, its base written anew, once its changes are half as many as its base's rows or a hundred batches old,
which keeps the rewritten rows in proportion to the changed ones.  State is written last and every folder is named after its
batch: a batch that is run again after a failure starts from its predecessor's state and gives the same result.

Folders that no state in use names any more (bases replaced, changes up to the oldest settled batch) can be removed at any
time; nothing here removes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rosterlab.operators.keyed import latest_per_key

Merge = Callable[..., DataFrame]
STATE = "bucket int, base long, settled long, base_rows long, change_rows long, last_number long"
STATE_NAMES = [column.split()[0] for column in STATE.split(", ")]
#: Batches after which the changes of a bucket are taken into its base whatever their number.
OLDEST = 100


def _bucket(rows: DataFrame, settings) -> Column:
    """The bucket of a row's key; rows that never conflict are spread by all their columns."""
    of_key = F.pmod(F.xxhash64(*settings["keys"]), F.lit(settings.buckets))
    if settings.free is None:
        return of_key.cast("int").alias("bucket")
    of_row = F.pmod(F.xxhash64(*rows.columns), F.lit(settings.buckets))
    return F.when(F.expr(settings.free), of_row).otherwise(of_key).cast("int").alias("bucket")


def _write(rows: DataFrame, settings, path: str) -> None:
    rows.select("*", _bucket(rows, settings)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _settings(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/settings").first()


def _row_schema(settings) -> StructType:
    return StructType.fromJson(json.loads(settings.row_schema))


def _state(spark: SparkSession, path: str, batch_id: int) -> list:
    """One row per bucket, a fixed number."""
    return spark.read.schema(STATE).parquet(f"{path}/state/batch={batch_id}").collect()


def _rows(spark: SparkSession, path: str, settings, state: list, batch_id: int, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets as of a batch: of each key the youngest, and all rows that never conflict."""
    schema = _row_schema(settings)
    chosen = [s for s in state if s.bucket in set(buckets)]
    stored = StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])

    def read(kind: str, batches: Sequence[int]) -> DataFrame:
        return spark.read.schema(stored).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={n}" for n in batches])

    bases = sorted({s.base for s in chosen})
    if not bases:
        return spark.createDataFrame([], schema)
    place = F.concat_ws("/", "batch", "bucket")
    rows = read("base", bases).filter(place.isin([f"{s.base}/{s.bucket}" for s in chosen]))
    changed = [s for s in chosen if s.change_rows]
    if changed:
        since = F.create_map(*[F.lit(x) for s in changed for x in (s.bucket, s.settled)])
        young = F.col("batch") > F.try_element_at(since, F.col("bucket"))
        rows = rows.unionByName(read("changes", range(min(s.settled for s in changed) + 1, batch_id + 1)).filter(young))
    if settings.free is None:
        return latest_per_key(rows, settings["keys"], [F.col("batch").desc()]).select(*schema.names)
    free = F.coalesce(F.expr(settings.free), F.lit(False))
    latest = latest_per_key(rows.filter(~free), settings["keys"], [F.col("batch").desc()])
    return latest.unionByName(rows.filter(free)).select(*schema.names)


def read_version(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The whole table as of a batch; batch -1 is the table before the first one."""
    path = path.rstrip("/")
    state = _state(spark, path, batch_id)
    return _rows(spark, path, _settings(spark, path), state, batch_id, [s.bucket for s in state])


def create_log(start: DataFrame, path: str, keys: Sequence[str], free: str | None = None, number: str | None = None, buckets: int = 64) -> None:
    """Write the table before the first batch.

    Rows for which the condition ``free`` holds never conflict with others.  ``number`` names a column of running ids;
    its highest value is handed to the merge as ``last_id``, because a merge sees only a part of the table.
    """
    spark, path = start.sparkSession, path.rstrip("/")
    row = [([*keys], free, number, buckets, start.schema.json())]
    spark.createDataFrame(row, "keys array<string>, free string, number string, buckets int, row_schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    settings = _settings(spark, path)
    _write(start, settings, f"{path}/base/batch=-1")
    sizes = _sizes(spark, f"{path}/base/batch=-1", settings)
    last = max([n for _, n in sizes.values() if n is not None], default=0)
    _publish(spark, path, -1, [(b, -1, -1, sizes.get(b, (0, None))[0], 0, last) for b in range(buckets)])


def _sizes(spark: SparkSession, path: str, settings) -> dict[int, tuple[int, int | None]]:
    """Rows and highest number per bucket of one folder, read back from what was written."""
    schema = StructType([*_row_schema(settings).fields, StructField("bucket", IntegerType())])
    number = F.max(settings.number).cast("long") if settings.number else F.lit(None).cast("long")
    found = spark.read.schema(schema).parquet(path).groupBy("bucket").agg(F.count("*").alias("n"), number.alias("last"))
    return {r.bucket: (r.n, r["last"]) for r in found.collect()}


def _publish(spark: SparkSession, path: str, batch_id: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")


def apply_batch(batch: DataFrame, batch_id: int, path: str, merge: Merge) -> None:
    """Merge one batch of update rows into the log."""
    spark, path = batch.sparkSession, path.rstrip("/")
    settings, before = _settings(spark, path), _state(spark, path, batch_id - 1)
    asked = batch.select(*settings["keys"], _bucket(batch, settings)).distinct()
    touched = [r.bucket for r in asked.select("bucket").distinct().collect()]
    current = _rows(spark, path, settings, before, batch_id - 1, touched)
    if settings.free is not None:
        current = current.filter(~F.coalesce(F.expr(settings.free), F.lit(False)))
    wanted = asked.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(settings["keys"])]).distinct()
    same = F.lit(True)
    for i, k in enumerate(settings["keys"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    current = current.join(wanted, same, "left_semi")
    last = max((s.last_number for s in before), default=0)
    changes = merge(current, batch, last_id=last) if settings.number else merge(current, batch)
    names = _row_schema(settings).names
    _write(changes.select(*names), settings, f"{path}/changes/batch={batch_id}")

    new = _sizes(spark, f"{path}/changes/batch={batch_id}", settings)
    last = max([last, *[n for _, n in new.values() if n is not None]])
    state = {}
    for s in before:
        pending = s.change_rows + new.get(s.bucket, (0, None))[0]
        # A bucket without changes is settled as it is.
        state[s.bucket] = [s.bucket, s.base, s.settled if pending else batch_id, s.base_rows, pending, last]
    due = [b for b, (_, _, settled, base_rows, pending, _) in state.items() if 2 * pending > base_rows or (pending and batch_id - settled >= OLDEST)]
    if due:
        now = [Row(**dict(zip(STATE_NAMES, s, strict=True))) for s in state.values()]
        _write(_rows(spark, path, settings, now, batch_id, due), settings, f"{path}/base/batch={batch_id}")
        sizes = _sizes(spark, f"{path}/base/batch={batch_id}", settings)
        for b in due:
            state[b] = [b, batch_id, batch_id, sizes.get(b, (0, None))[0], 0, last]
    _publish(spark, path, batch_id, [tuple(s) for s in state.values()])


def merge_stream(
    updates: DataFrame, start: DataFrame, path: str, checkpoint: str, merge: Merge, keys: Sequence[str], free: str | None = None,
    number: str | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Fold a stream of update rows into a log with one of the bulk upserts.

    ``start`` is the table before the first batch; the folder's own log goes on where there is one already.
    """
    spark = start.sparkSession
    if not _has_log(spark, path):
        create_log(start, path, keys, free, number, buckets)
    return (
        updates.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, path, merge))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _has_log(spark: SparkSession, path: str) -> bool:
    """Whether the log's first state, which is written after everything else of the start, is there."""
    try:
        spark.read.schema(STATE).parquet(f"{path.rstrip('/')}/state/batch=-1").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
