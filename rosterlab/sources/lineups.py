"""Lineup and report files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.sources.salaries import csv_header, scan_text_csv

# Columns of a lineup file.
LINEUP_FILE_COLUMNS = ["name", "pos", "team", "salary", "proj_points", "lineup_k"]


ROWS_PER_FILE = 1_000_000


def scan_lineup_files(
    spark: SparkSession, pattern: str, columns: Sequence[str] = LINEUP_FILE_COLUMNS, number: str = r"lineup_(\d+)", part: str = "file_name"
) -> DataFrame:
    """All matching lineup files as one table; the number in the file name (or path) is the lineup id."""
    files = scan_text_csv(spark, pattern, columns)
    place = F.col(f"_metadata.{part}")
    return files.select(
        F.regexp_extract(place, number, 1).try_cast("bigint").alias("lineup"),
        F.col("_metadata.file_name").alias("file_name"),
        *[F.col(c).try_cast("double").alias(c) if c in ("salary", "proj_points") else F.col(c) for c in columns],
    )


def scan_lineup_table(spark: SparkSession, path: str) -> DataFrame:
    """One CSV holding many lineups, all columns text."""
    return scan_text_csv(spark, path, csv_header(spark, path))


def write_lineups(lineups: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("slate_id",)) -> None:
    """One directory per slate; a slate's lineups share files of about ROWS_PER_FILE rows instead of taking one file each.

    Rows are first brought together by slate and a salt drawn from the slate's row count, so a task writes few files and a
    large slate is written by many tasks.
    """
    counts = lineups.groupBy(*[F.col(c).alias(f"_{c}") for c in partition_by]).agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("_files"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition_by])
    rest = [c for c in lineups.columns if c not in partition_by]
    salted = lineups.join(counts, same).select(*lineups.columns, F.pmod(F.xxhash64(*rest), "_files").alias("_salt"))
    writer = salted.repartition(*partition_by, "_salt").drop("_salt").write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Tabular reports as header CSV, the ones with nested columns as JSON lines."""
    written = {}
    for name, report in reports.items():
        nested = any(f.dataType.typeName() in ("struct", "map", "array") for f in report.schema.fields)
        target = f"{path.rstrip('/')}/{name}"
        writer = report.write.mode("overwrite")
        writer.json(target) if nested else writer.option("header", True).csv(target)
        written[name] = target
    return written
