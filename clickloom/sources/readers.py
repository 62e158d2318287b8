"""Reading tables: scans, projections, SQL over files and file-order row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from clickloom.state import settle

MOST_FILES = 1_000_000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Deferred parquet scan; filters and column choices made later reach the file reader."""
    return spark.read.parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files: inference costs one more full read."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def sql_over(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run SQL whose ``{name}`` placeholders stand for the given tables."""
    return spark.sql(text, **tables)


def with_row_index(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    """Parquet rows with their global position: files in path order, then position in the file.

    The position inside a file comes from the reader, so no row is sorted or moved: only the
    per-file row counts pass through a window, and they reach the rows as a broadcast of two
    numbers per file. Beyond a million files the counts are joined by path instead.
    """
    rows = spark.read.parquet(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_pos"),
    )
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        sizes.select(
            "_file", F.xxhash64("_file").alias("_key"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        ),
        "file_starts",
    )
    files, keys = starts.agg(F.count(F.lit(1)), F.count_distinct("_key")).first()
    if files == keys and files <= MOST_FILES:
        placed = rows.withColumn("_key", F.xxhash64("_file")).join(
            F.broadcast(starts.select("_key", "_start")), "_key"
        )
    else:
        placed = rows.join(starts, "_file")
    return placed.withColumn(name, F.col("_start") + F.col("_pos")).drop("_file", "_key", "_pos", "_start")
