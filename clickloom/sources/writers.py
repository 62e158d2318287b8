"""Writing tables: parquet, CSV, one folder per group, reports, run logs, skip-if-done stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Compressed parquet, one file per task."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_group(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """One folder per key combination; rows with a null key belong to no group.

    Rows are rebalanced by key first: adaptive execution then merges small groups into few files
    and splits a group that holds a large share of the rows over many tasks.
    """
    present = df.dropna(subset=list(keys)).hint("rebalance", *keys)
    present.write.mode("overwrite").option("header", True).partitionBy(*keys).format(fmt).save(path)


def write_report(df: DataFrame, path: str, title: str) -> None:
    """A text report: a title line, then one line per row of a small profile table."""
    line = F.concat_ws(": ", *[F.col(c).cast("string") for c in df.columns])
    body = df.select(line.alias("value"))
    head = df.sparkSession.createDataFrame([(title,)], "value string")
    head.union(body).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> DataFrame:
    """Append run metrics to a growing log table and return the whole log."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """Return the table at ``path``, building it only when absent; the flag tells if it was built.

    A table is there if its writer finished (``_SUCCESS``); a folder without that mark is what a job
    cut short left, and is built anew. Any other trouble in reading is raised.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path), False
    write_parquet(build(), path)
    return spark.read.parquet(path), True
