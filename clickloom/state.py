"""Durable intermediate tables.

A fitted table (category counts, encodings, cut points, model weights) is read by several later
steps. Writing it once to the shared checkpoint folder cuts the lineage, survives the loss of
executors, and gives the optimizer the true size of the table for its join choices.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def state_dir(spark: SparkSession) -> str:
    """Folder for durable tables: the session's ``spark.checkpoint.dir`` if the cluster names one.

    Only a local master may fall back to a temporary folder, since executors elsewhere could
    not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="clickloom-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the state folder."""
    return f"{state_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once in ``buckets`` files by a hash of ``keys``, sorted by them, as an external table.

    A later join by ``keys`` reads the buckets as they lie: only the other side is shuffled. One file per
    bucket, since the rows are dealt out by the same hash first. Choose ``buckets`` so that a bucket fits
    a task; ``open_bucketed`` gives the table to another session.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return spark.table(table)


def open_bucketed(spark: SparkSession, path: str, ddl: str, keys: Sequence[str], buckets: int, name: str = "table") -> DataFrame:
    """A folder written by ``settle_bucketed`` as a table of this session; ``ddl`` names its columns and types."""
    table, by = f"{name}_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
