"""Tables, row identity and joins shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.state import settle

#: A key holding at least this share of all rows is hot; there are at most 1 / share such keys.
HOT_SHARE = 1 / 512
#: Rows of hot keys, and rows whose key is null, are spread over this many sub-keys.
SALTS = 512
#: Characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; other columns cannot clash."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """What tells one row from another: id and text. Rows equal in both get equal results."""
    return F.xxhash64(doc_id, text)


def hot_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], count: str, spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a large ``table`` with one row per key to ``rows`` without a hot key meeting in one task.

    ``count`` is the table's column with the number of ``rows`` of each key. Keys holding at least
    ``HOT_SHARE`` of them, at most 512, are broadcast; their rows then bypass the shuffle by key.
    ``how`` is inner or left; the count column is dropped.
    """
    on = list(on)
    values = [c for c in table.columns if c not in on and c != count]
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) >= max(2, total * HOT_SHARE)
    hot = table.where(is_hot).select(*on, F.struct(F.lit(True).alias("_in"), *values).alias("_hot"))
    cold = table.where(~is_hot).select(
        *on, (F.xxhash64(*on) * 0).cast("int").alias("_salt"), F.struct(F.lit(True).alias("_in"), *values).alias("_cold")
    )
    null_key = F.lit(False)
    for c in on:
        null_key = null_key | F.col(c).isNull()
    salt = F.when(F.col("_hot").isNotNull() | null_key, F.pmod(F.xxhash64(*spread), F.lit(SALTS)) + 1).otherwise(0)
    found = F.coalesce("_hot", "_cold")
    joined = (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", salt.cast("int"))
        .join(cold, [*on, "_salt"], "left")
    )
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``_rank`` (from 0, along ``order`` within ``group``), ``_total`` (rows of the group) and ``_part``.

    ``group`` must not be null. Rows are split into ranges of (group, order), so a group that holds most
    rows spreads over many tasks; what the ranges before hold of a group is one row per range and group.
    The ranges are written once: their borders are drawn anew whenever they are computed.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    fixed = settle(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name
    )
    runs = fixed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "_part", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_total"),
    )
    return fixed.join(starts, ["_part", group]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("_rank"), "_total", "_part"
    )
