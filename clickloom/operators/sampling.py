"""Repeatable samples, folds and splits, all driven by a hash of a unique row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash60
from clickloom.operators.joins import BROADCAST_ROWS, lookup_join, lookup_size
from clickloom.operators.ranking import (
    even_folds, exact_quantiles, hash_edges, hash_spot, keep_first_by_hash,
)
from clickloom.state import settle

PARTS = 1_000_000


def bernoulli(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """Each row is kept with the given chance: a plain filter, nothing is moved."""
    return df.where(F.pmod(hash60(F.col(id_col), seed), F.lit(PARTS)) < int(fraction * PARTS))


def fixed_size(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer)."""
    quota = df.sparkSession.range(1).select(F.lit(n).alias("need"))
    return keep_first_by_hash(df, id_col, quota, seed=seed)


def exact_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """The rows whose place in the random order lies below ``rows * fraction``."""
    quota = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("need"))
    return keep_first_by_hash(df, id_col, quota, seed=seed)


def capped_per_class(df: DataFrame, id_col: str, label: str, fraction: float, seed: int = 42) -> DataFrame:
    """At most ``all rows * fraction`` rows of each class, so a smaller class is kept whole."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.ceil(F.sum("_n") * F.lit(fraction)).alias("need"))
    quotas = sizes.crossJoin(F.broadcast(total)).select(label, "need")
    return keep_first_by_hash(df, id_col, quotas, [label], seed)


def downsample_negatives(
    df: DataFrame, id_col: str, label: str, ratio: float = 2.0, pool: Column | None = None, seed: int = 42
) -> DataFrame:
    """All positives and ``ratio`` times as many negatives, the negatives only from ``pool``."""
    negatives = df.where(F.col(label) == 0)
    if pool is not None:
        negatives = negatives.where(pool)
    positives = df.where(F.col(label) == 1)
    quota = positives.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("need"))
    return positives.unionByName(keep_first_by_hash(negatives, id_col, quota, seed=seed))


def smoke_sample(df: DataFrame, id_col: str, label: str, most: int = 400_000, seed: int = 42) -> DataFrame:
    """Positives and as many negatives, then at most ``most`` rows of both."""
    return fixed_size(downsample_negatives(df, id_col, label, 1.0, seed=seed), id_col, most, seed + 1)


def in_pool(id_col: str, mod: int = 10, rem: int = 0, bucket=None) -> Column:
    """Is the row in the hash pool; ``bucket`` may supply another hash of (column, mod)."""
    col = F.col(id_col)
    slot = bucket(col, mod) if bucket else F.pmod(hash60(col), F.lit(mod))
    return slot == rem


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold``; within each class fold sizes differ by at most one row."""
    return even_folds(df, id_col, k, [label], seed)


def hash_folds(id_col: str, k: int, seed: int = 42) -> Column:
    """Fold by hash alone: classes are balanced only on average, in one projection."""
    return F.pmod(hash60(F.col(id_col), seed), F.lit(k)).cast("int")


def time_blocks(df: DataFrame, time_col: str, blocks: int, out: str = "block") -> DataFrame:
    """Add the time block of each row: block edges are exact quantiles of the time.

    Rows with the same time always share a block.
    """
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    edges = exact_quantiles(
        df.select(micros.alias("_t")), "_t", [i / blocks for i in range(1, blocks)], method="nearest"
    )
    passed = F.lit(0)
    for i in range(blocks - 1):
        passed = passed + (micros >= F.col(f"q{i}")).cast("int")
    return df.crossJoin(F.broadcast(edges)).select(*df.columns, passed.alias(out))


def expanding_splits(df: DataFrame, time_col: str, splits: int) -> DataFrame:
    """One copy of the rows per split: train on all earlier blocks, validate on the next one."""
    blocks = time_blocks(df, time_col, splits + 1)
    each = F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("split")
    return (
        blocks.select("*", each)
        .where(F.col("block") <= F.col("split"))
        .withColumn("part", F.when(F.col("block") == F.col("split"), "valid").otherwise("train"))
    )


def last_holdout(df: DataFrame, time_col: str, share: float = 0.2) -> DataFrame:
    """Add ``is_valid``: the latest share of the rows."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    edge = exact_quantiles(df.select(micros.alias("_t")), "_t", [1 - share], method="nearest")
    return df.crossJoin(F.broadcast(edge)).select(*df.columns, (micros >= F.col("q0")).cast("int").alias("is_valid"))


def per_key_cap(df: DataFrame, id_col: str, keys: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """Rows of every group, large groups sampled down to ``most`` rows (segment training data).

    Rows without a key are kept. Any number of groups may be large: their cut points are looked up
    like any fitted table.
    """
    keys = list(keys)
    sizes = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = settle(sizes.where(F.col("_n") > most), "large_groups")
    quotas = large.select(*keys, F.lit(0).alias("place"), F.lit(most).cast("bigint").alias("need"))
    few = lookup_size(large) <= BROADCAST_ROWS
    edges = hash_edges(df, id_col, quotas, keys, seed, few).select(*keys, "_edge")
    cuts = settle(edges.join(large, keys), "cuts")
    kept = F.col("_n").isNull() | (hash_spot(id_col, seed) <= F.col("_edge"))
    return lookup_join(df, cuts, keys, "_n", [id_col]).where(kept).select(*df.columns)
