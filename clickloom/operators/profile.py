"""Profiles and plot tables: counts, click rates, distributions, histograms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.joins import cross_one
from clickloom.operators.ranking import exact_quantiles


def distinct_with_null(col: str) -> Column:
    """Number of distinct values, null counted as one value."""
    return F.count_distinct(col) + F.max(F.col(col).isNull().cast("int"))


def click_rate(df: DataFrame, keys: Sequence[str], label: str = "clicked") -> DataFrame:
    """Rows and mean label per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("ctr"))


def target_share(df: DataFrame, label: str = "clicked") -> DataFrame:
    """Rows and share of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return cross_one(counts, total).select(label, "n", (F.col("n") / F.col("total")).alias("share"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "nulls")


def cardinality(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct values per column, null counted as one, largest first.

    Exact: (column, value) pairs are made unique before they are counted, so no task holds the
    values of a column. ``exact=False`` uses one sketch per column and one pass.
    """
    if not exact:
        one = df.agg(
            *[(F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
        )
        return one.unpivot([], list(columns), "column", "distinct").orderBy(F.desc("distinct"), "column")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    ).alias("_p")
    unique = df.select(pairs).select("_p.column", "_p.value").distinct()
    return (
        unique.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        .orderBy(F.desc("distinct"), "column")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, deviation, minimum, quartiles and maximum of numeric columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "x"
    )
    moments = long.groupBy("column").agg(
        F.count("x").alias("n"),
        F.count_if(F.col("x").isNull()).alias("nulls"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["column"], "nearest")
    named = quartiles.select(
        "column", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75")
    )
    return moments.join(F.broadcast(named), "column", "left")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    return (
        cross_one(x, ends)
        .groupBy(F.coalesce(slot, F.lit(0)).cast("int").alias("bin"), (F.col("lo")), width.alias("width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "n")
    )


def density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid that reaches ``cut`` bandwidths past the data.

    The bandwidth is the deviation times n^(-1/5). Equal values are counted first; a task adds the kernels of
    its values to the grid points in their reach, as arrays, and hands on one row per grid point. Without
    any spread (fewer than two different values) the density is null.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    facts = values.agg(
        F.count("x").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.nullif(F.stddev_samp("x") * F.pow(F.count("x"), F.lit(-0.2)), F.lit(0.0)).alias("h"),
    )
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)
    placed = facts.select("rows", "h", (F.col("lo") - cut * F.col("h")).alias("start"), step.alias("step"))
    known = cross_one(counts, placed).where("h IS NOT NULL").select("x", "n", "h", "start", "step")
    sums = known.mapInArrow(_kernel_sums(points), "point int, kernels double").groupBy("point").agg(F.sum("kernels").alias("kernels"))
    grid = cross_one(df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")), placed)
    scale = F.col("rows") * F.col("h") * math.sqrt(2 * math.pi)
    return grid.join(F.broadcast(sums), "point", "left").select(
        "point", (F.col("start") + F.col("point") * F.col("step")).alias("x_at"), (F.coalesce("kernels", F.lit(0.0)) / scale).alias("density")
    )


#: Bandwidths beyond which a kernel adds nothing to a sum of doubles.
REACH = 9.0


def _kernel_sums(points: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(points)
        for b in batches:
            x, n, h, start, step = (b.column(c).to_numpy() for c in ("x", "n", "h", "start", "step"))
            if not len(x):
                continue
            reach = min(points, math.ceil(REACH * h[0] / step[0]) + 1)
            near = np.rint((x - start) / step).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
            kernels = n[:, None] * np.exp(-0.5 * ((start[0] + near * step[0] - x[:, None]) / h[0]) ** 2)
            there = (near >= 0) & (near < points)
            total += np.bincount(near[there], kernels[there], points)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], ["point", "kernels"])

    return run


def class_ratio(df: DataFrame, label: str = "clicked") -> DataFrame:
    """Negatives per positive, the usual positive class weight; at least 1 of each is assumed."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg((F.greatest(negatives, F.lit(1)) / F.greatest(positives, F.lit(1))).alias("ratio"))
