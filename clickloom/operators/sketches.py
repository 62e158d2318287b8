"""Distinct counts and quantiles from sketches that are stored per part of the data and merged.

A day's rows are read once; later questions about any set of days merge a few kilobytes per day and
column. Distinct counts come from HyperLogLog sketches, quantiles from KLL sketches, both of Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HLL buckets (2**12: one standard error is 1.6 %) and KLL size (400: ranks are off by about 0.8 %).
HLL_LOG2, KLL_SIZE = 12, 400
#: Stated bounds: relative error of a distinct count, and error of a quantile's rank.
COUNT_ERROR, RANK_ERROR = 0.06, 0.02


def sketch_parts(df: DataFrame, part: Column, cats: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(part, column, rows, hll, kll): one row per part and column, all columns in one pass.

    Nulls are left out of both sketches; a category column has no ``kll`` and a number column no ``hll``.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_LOG2)).alias(f"s{i}") for i, c in enumerate(cats)]
    aggs += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_SIZE)).alias(f"q{i}") for i, c in enumerate(numbers)]
    wide = df.groupBy(part.alias("part")).agg(*aggs)
    nothing = F.lit(None).cast("binary")
    made = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("hll"), nothing.alias("kll")) for i, c in enumerate(cats)]
    made += [F.struct(F.lit(c).alias("column"), nothing.alias("hll"), F.col(f"q{i}").alias("kll")) for i, c in enumerate(numbers)]
    return wide.select("part", "rows", F.explode(F.array(*made)).alias("s")).select("part", "s.column", "rows", "s.hll", "s.kll")


def merged(parts: DataFrame) -> DataFrame:
    """(column, rows, hll, kll) over all given parts: filter them first for a range of days."""
    return parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll")
    )


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """(column, distinct) of the category columns."""
    return sketches.where("hll is not null").select("column", F.hll_sketch_estimate("hll").alias("distinct"))


def quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(column, q, value) of the number columns that have a value."""
    held = sketches.where("kll is not null").where(F.kll_sketch_get_n_double("kll") > 0)
    each = [F.struct(F.lit(float(p)).alias("q"), F.kll_sketch_get_quantile_double("kll", F.lit(float(p))).alias("value")) for p in probs]
    return held.select("column", F.explode(F.array(*each)).alias("e")).select("column", "e.q", "e.value")
