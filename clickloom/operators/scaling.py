"""Standard scaling and the quantile-to-normal transform."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import clip, normal_ppf
from clickloom.operators.joins import cross_one, match_join
from clickloom.operators.ranking import running_totals
from clickloom.state import settle

EDGE = 1e-7


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean and the population deviation of each column; a zero deviation is 1."""
    aggs = []
    for c in columns:
        std = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(std > 0, std).otherwise(1.0).alias(f"{c}_std")]
    return df.agg(*aggs)


def apply_standard(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    return cross_one(df, fitted).withColumns(scaled).select(*df.columns)


def fit_quantiles(df: DataFrame, columns: Sequence[str], quantiles: int = 512) -> DataFrame:
    """Per column: an ascending array of exact quantiles of all its values, nulls left out.

    Equal values are counted, ordered by range and given their ranks; only rows that cover a wanted
    rank go on, about two for each quantile. A column with fewer values than quantiles keeps its
    sorted values; one with a single value is not fitted.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    counts = long.where(F.col("x").isNotNull()).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts, ["x"], ["n"], ["column"])
    totals = cum.groupBy("column").agg(F.max("cum_n").alias("rows"))
    placed = match_join(cum, totals, ["column"], small=True).where("rows > 1")
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    few = placed.where(F.col("rows") < quantiles).groupBy("column").agg(
        F.sort_array(F.flatten(F.collect_list(F.array_repeat("x", F.col("n").cast("int"))))).alias("quantiles")
    )
    step = (F.col("rows") - 1) / F.lit(float(quantiles - 1))
    from_place = F.greatest(F.lit(0), F.ceil((first - 1) / step)).cast("int")
    to_place = F.least(F.lit(quantiles - 1), F.floor((last + 1) / step)).cast("int")
    spot = (F.col("rows") - 1) * (F.col("place") / F.lit(float(quantiles - 1)))
    near = (
        placed.where(F.col("rows") >= quantiles)
        .withColumns({"from_place": from_place, "to_place": to_place})
        .where("from_place <= to_place")
        .withColumn("place", F.explode(F.sequence("from_place", "to_place")))
        .withColumns({"low": F.floor(spot), "high": F.ceil(spot), "share": spot - F.floor(spot)})
    )
    at = lambda rank: F.max(F.when((F.col(rank) >= first) & (F.col(rank) <= last), F.col("x")))
    points = near.groupBy("column", "place").agg(at("low").alias("low_x"), at("high").alias("high_x"), F.max("share").alias("share"))
    value = F.when(F.col("share") == 0, F.col("low_x")).otherwise((1 - F.col("share")) * F.col("low_x") + F.col("share") * F.col("high_x"))
    grid = points.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))).alias("points"))
    full = grid.select("column", F.transform("points", lambda p: p["v"]).alias("quantiles"))
    return settle(few.unionByName(full), "quantiles")


def to_uniform(x: Column, quantiles: list[float]) -> Column:
    """Place of ``x`` among the quantiles, from 0 to 1, null kept.

    Interpolated from the left and from the right and averaged, so that a value repeated among the
    quantiles lands in the middle of its run.
    """
    grid = np.asarray(quantiles)
    places = np.linspace(0, 1, len(grid))

    @F.pandas_udf("double")
    def place(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=float)
        left = np.interp(v, grid, places)
        right = -np.interp(-v, -grid[::-1], -places[::-1])
        u = 0.5 * (left + right)
        u = np.where(v + EDGE > grid[-1], 1.0, u)
        u = np.where(v - EDGE < grid[0], 0.0, u)
        return pd.Series(np.where(np.isnan(v), np.nan, u))

    return F.when(x.isNotNull(), place(x.cast("double")))


def to_normal(u: Column) -> Column:
    """Normal score of a place in [0, 1], bounded near +-5.2."""
    inner = F.least(F.greatest(u, F.lit(EDGE)), F.lit(1 - EDGE))
    top = NormalDist().inv_cdf(1 - EDGE)
    return F.when(u.isNotNull(), clip(normal_ppf(inner), -top, top))


def apply_quantiles(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each fitted column by its normal score; columns without a fit stay as they are.

    The fitted table has one short array per column (schema-bound), so it is read to the driver.
    """
    grids = {r["column"]: r["quantiles"] for r in fitted.collect()}
    present = [c for c in columns if c in grids]
    placed = df.withColumns({c: to_uniform(F.col(c), grids[c]) for c in present})
    return placed.withColumns({c: to_normal(F.col(c)) for c in present})
