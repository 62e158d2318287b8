"""Exact global order statistics without sorting everything in one task.

Ordered work is split by range: rows are range-partitioned by the sort key and written once with
their range number, so the ranges stay fixed for all later reads. Totals per range are small; a
running sum over them gives each range its starting value, and a window inside the range does the
rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.functions.hashing import hash60
from clickloom.operators.joins import match_join
from clickloom.state import settle

HASH_BITS = 60
BUCKET_BITS = 16


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<s>``: the inclusive running sum of each ``s`` within ``by`` along ``order``.

    ``df`` holds one row per (by, order) combination: group ties first. ``by`` splits into a few
    groups (classes, columns, folds): the broadcast starts hold one row per range and group in it.
    """
    by, order = list(by), list(order)
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *ordering)
    fixed = settle(ranged.withColumn("_range", F.spark_partition_id()), "ordered")

    totals = fixed.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = match_join(fixed, starts, [*by, "_range"], small=True)
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
    )


def dense_codes(values: DataFrame, column: str, by: Sequence[str] = (), code: str = "code") -> DataFrame:
    """Number the distinct values of ``column`` within ``by``: 0 for the smallest."""
    distinct = values.select(*by, column).where(F.col(column).isNotNull()).distinct()
    ranked = running_totals(distinct.withColumn("_one", F.lit(1)), [column], ["_one"], by)
    return ranked.select(*by, column, (F.col("cum__one") - 1).cast("int").alias(code))


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (), method: str = "linear"
) -> DataFrame:
    """Exact quantiles of ``column`` within ``by`` as columns ``q0, q1, ...`` in order of ``probs``.

    ``linear`` interpolates between neighbours; ``nearest`` takes the closest row (halves up).
    Equal values are counted before they are ordered, so a value that makes up most rows is one row.
    """
    by = list(by)
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cum = running_totals(counts, ["_x"], ["_n"], by)
    totals = cum.groupBy(*by).agg(F.max("cum__n").alias("_rows"))
    placed = match_join(cum, totals, by, small=True)

    def at(rank: str) -> str:
        return f"max(CASE WHEN cum__n - _n <= {rank} AND {rank} < cum__n THEN _x END)"

    outs = []
    for i, q in enumerate(probs):
        spot = f"({float(q)!r}D * (_rows - 1))"
        if method == "nearest":
            text = at(f"floor({spot} + 0.5D)")
        else:
            low, high = at(f"floor({spot})"), at(f"ceil({spot})")
            text = f"{low} + ({high} - {low}) * max({spot} - floor({spot}))"
        outs.append(F.expr(text).alias(f"q{i}"))
    return placed.groupBy(*by).agg(*outs)


def _hashed(df: DataFrame, id_col: str, strata: Sequence[str], seed: int) -> DataFrame:
    h = hash60(F.col(id_col), seed)
    return df.select(*strata, F.col(id_col).alias("_id"), h.alias("_h")).withColumn(
        "_b", F.shiftright("_h", HASH_BITS - BUCKET_BITS).cast("int")
    )


def _bucket_starts(keyed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows per hash bucket and before it; at most 65,536 short rows per stratum."""
    sizes = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*strata, F.lit(0)).orderBy("_b")
    return sizes.withColumn("_upto", F.sum("_n").over(upto))


def hash_rank(
    df: DataFrame, id_col: str, strata: Sequence[str] = (), seed: int = 42, out: str = "hash_rank"
) -> DataFrame:
    """Ids with their 0-based place in a repeatable random order within each stratum.

    Rows are ranked inside one of 65,536 hash buckets and shifted by the rows of lower buckets;
    ``strata`` are a few classes, so the broadcast bucket starts stay a few megabytes.
    """
    strata = list(strata)
    keyed = _hashed(df, id_col, strata, seed)
    starts = _bucket_starts(keyed, strata).select(
        *strata, "_b", (F.col("_upto") - F.col("_n")).alias("_start")
    )
    inside = Window.partitionBy(*strata, "_b").orderBy("_h", "_id")
    ranked = keyed.withColumn("_r", F.row_number().over(inside))
    return match_join(ranked, starts, [*strata, "_b"], small=True).select(
        *strata, F.col("_id").alias(id_col), (F.col("_start") + F.col("_r") - 1).alias(out)
    )


def hash_edges(
    df: DataFrame, id_col: str, quotas: DataFrame, strata: list[str], seed: int, few: bool = True, runs: DataFrame | None = None
) -> DataFrame:
    """The last (hash, id) allowed by each quota; null when the quota takes every row.

    ``quotas`` has rows (strata, ``place``, ``need``); with ``few`` they are broadcast. A histogram
    of the hash finds the bucket in which a quota ends, and only that bucket is ranked. Pass the histogram
    as ``runs`` if it has been taken already.
    """
    keyed = _hashed(df, id_col, strata, seed)
    runs = _bucket_starts(keyed, strata) if runs is None else runs
    ends_in = match_join(runs, quotas, strata, "inner", small=few).where(
        (F.col("_upto") - F.col("_n") < F.col("need")) & (F.col("need") <= F.col("_upto"))
    ).select(*strata, "place", "_b", (F.col("need") - F.col("_upto") + F.col("_n")).alias("_left"))
    inside = match_join(keyed, ends_in, [*strata, "_b"], "inner", small=few)
    rank = F.row_number().over(Window.partitionBy(*strata, "place").orderBy("_h", "_id"))
    edge = (
        inside.withColumn("_r", rank)
        .where(F.col("_r") == F.col("_left"))
        .select(*strata, "place", F.struct(F.col("_h").alias("h"), F.col("_id").alias("id")).alias("_edge"))
    )
    return match_join(quotas, edge, [*strata, "place"], small=few)


def hash_spot(id_col: str, seed: int) -> Column:
    return F.struct(hash60(F.col(id_col), seed).alias("h"), F.col(id_col).alias("id"))


def keep_first_by_hash(
    df: DataFrame, id_col: str, quotas: DataFrame, strata: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Keep exactly ``need`` rows per stratum, chosen by hash order of a unique id.

    ``quotas`` has one row (strata columns, ``need``) for each stratum that is sampled, a handful
    of classes; rows of other strata are dropped. Rows are kept by comparing their hash with the
    last one allowed: the wide rows are neither shuffled nor sorted.
    """
    strata = list(strata)
    wanted = quotas.select(*strata, F.lit(0).alias("place"), F.col("need").cast("bigint").alias("need"))
    cuts = hash_edges(df, id_col, wanted, strata, seed)
    return (
        match_join(df, cuts, strata, "inner", small=True)
        .where((F.col("need") > 0) & (F.col("_edge").isNull() | (hash_spot(id_col, seed) <= F.col("_edge"))))
        .select(*df.columns)
    )


def even_folds(
    df: DataFrame, id_col: str, k: int, strata: Sequence[str] = (), seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add a fold number: the hash order of each stratum cut into ``k`` parts of equal size.

    Sizes differ by at most one row. Only the ``k - 1`` cut points per stratum are computed, so
    the wide rows are not shuffled.
    """
    strata = list(strata)
    places = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("place")
    # One histogram gives the sizes and the buckets in which the folds end.
    runs = settle(_bucket_starts(_hashed(df, id_col, strata, seed), strata), "fold_buckets")
    sizes = runs.groupBy(*strata).agg(F.sum("_n").alias("_n")).select(*strata, "_n", places)
    need = F.ceil(F.col("_n") * F.col("place") / F.lit(k)).cast("bigint").alias("need")
    cuts = hash_edges(df, id_col, sizes.select(*strata, "place", need), strata, seed, runs=runs)
    listed = cuts.groupBy(*strata).agg(
        F.collect_list("_edge").alias("_edges")
    )
    spot = hash_spot(id_col, seed)
    fold = F.size(F.filter("_edges", lambda e: spot > e))
    return match_join(df, listed, strata, "inner", small=True).select(*df.columns, fold.alias(out))
