"""Out-of-fold and full-train target encoding of category columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.casts import na_level
from clickloom.operators.joins import cross_one, lookup_columns, rows_per_column
from clickloom.state import settle

SMOOTH = 50.0
RARE_BELOW = 20


FULL = -1


@dataclass
class TargetEncoding:
    """Fitted encodings as one written table.

    A row holds (column, key, fold, te, rows): the encoding for training rows of that fold, or,
    with fold -1, for rows outside the training data. The row with a null key is the prior.
    """

    cats: list[str]
    table: DataFrame

    @property
    def prior(self) -> DataFrame:
        return self.table.where(F.col("key").isNull()).select(F.col("te").alias("prior"))

    def rows(self, full: bool) -> DataFrame:
        kind = F.col("fold") == FULL if full else F.col("fold") != FULL
        return self.table.where(F.col("key").isNotNull() & kind)

    def part(self, cat: str, full: bool) -> DataFrame:
        return self.rows(full).where(F.col("column") == cat)

    @cached_property
    def sizes(self) -> dict[bool, dict[str, int]]:
        """Size of each category's part, full and by fold; read once."""
        return {full: rows_per_column(self.rows(full)) for full in (False, True)}


def fold_counts(df: DataFrame, cats: Sequence[str], label: str, fold: Column) -> DataFrame:
    """Positives and rows per (column, key, fold): one pass over the data for all columns."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), na_level(c).alias("key")) for c in cats])
    ).alias("_p")
    y = F.coalesce(F.col(label).try_cast("bigint"), F.lit(0))
    long = df.select(y.alias("_y"), fold.alias("fold"), pairs)
    return long.groupBy(F.col("_p.column"), F.col("_p.key"), "fold").agg(
        F.sum("_y").alias("fold_sum"), F.count(F.lit(1)).alias("fold_rows")
    )


def smoothed(s: Column, n: Column, prior: Column, m: float = SMOOTH) -> Column:
    return F.when(n > 0, (s + F.lit(m) * prior) / (n + F.lit(m))).otherwise(prior)


def fit(
    df: DataFrame,
    cats: Sequence[str],
    label: str,
    fold: Column,
    smooth: float = SMOOTH,
    rare_below: int = RARE_BELOW,
) -> TargetEncoding:
    """Fit the encodings. Keys seen fewer than ``rare_below`` times share one rare level.

    All work after the first aggregate is on the (column, key, fold) counts.
    """
    cats = list(cats)
    counts = settle(fold_counts(df, cats, label, fold), "te_counts")
    totals = counts.groupBy("column", "key").agg(
        F.sum("fold_sum").alias("s"), F.sum("fold_rows").alias("n")
    )
    rare = F.col("n") < rare_below
    prior = counts.where(F.col("column") == cats[0]).agg(
        (F.sum("fold_sum") / F.greatest(F.sum("fold_rows"), F.lit(1))).alias("prior")
    )
    keyed = cross_one(counts.join(totals, ["column", "key"]), prior)
    # One row per column and fold, and one per column: the sums of the shared rare level.
    rare_folds = keyed.where(rare).groupBy("column", "fold").agg(
        F.sum("fold_sum").alias("rare_fs"), F.sum("fold_rows").alias("rare_fn")
    )
    rare_all = rare_folds.groupBy("column").agg(F.sum("rare_fs").alias("rare_s"), F.sum("rare_fn").alias("rare_n"))
    pooled = F.broadcast(rare_folds.join(F.broadcast(rare_all), "column"))

    own = smoothed(F.col("s") - F.col("fold_sum"), F.col("n") - F.col("fold_rows"), F.col("prior"), smooth)
    shared = smoothed(
        F.col("rare_s") - F.col("rare_fs"), F.col("rare_n") - F.col("rare_fn"), F.col("prior"), smooth
    )
    train = keyed.join(pooled, ["column", "fold"], "left").select(
        "column", "key", "fold", F.when(rare, shared).otherwise(own).alias("te"), F.col("fold_rows").alias("rows")
    )
    full_own = smoothed(F.col("s"), F.col("n"), F.col("prior"), smooth)
    full_shared = smoothed(F.col("rare_s"), F.col("rare_n"), F.col("prior"), smooth)
    full = cross_one(totals.join(F.broadcast(rare_all), "column", "left"), prior).select(
        "column", "key", F.lit(FULL).alias("fold"), F.when(rare, full_shared).otherwise(full_own).alias("te"),
        F.col("n").alias("rows"),
    )
    start = prior.select(
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("key"),
        F.lit(FULL).alias("fold"), F.col("prior").alias("te"), F.lit(0).cast("bigint").alias("rows"),
    )
    return TargetEncoding(cats, settle(train.unionByName(full).unionByName(start), "target_encoding"))


def apply_train(
    df: DataFrame, enc: TargetEncoding, fold: Column, spread: Sequence[str] | None = None, **limits
) -> DataFrame:
    """Add ``<cat>_te`` to training rows, without each row's own fold. ``spread`` tells rows apart."""
    found = lookup_columns(
        df, enc.rows(full=False), {c: na_level(c) for c in enc.cats}, spread, {"fold": fold}, "rows", enc.sizes[False], **limits
    )
    return found.withColumns({f"{c}_te": F.col(f"_of_{c}.te") for c in enc.cats}).drop(*[f"_of_{c}" for c in enc.cats])


def apply_full(
    df: DataFrame, enc: TargetEncoding, spread: Sequence[str] | None = None, **limits
) -> DataFrame:
    """Add ``<cat>_te`` to new rows; keys never seen in training get the prior."""
    table = enc.rows(full=True).drop("fold")
    found = lookup_columns(df, table, {c: na_level(c) for c in enc.cats}, spread, None, "rows", enc.sizes[True], **limits)
    encoded = cross_one(found, enc.prior)
    filled = {f"{c}_te": F.coalesce(F.col(f"_of_{c}.te"), F.col("prior")) for c in enc.cats}
    return encoded.withColumns(filled).drop("prior", *[f"_of_{c}" for c in enc.cats])
