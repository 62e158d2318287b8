"""Category encoders: rare levels, integer codes, one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.casts import RARE, na_level
from clickloom.operators.joins import HOT_SHARE, lookup_columns
from clickloom.operators.ranking import dense_codes, running_totals
from clickloom.state import settle



def level_counts(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Rows per (column, value), nulls left out, all columns in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cats])
    ).alias("_p")
    return (
        df.select(pairs)
        .where(F.col("_p.value").isNotNull())
        .groupBy(F.col("_p.column"), F.col("_p.value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rare_levels(df: DataFrame, cats: Sequence[str], below: int = 50) -> DataFrame:
    """(column, value, n, rare): training values seen fewer than ``below`` times.

    Values that hold 1/1024 of the rows or more are listed too, not rare: a lookup must know hot keys.
    """
    counts = settle(level_counts(df, cats), "rare_counts")
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rare = F.col("n") < below
    listed = counts.join(F.broadcast(totals), "column").where(rare | (F.col("n") * HOT_SHARE >= F.col("total")))
    return settle(listed.select("column", "value", "n", rare.alias("rare")), "rare_levels")


def _looked_up(df: DataFrame, table: DataFrame, cats: Sequence[str], spread: Sequence[str] | None, limits: dict) -> DataFrame:
    keyed = table.where(F.col("column").isin(*cats)).withColumnRenamed("value", "key")
    return lookup_columns(df, keyed, {c: F.col(c).cast("string") for c in cats}, spread, **limits)


def bucket_rare(
    df: DataFrame, rare: DataFrame, cats: Sequence[str], spread: Sequence[str] | None = None, **limits
) -> DataFrame:
    """Replace rare training values by the rare level and nulls by the missing level.

    Values never seen in training are left as they are. ``spread`` tells rows apart.
    """
    found = _looked_up(df, rare, cats, spread, limits)
    return found.withColumns(
        {c: F.when(F.col(f"_of_{c}.rare"), RARE).otherwise(na_level(c)) for c in cats}
    ).drop(*[f"_of_{c}" for c in cats])


def fit_codes(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Codes 0..k-1 of the sorted values of each column, with row counts."""
    counts = settle(level_counts(df, cats), "levels")
    codes = dense_codes(counts, "value", ["column"])
    return settle(counts.join(codes, ["column", "value"]), "codes")


def apply_codes(
    df: DataFrame, codes: DataFrame, cats: Sequence[str], unknown: int = -1, suffix: str = "",
    spread: Sequence[str] | None = None, **limits,
) -> DataFrame:
    """Replace each value by its fitted code; unseen and null values get ``unknown``. ``spread`` tells rows apart."""
    found = _looked_up(df, codes, cats, spread, limits)
    return found.withColumns(
        {c + suffix: F.coalesce(F.col(f"_of_{c}.code"), F.lit(unknown)) for c in cats}
    ).drop(*[f"_of_{c}" for c in cats])


def joint_codes(train: DataFrame, test: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Codes over the values of both tables, nulls counted as the text ``nan``."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cats]
    return fit_codes(train.select(*filled).unionByName(test.select(*filled)), cats)


def categorify(df: DataFrame, cats: Sequence[str], most: int | None = None, at_least: int = 0) -> DataFrame:
    """Ids by falling frequency, 1 for the most frequent; 0 is left for null and unknown values.

    Every value seen at least ``at_least`` times is numbered; ``most`` turns it into a top-k report.
    """
    counts = level_counts(df, cats).where(F.col("n") >= at_least)
    ranked = running_totals(
        counts.withColumns({"_less": -F.col("n"), "_one": F.lit(1)}), ["_less", "value"], ["_one"], ["column"]
    )
    codes = ranked.select("column", "value", F.col("cum__one").cast("int").alias("code"), "n")
    return settle(codes if most is None else codes.where(F.col("code") <= most), "categorify")


#: Most columns that one-hot encoding makes; wider columns take codes (or the sparse vector of field_vectors).
MOST_DUMMIES = 10_000


def dummy_levels(df: DataFrame, cats: Sequence[str], most: int = MOST_DUMMIES) -> dict[str, list[str]]:
    """Sorted training values per column; each becomes an output column, so the caller picks narrow columns.

    More than ``most`` values in all are refused before any is listed.
    """
    levels = settle(level_counts(df, cats), "dummy_levels")
    if levels.count() > most:
        raise ValueError("too many values for one column each; use codes or field vectors")
    rows = levels.orderBy("column", "value").collect()
    return {c: [r["value"] for r in rows if r["column"] == c] for c in cats}


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per training value; null and unseen values are 0 everywhere."""
    flags = {
        f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0))
        for c, values in levels.items()
        for v in values
    }
    return df.withColumns(flags).drop(*levels)


def field_sizes(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Number of codes per column: the largest code plus one."""
    sizes = df.agg(*[(F.max(c) + 1).cast("bigint").alias(c) for c in cats])
    return sizes.unpivot([], list(cats), "column", "size")
