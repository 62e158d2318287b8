"""Registration of queries and small helpers both dialects share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.impressions import DUCK_IMPRESSIONS, impressions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` may use the ``impressions`` relation unless raw."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql if raw else f"WITH {DUCK_IMPRESSIONS}\n{sql}"
        return fn

    return register


def ads(spark: SparkSession, sf: str) -> DataFrame:
    """Impressions without the sequence: a plain scan."""
    return impressions(spark, sf, seq=False)


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Impressions with the sequence."""
    return impressions(spark, sf)


def r6(col: Column | str) -> Column:
    """Rounded to six places, with no negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def d6(text: str) -> str:
    return f"(round({text}, 6) + CAST(0 AS DOUBLE))"


D_HASH = "CAST(concat('0x', substr(md5(CAST({0} AS VARCHAR)), 1, 15)) AS BIGINT)"
D_SEEDED = "CAST(concat('0x', substr(md5(CAST({0} AS VARCHAR) || '#{1}'), 1, 15)) AS BIGINT)"


def duck_hash(col: str, seed: int | None = None) -> str:
    return D_HASH.format(col) if seed is None else D_SEEDED.format(col, seed)


# Parsed ids in DuckDB: trimmed, blanks and bad text skipped, null gives an empty list.
D_IDS = (
    "coalesce(list_filter(list_transform(string_split(seq, ','), lambda t: TRY_CAST(trim(t) AS BIGINT)), "
    "lambda v: v IS NOT NULL), CAST([] AS BIGINT[]))"
)


# A repeatable pseudo-score with many ties, for metric checks.
def pseudo_score() -> Column:
    return F.round(F.col("history_a_1") / (F.col("history_a_1") + 50), 3)


D_SCORE = "round(history_a_1 / (history_a_1 + 50), 3)"
