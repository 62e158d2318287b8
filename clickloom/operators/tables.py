"""Column selection and fixed output schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, TimestampNTZType, TimestampType


def match_columns(df: DataFrame, pattern: str) -> list[str]:
    """Column names that match a regular expression in full."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def expand_names(df: DataFrame, names: Sequence[str], other: DataFrame | None = None) -> list[str]:
    """Sorted names, where a trailing ``*`` stands for every column with that prefix."""
    known = set(df.columns) | set(other.columns if other is not None else [])
    found = {
        k for n in names for k in known if (k.startswith(n[:-1]) if n.endswith("*") else k == n)
    }
    return sorted(found)


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of several possible names that the table has."""
    return next((n for n in names if n in df.columns), None)


def reindex(df: DataFrame, columns: Sequence[str], fill=None) -> DataFrame:
    """Exactly these columns in this order; absent ones hold ``fill``."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def union_names(left: DataFrame, right: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """Columns of both tables, those of the left first."""
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    return [n for n in names if n not in drop]


def shared_features(train: DataFrame, test: DataFrame, drop: Sequence[str]) -> list[str]:
    return [c for c in train.columns if c in test.columns and c not in drop]


def column_groups(df: DataFrame, drop: Sequence[str] = ()) -> dict[str, list[str]]:
    """Names by kind: category, number, boolean, time."""
    kinds = {"category": StringType, "boolean": BooleanType, "number": NumericType,
             "time": (TimestampType, TimestampNTZType)}
    return {
        k: [f.name for f in df.schema if isinstance(f.dataType, t) and f.name not in drop]
        for k, t in kinds.items()
    }
