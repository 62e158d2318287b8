"""Casts, null rules and parsing of the comma-separated sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "__NA__"
RARE = "__RARE__"


def strict_int(col: str | Column, to: str = "bigint") -> Column:
    """Number text such as ``"3.0"`` to an integer; bad text is an error."""
    return _c(col).cast("double").cast(to)


def lenient(col: str | Column, to: str = "double") -> Column:
    """Cast that turns bad text into null."""
    return _c(col).try_cast(to)


def finite(col: str | Column) -> Column:
    """NaN and the infinities become null."""
    x = _c(col)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def na_level(col: str | Column) -> Column:
    """Category text with nulls as a level of their own."""
    return F.coalesce(_c(col).cast("string"), F.lit(NA))


def tokens(seq: str | Column) -> Column:
    """The raw text pieces; an empty text has one empty piece, null stays null."""
    return F.split(_c(seq), ",")


def ids_or_null(seq: str | Column, to: str = "int") -> Column:
    """One element per piece, null where the piece is no number."""
    return F.transform(tokens(seq), lambda t: t.try_cast(to))


def ids_lenient(seq: str | Column) -> Column:
    """Trimmed integers; blank and unparsable pieces are skipped; a null sequence is empty."""
    parsed = F.transform(tokens(seq), lambda t: F.trim(t).try_cast("bigint"))
    return F.coalesce(F.filter(parsed, lambda v: v.isNotNull()), F.array().cast("array<bigint>"))


def ids_strict(seq: str | Column) -> Column:
    """Integers; empty pieces are skipped, bad text is an error, a null sequence is empty."""
    present = F.filter(tokens(seq), lambda t: t != "")
    return F.coalesce(
        F.transform(present, lambda t: F.trim(t).cast("bigint")), F.array().cast("array<bigint>")
    )


def joined(*cols: str, sep: str = "_") -> Column:
    """Cross of category values; null when any part is null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep), F.col(c).cast("string")]
    return F.concat(*parts[1:])


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
