"""Checked queries: each Spark query beside the SQL that must give the same rows."""

from clickloom.plans.catalog import (  # noqa: F401
    aggregates, columns, encoders, evaluation, functions, io, joins, learning, samples,
)
from clickloom.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
