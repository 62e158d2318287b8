"""Stable hashes for sampling, splitting and bucketing."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD_STEP = 104729
FOLD_SHIFT = 42


def hash60(col: Column, seed: int | None = None) -> Column:
    """A 60-bit number from the md5 of the text form, the same in any engine."""
    text = col.cast("string")
    if seed is not None:
        text = F.concat(text, F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def md5_bucket(col: Column, buckets: int) -> Column:
    return F.pmod(hash60(col), F.lit(buckets)).cast("int")


def affine_fold(index: Column, folds: int = 5) -> Column:
    """Fold of a row position."""
    return F.pmod(index * FOLD_STEP + FOLD_SHIFT, F.lit(folds)).cast("int")


def _digest_slot(text: str, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % buckets


def blake2b_bucket(col: Column, buckets: int) -> Column:
    """Bucket by the 8-byte blake2b digest, which Spark has no built-in for."""

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(keys.astype(str))
        slots = np.array([_digest_slot(v, buckets) for v in distinct], dtype="int32")
        return pd.Series(slots[codes] if len(keys) else slots)

    return bucket(col.cast("string"))


def blake2b_buckets(texts: Column, buckets: int) -> Column:
    """As ``blake2b_bucket`` for every element of an array; each id of a batch is hashed once.

    Marked as not deterministic only so that a filter on a result exploded later is not built from a
    second copy of the call, which Spark cannot evaluate there.
    """

    @F.pandas_udf("array<int>")
    def bucket(lists: pd.Series) -> pd.Series:
        lengths = lists.map(len).to_numpy()
        flat = np.concatenate(lists.to_list()) if lengths.sum() else np.array([], dtype=object)
        codes, distinct = pd.factorize(flat)
        slots = np.array([_digest_slot(v, buckets) for v in distinct], dtype="int32")
        placed = slots[codes] if len(codes) else slots
        return pd.Series(np.split(placed, np.cumsum(lengths)[:-1]), index=lists.index)

    return bucket.asNondeterministic()(texts)
