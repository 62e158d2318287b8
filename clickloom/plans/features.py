"""Whole feature recipes: fit on training rows, apply to any rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import casts, numeric, sequences
from clickloom.functions.hashing import md5_bucket
from clickloom.operators import encoding, joins, scaling, tables, target_encoding
from clickloom.operators.profile import distinct_with_null
from clickloom.sources.impressions import CATS
from clickloom.state import settle, settle_bucketed

TARGET = "clicked"
VOCAB_SIZE = 50
HASH_DIMS = 128


# ---- user exposure recipes -------------------------------------------------------------------

@dataclass
class ExposureFit:
    users: DataFrame
    low: DataFrame


def fit_exposure(df: DataFrame, user: str = "l_feat_1") -> ExposureFit:
    """Row count and number of inventories per user, and the smallest ``history_a_2``."""
    users = joins.with_group_stats(
        df, [user],
        user_exposure_count=F.count(F.lit(1)),
        user_unique_inventory_count=distinct_with_null("inventory_id"),
    )
    low = df.agg(F.min(F.coalesce("history_a_2", F.lit(0.0))).alias("_low"))
    return ExposureFit(settle(users, "users"), settle(low, "low"))


def _cast_cats(df: DataFrame, to: str = "bigint") -> DataFrame:
    return df.withColumns({c: casts.strict_int(c, to) for c in CATS})


def _finish_exposure(df: DataFrame, fitted: ExposureFit, user: str, spread: Sequence[str] | None) -> DataFrame:
    df = df.withColumns(
        {
            "gender_age_interaction": casts.joined("gender", "age_group"),
            "age_inventory_interaction": casts.joined("age_group", "inventory_id"),
        }
    )
    df = joins.lookup_join(df, fitted.users, [user], "user_exposure_count", spread)
    return df.fillna({"feat_e_3": -1.0, "gender": -1, "age_group": -1}).fillna(0.0)


def _shifted_log(df: DataFrame, fitted: ExposureFit) -> DataFrame:
    logged = numeric.log_plus_one(F.col("history_a_2") - F.col("_low"))
    return joins.cross_one(df, fitted.low).withColumn("log_history_a_2", logged).drop("_low")


def exposure_features(df: DataFrame, fitted: ExposureFit, user: str = "l_feat_1", spread: Sequence[str] | None = None) -> DataFrame:
    """Sequence lengths, crosses and user exposure; categories moved up by one so none is below 0."""
    pieces = casts.tokens("seq")
    df = _cast_cats(df).withColumns(
        {"seq_length": F.size(pieces), "seq_unique_count": F.size(F.array_distinct(pieces))}
    ).drop("seq")
    df = _finish_exposure(df, fitted, user, spread)
    df = df.withColumns({c: F.col(c) + 1 for c in CATS})
    logs = ["history_a_1", "seq_length", "seq_unique_count"]
    df = df.withColumns({f"log_{c}": numeric.log_plus_one(F.col(c)) for c in logs})
    return _shifted_log(df, fitted)


def sequence_exposure_features(df: DataFrame, fitted: ExposureFit, user: str = "l_feat_1", spread: Sequence[str] | None = None) -> DataFrame:
    """As above with ends and tail means of the parsed sequence; categories are not moved."""
    df = _cast_cats(df, "int").withColumn("_items", casts.ids_or_null("seq"))
    items = F.col("_items")
    df = df.withColumns(
        {
            "seq_length": F.size(items),
            "seq_unique_count": F.size(F.array_distinct(items)),
            "last_item_in_seq": F.try_element_at(items, F.lit(-1)),
            "first_item_in_seq": F.get(items, F.lit(0)),
            "last_3_items_mean": sequences.last_mean(items, 3),
            "last_5_items_mean": sequences.last_mean(items, 5),
        }
    ).drop("_items", "seq")
    df = _finish_exposure(df, fitted, user, spread)
    logs = ["history_a_1", "seq_length", "seq_unique_count", "user_exposure_count"]
    df = df.withColumns({f"log_{c}": numeric.log_plus_one(F.col(c)) for c in logs})
    return _shifted_log(df, fitted)


# ---- user session recipe ---------------------------------------------------------------------

def _numbers_of_history(df: DataFrame) -> DataFrame:
    """History columns and the hour as numbers; the ``a`` family as log(1 + x)."""
    history = tables.match_columns(df, ".*history_.*")
    logged = {c for c in history if "history_a_" in c}
    return df.withColumns({c: F.log1p(casts.lenient(c)) if c in logged else casts.lenient(c) for c in ["hour", *history]})


def _time_of_week(weekend: Sequence[str]) -> dict[str, Column]:
    sine, cosine = numeric.cyclic(F.col("hour"), 24)
    return {"is_weekend": F.col("day_of_week").isin(*weekend).cast("tinyint"), "hour_sin": sine, "hour_cos": cosine}


def _session_length(length: Column) -> dict[str, Column]:
    return {
        "seq_length": length, "log_seq_length": F.log1p(length),
        "is_very_short_session": (length < 50).cast("tinyint"), "seq_length_binned": sequences.length_bin(length),
    }


def _session_base(df: DataFrame, weekend: Sequence[str]) -> DataFrame:
    crossed = {"age_x_gender": casts.joined("age_group", "gender")}
    length = _session_length(F.size(casts.tokens("seq")))
    return _numbers_of_history(df).withColumns(_time_of_week(weekend) | crossed | length)


def fit_users(df: DataFrame, user: str = "feat_c_2", buckets: int | None = None) -> DataFrame:
    """Exposure, clicks and session length statistics per user; ``user_ctr`` includes own clicks.

    With ``buckets`` the table is stored bucketed by user, for repeated use by ``joins.lookup_bucketed``.
    """
    n = F.size(casts.tokens("seq"))
    stats = joins.with_group_stats(
        df.withColumn("_n", n), [user],
        user_total_exposure=F.count(F.lit(1)),
        user_total_clicks=F.sum(TARGET),
        user_unique_inventories=distinct_with_null("inventory_id"),
        user_mean_session_length=F.avg("_n"),
        user_max_session_length=F.max("_n"),
        user_session_length_std=F.stddev_samp("_n"),
    )
    stats = stats.withColumn("user_ctr", F.col("user_total_clicks") / F.col("user_total_exposure"))
    return settle(stats, "user_stats") if buckets is None else settle_bucketed(stats, [user], buckets, "user_stats")


def session_features(df: DataFrame, users: DataFrame, user: str = "feat_c_2", weekend: Sequence[str] = ("6", "7"), spread: Sequence[str] | None = None) -> DataFrame:
    """Log history, time of day, session length classes and the user's statistics."""
    base = _session_base(df, weekend)
    return joins.lookup_join(base, users, [user], "user_total_exposure", spread)


# ---- SQL recipe ------------------------------------------------------------------------------

def sql_features(train: DataFrame, rows: DataFrame, mark: str = ",") -> DataFrame:
    """Inventory statistics of the training rows, length by counting ``mark``, weekend flag.

    The statistics are written first, so their size is known when the lookup picks its join.
    """
    value = F.col("feat_a_1")
    stats = settle(
        joins.with_group_stats(train, ["inventory_id"], feat_a_1_mean=F.avg(value), feat_a_1_std=F.stddev(value), _n=F.count(F.lit(1))), "inventory_stats"
    )
    marks = F.regexp_count("seq", F.lit(re.escape(mark)))
    weekend = F.coalesce(F.col("day_of_week").try_cast("int").isin(6, 7), F.lit(False))
    looked_up = joins.lookup_join(rows, stats, ["inventory_id"], "_n").drop("_n")
    return looked_up.withColumns({"seq_length": marks + 1, "is_weekend": weekend.cast("int")})


# ---- per-segment recipe ----------------------------------------------------------------------

def segment_features(df: DataFrame, levels: dict[str, list[str]], drop: Sequence[str] = ("age_group", "inventory_id")) -> DataFrame:
    """Statistics of the strictly parsed sequence, cyclic time, one-hot columns; keys dropped."""
    df = df.withColumn("_ids", casts.ids_strict("seq"))
    ids = F.col("_ids")
    df = df.withColumns(
        {
            "seq_length": F.size(ids),
            "seq_unique_count": F.size(F.array_distinct(ids)),
            "seq_mean": sequences.list_mean(ids),
            "seq_max": F.coalesce(F.array_max(ids), F.lit(0)),
            "seq_last_1": sequences.at_end(ids, 1),
            "seq_last_2": sequences.at_end(ids, 2),
        }
    ).withColumn("seq_std", sequences.list_std(ids, F.col("seq_mean")))
    for c, period in (("hour", 24), ("day_of_week", 7)):
        sine, cosine = numeric.cyclic(F.coalesce(casts.lenient(c), F.lit(0.0)), period)
        df = df.withColumns({f"{c}_sin": sine, f"{c}_cos": cosine})
    return encoding.one_hot(df.drop("_ids", "seq", "hour", "day_of_week"), levels).drop(*drop)


# ---- enriched table --------------------------------------------------------------------------

def token_counts(df: DataFrame, seq: str = "seq") -> DataFrame:
    """How often each id occurs in all sequences."""
    return df.select(F.explode(casts.ids_lenient(seq)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


def fit_vocab(df: DataFrame, size: int = VOCAB_SIZE, seq: str = "seq") -> list[int]:
    """The ``size`` most frequent ids, the smaller id first on a tie."""
    top = token_counts(df, seq).orderBy(F.desc("n"), "token").limit(size).collect()
    return [r["token"] for r in top]


def with_sequence_features(
    df: DataFrame, vocab: list[int], dims: int = HASH_DIMS,
    digest: str = "md5", seq: str = "seq",
) -> DataFrame:
    """Statistics columns plus the ``ratio`` and ``bag`` arrays, all computed inside each row.

    ``digest="blake2b"`` gives other buckets than the built-in md5, at the price of Arrow transfer.
    """
    df = sequences.with_counts(df.withColumn("_ids", casts.ids_lenient(seq)))
    df = sequences.with_ratios(sequences.with_stats(df), vocab)
    if digest == "blake2b":
        df = sequences.with_digest_bag(df, dims)
    else:
        df = sequences.with_hash_bag(df, lambda v: md5_bucket(v, dims), dims)
    return df.drop("_ids", "_runs")


def enriched(
    df: DataFrame, enc: target_encoding.TargetEncoding, vocab: list[int], originals: Sequence[str],
    fold: Column | None = None, dims: int = HASH_DIMS, narrow: bool = True,
    digest: str = "md5", spread: Sequence[str] | None = None,
) -> DataFrame:
    """The fixed-order wide table: originals, encodings, sequence features, target last.

    With ``fold`` the rows are training rows and get out-of-fold encodings. The two vector blocks
    stay arrays until this last projection. ``narrow`` stores ids and reals in four bytes.
    """
    encoded = (
        target_encoding.apply_train(df, enc, fold, spread)
        if fold is not None
        else target_encoding.apply_full(df, enc, spread)
    )
    made = with_sequence_features(encoded, vocab, dims, digest)
    whole, real = ("int", "float") if narrow else ("int", "double")
    counted = {"seq_len", "uniq_cnt", "rep_run_max"}
    named = {"top1_id", "last_id"}

    def sized(c: str) -> str:
        kind = whole if c in counted or (c in named and narrow) else "bigint" if c in named else real
        return f"CAST({c} AS {kind}) AS {c}"

    target = [f"CAST({TARGET} AS tinyint) AS {TARGET}"] if fold is not None else []
    return made.selectExpr(
        *[f"`{c}`" for c in originals],
        *[sized(f"{c}_te") for c in enc.cats],
        *[sized(c) for c in sequences.STAT_COLUMNS],
        *[f"CAST(get(ratio, {i}) AS {real}) AS ratio_id_{v}" for i, v in enumerate(vocab)],
        *[f"CAST(get(bag, {j}) AS {real}) AS h{j}" for j in range(dims)],
        *target,
    )


# ---- model-ready table -----------------------------------------------------------------------

@dataclass
class ReadyFit:
    cats: list[str]
    numbers: list[str]
    rare: DataFrame
    codes: DataFrame
    quantiles: DataFrame


CYCLIC = {"hour": ("Sin_hour", "Cos_hour", 24), "day_of_week": ("Sin_dow", "Cos_dow", 7)}
# Other names under which the two time columns may arrive.
TIME_NAMES = {
    "hour": ["hour", "Hour", "hour_of_day", "hr"],
    "day_of_week": ["day_of_week", "dow", "dayofweek", "DayOfWeek"],
}


def with_cyclic(df: DataFrame) -> DataFrame:
    for key, (sin_name, cos_name, period) in CYCLIC.items():
        name = tables.first_present(df, TIME_NAMES[key])
        if name:
            sine, cosine = numeric.cyclic(casts.lenient(name), period)
            df = df.withColumns({sin_name: sine.cast("float"), cos_name: cosine.cast("float")})
    return df


def fit_ready(train: DataFrame, id_col: str, drop: Sequence[str] = (TARGET,), rare_below: int = 50, quantiles: int = 512, as_category: Sequence[str] = ()) -> ReadyFit:
    """Fit rare levels, codes and quantiles of the training rows.

    Strings are categories (so may be named number columns such as ids); other numbers are
    transformed to normal scores, except booleans, the target and the id.
    """
    groups = tables.column_groups(train, [*drop, id_col])
    cats = [*groups["category"], *as_category]
    numbers = [c for c in groups["number"] if c not in as_category]
    rare = encoding.rare_levels(train, cats, rare_below)
    leveled = encoding.bucket_rare(train.select(id_col, *cats), rare, cats, [id_col])
    return ReadyFit(
        cats, numbers, rare, encoding.fit_codes(leveled, cats),
        scaling.fit_quantiles(train, numbers, quantiles),
    )


def model_ready(df: DataFrame, fitted: ReadyFit, id_col: str, narrow: bool = True) -> DataFrame:
    """Cyclic time, integer categories, normal scores; nulls in numbers stay null."""
    df = with_cyclic(df)
    df = encoding.bucket_rare(df, fitted.rare, fitted.cats, [id_col])
    df = encoding.apply_codes(df, fitted.codes, fitted.cats, spread=[id_col])
    df = scaling.apply_quantiles(df, fitted.quantiles, fitted.numbers)
    return df.withColumns({c: F.col(c).cast("float") for c in fitted.numbers}) if narrow else df
