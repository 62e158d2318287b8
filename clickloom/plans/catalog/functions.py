"""Scalar functions, sequence functions and row-order operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from clickloom.functions import casts, numeric, sequences
from clickloom.functions.hashing import affine_fold, blake2b_bucket, md5_bucket
from clickloom.operators import joins, sampling
from clickloom.operators.ranking import hash_rank
from clickloom.plans import features
from clickloom.plans.catalog.registry import D_IDS, ads, d6, duck_hash, logs, query, r6

D_ITEMS = "list_transform(string_split(seq, ','), lambda t: TRY_CAST(t AS INTEGER))"


@query("SELECT event_id, CAST(len(string_split(seq, ',')) AS INT) AS pieces, string_split(seq, ',')[1] AS first_piece FROM impressions")
def split_sequence(spark, sf):
    p = casts.tokens("seq")
    return logs(spark, sf).select("event_id", F.size(p).alias("pieces"), F.get(p, F.lit(0)).alias("first_piece"))


@query(f"SELECT event_id, CAST(len({D_IDS}) AS INT) AS n, array_to_string({D_IDS}, '|') AS ids FROM impressions")
def parse_ids_skip_bad(spark, sf):
    ids = casts.ids_lenient("seq")
    return logs(spark, sf).select("event_id", F.size(ids).alias("n"), F.array_join(ids, "|").alias("ids"))


@query(f"""SELECT event_id, CAST(len({D_ITEMS}) AS INT) AS n, CAST(len(list_filter({D_ITEMS}, lambda v: v IS NULL)) AS INT) AS bad FROM impressions""")
def parse_ids_bad_as_null(spark, sf):
    """Unparsable pieces stay in place as nulls."""
    items = casts.ids_or_null("seq")
    return logs(spark, sf).select(
        "event_id", F.size(items).alias("n"), F.size(F.filter(items, lambda v: v.isNull())).alias("bad")
    )


D_STRICT = "list_transform(list_filter(string_split(replace(seq, 'x', ''), ','), lambda t: t <> ''), lambda t: CAST(trim(t) AS BIGINT))"


@query(f"SELECT event_id, coalesce(array_to_string({D_STRICT}, '|'), '') AS ids FROM impressions")
def parse_ids_strict(spark, sf):
    clean = F.replace("seq", F.lit("x"), F.lit(""))
    return logs(spark, sf).select("event_id", F.array_join(casts.ids_strict(clean), "|").alias("ids"))


@query("SELECT event_id, gender || '_' || age_group AS crossed FROM impressions")
def category_cross(spark, sf):
    return ads(spark, sf).select("event_id", casts.joined("gender", "age_group").alias("crossed"))


@query("SELECT event_id, CAST(length(seq) - length(replace(seq, ',', '')) + 1 AS INT) AS n FROM impressions")
def count_by_delimiter(spark, sf):
    n = F.length("seq") - F.length(F.replace("seq", F.lit(","), F.lit(""))) + 1
    return logs(spark, sf).select("event_id", n.alias("n"))


@query("""SELECT event_id, CAST(len(string_split(seq, ',')) AS INT) AS n,
CAST(len(list_distinct(string_split(seq, ','))) AS INT) AS uniq FROM impressions""")
def sequence_length_and_distinct(spark, sf):
    p = casts.tokens("seq")
    return logs(spark, sf).select("event_id", F.size(p).alias("n"), F.size(F.array_distinct(p)).alias("uniq"))


@query(f"""SELECT event_id, coalesce({D_ITEMS}[1], -1) AS first_item, coalesce({D_ITEMS}[-1], -1) AS last_item,
coalesce({D_ITEMS}[-2], -1) AS second_last FROM impressions""")
def first_and_last_items(spark, sf):
    items = casts.ids_or_null("seq")
    return logs(spark, sf).select(
        "event_id", F.coalesce(F.get(items, F.lit(0)), F.lit(-1)).alias("first_item"),
        sequences.at_end(items, 1).alias("last_item"), sequences.at_end(items, 2).alias("second_last"),
    )


@query(f"""SELECT event_id, {d6(f"list_aggregate(list_slice({D_ITEMS}, greatest(len({D_ITEMS}) - 2, 1), len({D_ITEMS})), 'avg')")} AS last_3,
{d6(f"list_aggregate(list_slice({D_ITEMS}, greatest(len({D_ITEMS}) - 4, 1), len({D_ITEMS})), 'avg')")} AS last_5 FROM impressions""")
def mean_of_last_items(spark, sf):
    df = logs(spark, sf).withColumn("_items", casts.ids_or_null("seq"))
    return df.select(
        "event_id", r6(sequences.last_mean(F.col("_items"), 3)).alias("last_3"),
        r6(sequences.last_mean(F.col("_items"), 5)).alias("last_5"),
    )


@query(f"""SELECT event_id, {d6(f"coalesce(list_aggregate({D_IDS}, 'avg'), 0)")} AS mean,
{d6(f"coalesce(list_aggregate({D_IDS}, 'stddev_pop'), 0)")} AS std, coalesce(list_aggregate({D_IDS}, 'max'), 0) AS max FROM impressions""")
def sequence_mean_std_max(spark, sf):
    """Python-style list functions as array expressions."""
    df = logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq"))
    df = df.withColumn("mean", sequences.list_mean(F.col("_ids")))
    return df.select(
        "event_id", r6("mean").alias("mean"), r6(sequences.list_std(F.col("_ids"), F.col("mean"))).alias("std"),
        F.coalesce(F.array_max("_ids"), F.lit(0)).alias("max"),
    )


@query(f"""SELECT event_id, {d6('CASE WHEN history_a_2 > -1 THEN ln(history_a_2 + 1) END')} AS log_1,
{d6('CASE WHEN history_a_1 > -1 THEN ln(history_a_1 + 1) END')} AS log1p_1,
{d6('ln(history_a_2 - (SELECT min(history_a_2) FROM impressions) + 1)')} AS log_shifted FROM impressions""")
def log_transforms(spark, sf):
    """Null where the logarithm does not exist."""
    df = ads(spark, sf)
    df = joins.cross_one(df, df.agg(F.min("history_a_2").alias("low")))
    return df.select(
        "event_id", r6(numeric.log_plus_one(F.col("history_a_2"))).alias("log_1"),
        r6(F.log1p("history_a_1")).alias("log1p_1"),
        r6(numeric.log_plus_one(F.col("history_a_2") - F.col("low"))).alias("log_shifted"),
    )


@query(f"""SELECT event_id, {d6('sin(2 * pi() * CAST(hour AS DOUBLE) / 24)')} AS sin_hour,
{d6('cos(2 * pi() * CAST(hour AS DOUBLE) / 24)')} AS cos_hour,
{d6('sin(2 * pi() * (CAST(day_of_week AS INT) % 7) / 7)')} AS sin_dow,
{d6('cos(2 * pi() * (CAST(day_of_week AS INT) % 7) / 7)')} AS cos_dow FROM impressions""")
def cyclic_time(spark, sf):
    sh, ch = numeric.cyclic(casts.lenient("hour"), 24)
    sd, cd = numeric.cyclic(casts.lenient("day_of_week"), 7)
    return ads(spark, sf).select(
        "event_id", r6(sh).alias("sin_hour"), r6(ch).alias("cos_hour"), r6(sd).alias("sin_dow"), r6(cd).alias("cos_dow")
    )


@query("""SELECT event_id, CAST(floor(history_a_1 / 10) * 10 AS BIGINT) AS tens,
CAST(((CAST(floor(history_a_2) AS BIGINT) % 24) + 24) % 24 AS BIGINT) AS modulo FROM impressions""")
def floor_and_modulo(spark, sf):
    return ads(spark, sf).select(
        "event_id", (F.floor(F.col("history_a_1") / 10) * 10).alias("tens"),
        F.pmod(F.floor("history_a_2"), F.lit(24)).cast("bigint").alias("modulo"),
    )


D_P = "least(greatest(history_a_1 / 500, 0.000001), 0.999999)"


@query(f"SELECT event_id, {d6(f'ln({D_P} / (1 - {D_P}))')} AS logit, {d6('1 / (1 + exp(-(history_a_2 / 100)))')} AS sigmoid FROM impressions")
def logit_and_sigmoid(spark, sf):
    return ads(spark, sf).select(
        "event_id", r6(numeric.logit(F.col("history_a_1") / 500)).alias("logit"),
        r6(numeric.sigmoid(F.col("history_a_2") / 100)).alias("sigmoid"),
    )


@query(f"""SELECT event_id, CAST({duck_hash('event_id')} % 128 AS INT) AS bucket, CAST((event_id * 104729 + 42) % 5 AS INT) AS fold FROM impressions""")
def hash_buckets_and_folds(spark, sf):
    return ads(spark, sf).select(
        "event_id", md5_bucket(F.col("event_id"), 128).alias("bucket"), affine_fold(F.col("event_id")).alias("fold")
    )


def _duck_digests(buckets: int) -> str:
    """(key, slot) of the 18 item ids by hashlib: SQL has no blake2b."""
    slots = [(k, int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "big") % buckets) for k in range(18)]
    return "(VALUES " + ", ".join(f"({k}, {slot})" for k, slot in slots) + ") AS digests(key, slot)"


@query(f"""SELECT "ID", inventory_id, CAST(slot AS INT) AS bucket FROM impressions
LEFT JOIN {_duck_digests(10)} ON key = CAST(inventory_id AS INT)""")
def blake2b_buckets(spark, sf):
    """Buckets of item ids by blake2b; tests compare other texts with hashlib."""
    return ads(spark, sf).select("ID", "inventory_id", blake2b_bucket(F.col("inventory_id"), 10).alias("bucket"))


@query("SELECT event_id, CAST(feat_c_2 AS VARCHAR) AS user_text, CAST(clicked AS VARCHAR) AS label_text FROM impressions")
def numbers_as_categories(spark, sf):
    return ads(spark, sf).select(
        "event_id", F.col("feat_c_2").cast("string").alias("user_text"), F.col("clicked").cast("string").alias("label_text")
    )


@query("""SELECT event_id, CAST(length(replace(seq, ',', '')) AS BIGINT) AS letters,
array_to_string(list_transform(string_split(seq, ','), lambda t: trim(t)), ',') AS trimmed FROM impressions""")
def list_element_expression(spark, sf):
    p = casts.tokens("seq")
    letters = F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t))
    return logs(spark, sf).select(
        "event_id", letters.alias("letters"), F.array_join(F.transform(p, lambda t: F.trim(t)), ",").alias("trimmed")
    )


# ---- sequence features -----------------------------------------------------------------------

D_EXPLODED = f"""
, ids AS (SELECT event_id, {D_IDS} AS ids FROM impressions),
tok AS (SELECT event_id, len(ids) AS n, unnest(ids) AS v, unnest(range(len(ids))) AS pos FROM ids),
per_id AS (SELECT event_id, v, min(n) AS n, count(*) AS c, min(pos) AS first, max(pos) AS last FROM tok GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, first) AS place FROM per_id),
stats AS (SELECT event_id, min(n) AS n, count(*) AS uniq, max(v) FILTER (place = 1) AS top1, max(c) FILTER (place = 1) AS c1,
  max(c) FILTER (place = 2) AS c2, sum(-(c / n) * ln(c / n + CAST(1e-12 AS DOUBLE))) AS entropy,
  sum(pow(CAST(2 AS DOUBLE), -(n - 1 - last) / CAST(10 AS DOUBLE))) AS decayed FROM ranked GROUP BY event_id),
islands AS (SELECT event_id, v, pos - row_number() OVER (PARTITION BY event_id, v ORDER BY pos) AS g FROM tok),
runs AS (SELECT event_id, max(len) AS run FROM (SELECT event_id, count(*) AS len FROM islands GROUP BY event_id, v, g) GROUP BY event_id)"""

D_STATS = f"""CAST(coalesce(n, 0) AS INT) AS seq_len, CAST(coalesce(uniq, 0) AS INT) AS uniq_cnt, {d6('coalesce(uniq / n, 0)')} AS uniq_ratio,
coalesce(top1, 0) AS top1_id, {d6('coalesce(c1 / n, 0)')} AS top1_share, {d6('coalesce(c2 / n, 0)')} AS top2_share,
coalesce(ids[-1], 0) AS last_id, {d6('coalesce(entropy, 0)')} AS entropy, CAST(coalesce(run, 0) AS INT) AS rep_run_max,
{d6('coalesce(decayed, 0)')} AS decayed_unique"""

REAL_STATS = ["uniq_ratio", "top1_share", "top2_share", "entropy", "decayed_unique"]


@query(f"{D_EXPLODED} SELECT event_id, {D_STATS} FROM ids LEFT JOIN stats USING (event_id) LEFT JOIN runs USING (event_id)")
def sequence_statistics(spark, sf):
    df = logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq"))
    df = sequences.with_stats(sequences.with_counts(df, "_ids"))
    return df.withColumns({c: r6(c) for c in REAL_STATS}).select("event_id", *sequences.STAT_COLUMNS)


@query(f"{D_EXPLODED} SELECT event_id, CAST(coalesce(run, 0) AS INT) AS longest_run FROM ids LEFT JOIN runs USING (event_id)")
def longest_run_of_equal_ids(spark, sf):
    df = logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq"))
    return df.select("event_id", sequences.longest_run(F.col("_ids")).alias("longest_run"))


@query(f"{D_EXPLODED} SELECT event_id, v AS id, CAST(c AS INT) AS n, CAST(first AS INT) AS first_position, CAST(last AS INT) AS last_position FROM per_id")
def positions_per_id(spark, sf):
    df = sequences.with_counts(logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq")), "_ids")
    return df.select("event_id", F.explode("_runs").alias("r")).select(
        "event_id", F.col("r.v").alias("id"), F.col("r.n").alias("n"),
        F.col("r.first").alias("first_position"), F.col("r.last").alias("last_position"),
    )


@query(f"{D_EXPLODED} SELECT event_id, top1 AS top1_id, {d6('c1 / n')} AS top1_share, {d6('coalesce(c2 / n, 0)')} AS top2_share FROM stats")
def two_most_frequent_ids(spark, sf):
    df = sequences.with_counts(logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq")), "_ids")
    return sequences.with_stats(df).where("seq_len > 0").select(
        "event_id", "top1_id", r6("top1_share").alias("top1_share"), r6("top2_share").alias("top2_share")
    )


@query(f"""SELECT token, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({D_IDS}) AS token FROM impressions) GROUP BY 1)
ORDER BY n DESC, token LIMIT 50""")
def top_vocabulary(spark, sf):
    return features.token_counts(logs(spark, sf)).orderBy(F.desc("n"), "token").limit(50)


@query(f"{D_EXPLODED} SELECT event_id, v AS id, {d6('c / n')} AS ratio FROM per_id WHERE v IN (SELECT v FROM tok GROUP BY v ORDER BY count(*) DESC, v LIMIT 50)")
def vocabulary_ratios(spark, sf):
    """Shares of the 50 most frequent ids, listed where above zero."""
    df = logs(spark, sf)
    vocab = features.fit_vocab(df)
    df = sequences.with_counts(df.withColumn("_ids", casts.ids_lenient("seq")), "_ids")
    names = F.array(*[F.lit(v).cast("bigint") for v in vocab])
    listed = sequences.with_ratios(df, vocab).select("event_id", F.posexplode("ratio").alias("place", "ratio"))
    return listed.where("ratio > 0").select("event_id", F.get(names, F.col("place")).alias("id"), r6("ratio").alias("ratio"))


@query(f"""{D_EXPLODED} SELECT event_id, CAST({duck_hash('v')} % 128 AS INT) AS bucket, {d6('sum(c) / min(n)')} AS share
FROM per_id GROUP BY 1, 2""")
def hashed_bag_of_ids(spark, sf):
    """Shares of the buckets a row uses, listed without building the dense vector."""
    df = sequences.with_counts(logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq")))
    used = df.select(
        "event_id", F.size("_ids").alias("n"),
        F.explode(sequences.bucket_counts(F.col("_runs"), lambda v: md5_bucket(v, 128))).alias("bucket", "c"),
    )
    return used.select("event_id", "bucket", r6(F.col("c") / F.col("n")).alias("share"))


@query(f"""{D_EXPLODED} SELECT event_id, CAST(slot AS INT) AS bucket, {d6('sum(c) / min(n)')} AS share
FROM per_id LEFT JOIN {_duck_digests(128)} ON key = v GROUP BY 1, 2""")
def digest_bag_of_ids(spark, sf):
    """The used places of a dense bag with blake2b buckets."""
    df = sequences.with_counts(logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq")))
    listed = sequences.with_digest_bag(df).select("event_id", F.posexplode("bag").alias("bucket", "share"))
    return listed.where("share > 0").select("event_id", "bucket", r6("share").alias("share"))


# ---- row order -------------------------------------------------------------------------------

@query(f"""SELECT event_id, clicked, row_number() OVER (PARTITION BY clicked ORDER BY {duck_hash('event_id', 42)}, event_id) - 1 AS hash_rank FROM impressions""")
def random_rank_per_class(spark, sf):
    return hash_rank(ads(spark, sf), "event_id", ["clicked"]).select("event_id", "clicked", "hash_rank")


@query("""
, t AS (SELECT event_id, epoch_us(event_time) AS t FROM impressions), s AS (SELECT list_sort(list(t)) AS v, count(*) AS n FROM t)
SELECT event_id, CAST((t >= v[1 + CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT)]) AS INT) + CAST((t >= v[1 + CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)]) AS INT)
 + CAST((t >= v[1 + CAST(floor(0.75 * (n - 1) + 0.5) AS BIGINT)]) AS INT) AS block FROM t, s""")
def time_ordered_blocks(spark, sf):
    return sampling.time_blocks(ads(spark, sf), "event_time", 4).select("event_id", "block")
