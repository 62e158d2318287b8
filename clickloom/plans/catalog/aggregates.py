"""Counts, click rates, distributions and plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import casts
from clickloom.functions.hashing import affine_fold
from clickloom.operators import joins, profile, sketches, target_encoding
from clickloom.operators.ranking import exact_quantiles
from clickloom.plans import features
from clickloom.plans.catalog.registry import D_IDS, ads, d6, logs, query, r6
from clickloom.sources.impressions import CATS
from clickloom.state import settle

D_LEN = "len(string_split(seq, ','))"


def _length(df):
    return df.withColumn("seq_length", F.size(casts.tokens("seq")))


@query("SELECT gender, count(*) AS n FROM impressions GROUP BY gender")
def group_row_counts(spark, sf):
    return ads(spark, sf).groupBy("gender").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT inventory_id, count(DISTINCT age_group) + max(CASE WHEN age_group IS NULL THEN 1 ELSE 0 END) AS ages
FROM impressions GROUP BY inventory_id""")
def distinct_with_null_counted(spark, sf):
    return ads(spark, sf).groupBy("inventory_id").agg(profile.distinct_with_null("age_group").alias("ages"))


@query(f"SELECT age_group, count(*) AS n, {d6('avg(clicked)')} AS ctr FROM impressions GROUP BY age_group")
def click_rate_by_group(spark, sf):
    return profile.click_rate(ads(spark, sf), ["age_group"]).withColumn("ctr", r6("ctr"))


@query(f"""SELECT feat_c_2, CAST(sum(clicked) AS BIGINT) AS clicks, min(history_a_1) AS low, max(history_a_1) AS high,
{d6('stddev_samp(history_a_1)')} AS spread FROM impressions GROUP BY feat_c_2""")
def sum_min_max_std(spark, sf):
    return ads(spark, sf).groupBy("feat_c_2").agg(
        F.sum("clicked").alias("clicks"), F.min("history_a_1").alias("low"), F.max("history_a_1").alias("high"),
        r6(F.stddev_samp("history_a_1")).alias("spread"),
    )


@query(f"""SELECT event_id, {d6(f"coalesce(list_aggregate({D_IDS}, 'stddev_pop'), 0)")} AS spread FROM impressions""")
def list_population_std(spark, sf):
    from clickloom.functions import sequences

    df = logs(spark, sf).withColumn("_ids", casts.ids_lenient("seq"))
    df = df.withColumn("_mean", sequences.list_mean(F.col("_ids")))
    return df.select("event_id", r6(sequences.list_std(F.col("_ids"), F.col("_mean"))).alias("spread"))


@query(f"""SELECT {d6('quantile_cont(history_a_1, 0.01)')} AS q01, {d6('quantile_cont(history_a_1, 0.5)')} AS q50,
{d6('quantile_cont(history_a_1, 0.99)')} AS q99 FROM impressions""")
def exact_quantile_points(spark, sf):
    q = exact_quantiles(ads(spark, sf), "history_a_1", [0.01, 0.5, 0.99])
    return q.select(r6("q0").alias("q01"), r6("q1").alias("q50"), r6("q2").alias("q99"))


DESCRIBED = ["history_a_1", "history_a_2", "feat_e_3"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls, {d6(f'avg({c})')} AS mean,
        {d6(f'stddev_samp({c})')} AS std, min({c}) AS min, max({c}) AS max,
        list_sort(list({c}) FILTER ({c} IS NOT NULL))[1 + CAST(floor(0.25 * (count({c}) - 1) + 0.5) AS BIGINT)] AS q25,
        list_sort(list({c}) FILTER ({c} IS NOT NULL))[1 + CAST(floor(0.5 * (count({c}) - 1) + 0.5) AS BIGINT)] AS q50,
        list_sort(list({c}) FILTER ({c} IS NOT NULL))[1 + CAST(floor(0.75 * (count({c}) - 1) + 0.5) AS BIGINT)] AS q75
        FROM impressions""" for c in DESCRIBED
    )
)
def describe_numbers(spark, sf):
    return profile.describe(ads(spark, sf), DESCRIBED).withColumns({"mean": r6("mean"), "std": r6("std")})


NULLABLE = ["gender", "age_group", "feat_e_3", "seq", "hour"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM impressions""" for c in NULLABLE))
def null_counts(spark, sf):
    return profile.null_counts(logs(spark, sf), NULLABLE)


PROFILED = [*CATS, "feat_c_2", "l_feat_1", "feat_e_3", "history_a_1"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS "distinct" FROM impressions"""
    for c in PROFILED
))
def cardinality_profile(spark, sf):
    return profile.cardinality(ads(spark, sf), PROFILED)


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM impressions WHERE {c} IS NOT NULL GROUP BY {c}""" for c in CATS
))
def value_counts(spark, sf):
    from clickloom.operators.encoding import level_counts

    return level_counts(ads(spark, sf), CATS)


D_PIVOT = ", ".join(f"{d6(f'avg(clicked) FILTER (hour = {chr(39)}{h}{chr(39)})')} AS h{h}" for h in range(24))


@query(f"SELECT age_group, {D_PIVOT} FROM impressions GROUP BY age_group")
def click_rate_pivot(spark, sf):
    """Click rate by age group and hour; the hours are given, so no pass is spent finding them."""
    hours = [str(h) for h in range(24)]
    grid = ads(spark, sf).groupBy("age_group").pivot("hour", hours).avg("clicked")
    return grid.select("age_group", *[r6(h).alias(f"h{h}") for h in hours])


@query("""SELECT 'gender' AS "column", coalesce(gender, '__NA__') AS key, CAST((event_id * 104729 + 42) % 5 AS INT) AS fold,
CAST(sum(clicked) AS BIGINT) AS fold_sum, count(*) AS fold_rows FROM impressions GROUP BY 2, 3
UNION ALL SELECT 'age_group', coalesce(age_group, '__NA__'), CAST((event_id * 104729 + 42) % 5 AS INT),
CAST(sum(clicked) AS BIGINT), count(*) FROM impressions GROUP BY 2, 3""")
def fold_by_key_counts(spark, sf):
    return target_encoding.fold_counts(
        ads(spark, sf), ["gender", "age_group"], "clicked", affine_fold(F.col("event_id"))
    )


@query("""
, totals AS (SELECT feat_c_2, count(*) AS n, sum(clicked) AS s FROM impressions GROUP BY 1)
SELECT CASE WHEN n < 60 THEN '__RARE__' ELSE CAST(feat_c_2 AS VARCHAR) END AS level, CAST(sum(n) AS BIGINT) AS n,
CAST(sum(s) AS BIGINT) AS s FROM totals GROUP BY 1""")
def rare_keys_collapsed(spark, sf):
    totals = ads(spark, sf).groupBy("feat_c_2").agg(F.count(F.lit(1)).alias("n"), F.sum("clicked").alias("s"))
    level = F.when(F.col("n") < 60, casts.RARE).otherwise(F.col("feat_c_2").cast("string"))
    return totals.groupBy(level.alias("level")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@query(f"SELECT {d6('sum(clicked) / greatest(count(*), 1)')} AS prior FROM impressions")
def global_prior(spark, sf):
    return ads(spark, sf).agg(r6(F.sum("clicked") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("prior"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({D_IDS}) AS token FROM impressions) GROUP BY token")
def token_counts(spark, sf):
    return features.token_counts(logs(spark, sf))


@query(f"""SELECT count(*) FILTER (seq IS NULL) AS nulls, count(*) FILTER (trim(seq) = '') AS blank,
count(*) FILTER (trim(seq) <> '' AND len({D_IDS}) = 0) AS unparsed FROM impressions""")
def empty_sequence_audit(spark, sf):
    blank = F.trim("seq") == ""
    return logs(spark, sf).agg(
        F.count_if(F.col("seq").isNull()).alias("nulls"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & (F.size(casts.ids_lenient("seq")) == 0)).alias("unparsed"),
    )


@query(f"SELECT {d6('count(*) FILTER (clicked = 0) / count(*) FILTER (clicked = 1)')} AS ratio FROM impressions")
def class_ratio(spark, sf):
    return profile.class_ratio(ads(spark, sf)).select(r6("ratio").alias("ratio"))


@query(f"""SELECT CAST({D_LEN} // 10 * 10 AS BIGINT) AS bin, count(*) AS n, {d6('avg(clicked)')} AS ctr FROM impressions GROUP BY 1""")
def click_rate_by_length_bin(spark, sf):
    bin_ = (F.floor(F.col("seq_length") / 10) * 10).alias("bin")
    return _length(logs(spark, sf)).groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("clicked")).alias("ctr"))


def _duck_histogram(x: str) -> str:
    return f"""
, x AS (SELECT CAST({x} AS DOUBLE) AS x FROM impressions WHERE {x} IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin,
{d6("min(lo) + CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INT) * min((hi - lo) / 50)")} AS left_edge, count(*) AS n
FROM x, e GROUP BY 1, least(floor((x - lo) / ((hi - lo) / 50)), 49)"""


@query(_duck_histogram("history_a_1"))
def histogram_raw(spark, sf):
    return profile.histogram(ads(spark, sf), "history_a_1").withColumn("left_edge", r6("left_edge"))


@query(_duck_histogram("ln(1 + history_a_1)"))
def histogram_log(spark, sf):
    logged = ads(spark, sf).select(F.log1p("history_a_1").alias("x"))
    return profile.histogram(logged, "x").withColumn("left_edge", r6("left_edge"))


@query(f"""
, per_user AS (SELECT feat_c_2, max({D_LEN}) AS longest FROM impressions GROUP BY 1)
SELECT CAST(longest AS INT) AS longest, count(*) AS users FROM per_user
WHERE longest <= (SELECT quantile_cont(longest, 0.99) FROM per_user) GROUP BY 1""")
def longest_session_distribution(spark, sf):
    """Users by their longest sequence, up to the 99th percentile."""
    per_user = _length(logs(spark, sf)).groupBy("feat_c_2").agg(F.max("seq_length").alias("longest"))
    users = per_user.groupBy("longest").agg(F.count(F.lit(1)).alias("users"))
    edge = exact_quantiles(per_user, "longest", [0.99])
    return joins.cross_one(users, edge).where("longest <= q0").select("longest", "users")


@query(f"SELECT clicked, count(*) AS n, {d6('count(*) / (SELECT count(*) FROM impressions)')} AS share FROM impressions GROUP BY clicked")
def target_share(spark, sf):
    return profile.target_share(ads(spark, sf)).withColumn("share", r6("share"))


@query(f"""SELECT inventory_id, {d6('avg(feat_a_1)')} AS feat_a_1_mean, {d6('stddev_samp(feat_a_1)')} AS feat_a_1_std
FROM impressions GROUP BY inventory_id""")
def inventory_mean_and_std(spark, sf):
    return ads(spark, sf).groupBy("inventory_id").agg(
        r6(F.avg("feat_a_1")).alias("feat_a_1_mean"), r6(F.stddev_samp("feat_a_1")).alias("feat_a_1_std")
    )


@query(f"""SELECT feat_c_2, CAST(sum(clicked) AS BIGINT) AS clicks, count(*) AS exposures, {d6('sum(clicked) / count(*)')} AS user_ctr
FROM impressions GROUP BY feat_c_2""")
def user_click_rate(spark, sf):
    return ads(spark, sf).groupBy("feat_c_2").agg(
        F.sum("clicked").alias("clicks"), F.count(F.lit(1)).alias("exposures")
    ).withColumn("user_ctr", r6(F.try_divide("clicks", "exposures")))


LETTERS = [0.03125, 0.0625, 0.125, 0.25, 0.5, 0.75, 0.875, 0.9375, 0.96875]


@query("SELECT clicked, " + ", ".join(
    f"round(quantile_cont(history_a_1, {q}), 9) AS q{i}" for i, q in enumerate(LETTERS)
) + " FROM impressions GROUP BY clicked")
def letter_values_by_class(spark, sf):
    q = exact_quantiles(ads(spark, sf), "history_a_1", LETTERS, ["clicked"])
    return q.select("clicked", *[F.round(f"q{i}", 9).alias(f"q{i}") for i in range(len(LETTERS))])


@query(f"""
, f AS (SELECT count(history_a_1) AS rows, min(history_a_1) AS lo, max(history_a_1) AS hi,
        stddev_samp(history_a_1) * pow(count(history_a_1), CAST(-0.2 AS DOUBLE)) AS h FROM impressions),
g AS (SELECT CAST(i AS INT) AS point, lo - 3 * h + i * ((hi - lo + 6 * h) / 199) AS x_at, h, rows FROM f, range(200) AS t(i))
SELECT point, {d6('min(x_at)')} AS x_at, {d6('sum(exp(-(pow((x_at - history_a_1) / h, 2)) / 2)) / (min(rows) * min(h) * sqrt(2 * pi()))')} AS density
FROM g, impressions GROUP BY point""")
def density_curve(spark, sf):
    """Kernel density of all rows."""
    return profile.density(ads(spark, sf), "history_a_1").withColumns({"x_at": r6("x_at"), "density": r6("density")})


SKETCHED = ["gender", "inventory_id", "feat_c_2", "ID"]
SKETCH_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query(" UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", CAST(NULL AS DOUBLE) AS q, CAST(count(DISTINCT {c}) AS BIGINT) AS exact, true AS within FROM impressions WHERE event_id % 7 < 5""" for c in SKETCHED]
    + [f"""SELECT '{c}', CAST({q} AS DOUBLE), CAST(count({c}) AS BIGINT), true FROM impressions WHERE event_id % 7 < 5""" for c in ("history_a_1", "feat_e_3") for q in SKETCH_PROBS]
))
def sketches_of_parts_merged(spark, sf):
    """Sketches stored per part, five of seven parts merged: beside the exact counts, within the stated errors.

    ``exact`` is the exact distinct count of a category, or the number of values whose ranks judge a quantile.
    """
    df = ads(spark, sf)
    numbers = ["history_a_1", "feat_e_3"]
    parts = settle(sketches.sketch_parts(df, F.col("event_id") % 7, SKETCHED, numbers), "sketches")
    all_parts = settle(sketches.merged(parts.where("part < 5")), "merged_sketches")
    rows = df.where("event_id % 7 < 5")
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).unpivot([], SKETCHED, "column", "exact")
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.COUNT_ERROR * F.col("exact"))
    counted = exact.join(F.broadcast(sketches.distinct_counts(all_parts)), "column", "left").select(
        "column", F.lit(None).cast("double").alias("q"), "exact", F.coalesce(near, F.lit(False)).alias("within")
    )
    long = rows.select(*numbers).unpivot([], numbers, "column", "x").where("x IS NOT NULL")
    ranks = long.join(F.broadcast(sketches.quantiles(all_parts, SKETCH_PROBS)), "column").groupBy("column", "q").agg(
        F.count(F.lit(1)).alias("exact"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")
    )
    low, high = F.col("below") / F.col("exact") - sketches.RANK_ERROR, F.col("upto") / F.col("exact") + sketches.RANK_ERROR
    return counted.unionByName(ranks.select("column", "q", "exact", F.col("q").between(low, high).alias("within")))
