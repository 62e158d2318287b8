"""Projections, filters, null handling, schemas, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import casts, numeric
from clickloom.operators import tables
from clickloom.operators.sampling import in_pool
from clickloom.plans.catalog.registry import ads, d6, duck_hash, logs, query, r6
from clickloom.sources.impressions import CATS, train_test

# Weekday numbers and names in week order.
DAY_NAMES = {
    "1": "Monday", "2": "Tuesday", "3": "Wednesday", "4": "Thursday",
    "5": "Friday", "6": "Saturday", "7": "Sunday",
}
D_DAYS = "(VALUES " + ", ".join(f"('{k}', '{v}', {k})" for k, v in DAY_NAMES.items()) + ") AS d(code, day_name, place)"


@query('SELECT "ID", history_a_1 * 2 AS doubled, clicked AS label FROM impressions')
def select_and_alias(spark, sf):
    return ads(spark, sf).select("ID", (F.col("history_a_1") * 2).alias("doubled"), F.col("clicked").alias("label"))


@query("SELECT event_id, history_a_1, history_a_2 FROM impressions")
def select_by_pattern(spark, sf):
    df = ads(spark, sf)
    return df.select("event_id", *tables.match_columns(df, "history_a_.*"))


@query('SELECT "ID", feat_a_1, feat_c_2, feat_e_3 FROM impressions')
def select_by_prefix(spark, sf):
    df = ads(spark, sf)
    return df.select("ID", *tables.expand_names(df, ["feat_*"]))


@query("SELECT event_id, clicked, gender, age_group, inventory_id, day_of_week, hour, l_feat_1 FROM impressions")
def drop_columns_if_present(spark, sf):
    return ads(spark, sf).drop(
        "ID", "event_time", "feat_c_2", "feat_e_3", "history_a_1", "history_a_2", "feat_a_1", "l_feat_14", "seq"
    )


@query(
    "SELECT event_id, " + ", ".join(f"CAST(CAST({c} AS DOUBLE) AS BIGINT) AS {c}" for c in CATS) + " FROM impressions"
)
def strict_number_cast(spark, sf):
    return ads(spark, sf).select("event_id", *[casts.strict_int(c).alias(c) for c in CATS])


@query("SELECT event_id, TRY_CAST(seq AS DOUBLE) AS seq_number, TRY_CAST(hour AS DOUBLE) AS hour FROM impressions")
def lenient_number_cast(spark, sf):
    return logs(spark, sf).select(
        "event_id", casts.lenient("seq").alias("seq_number"), casts.lenient("hour").alias("hour")
    )


@query(
    "SELECT event_id, round(CAST(CAST(feat_a_1 AS FLOAT) AS DOUBLE), 3) AS feat_a_1, CAST(feat_c_2 AS INTEGER) AS feat_c_2, "
    "CAST(clicked AS TINYINT) AS clicked FROM impressions"
)
def narrow_types(spark, sf):
    return ads(spark, sf).select(
        "event_id", F.round(F.col("feat_a_1").cast("float").cast("double"), 3).alias("feat_a_1"),
        F.col("feat_c_2").cast("int").alias("feat_c_2"), F.col("clicked").cast("tinyint").alias("clicked"),
    )


@query("SELECT event_id FROM impressions WHERE history_a_1 > 20 AND history_a_1 <= 90.5 AND clicked = 1")
def compare_filter(spark, sf):
    return ads(spark, sf).where("history_a_1 > 20 AND history_a_1 <= 90.5 AND clicked = 1").select("event_id")


@query("SELECT event_id, day_of_week FROM impressions WHERE day_of_week IN ('6', '7')")
def in_list_filter(spark, sf):
    return ads(spark, sf).where(F.col("day_of_week").isin("6", "7")).select("event_id", "day_of_week")


@query("SELECT event_id, hour FROM impressions WHERE CAST(hour AS INT) BETWEEN 6 AND 11")
def between_filter(spark, sf):
    return ads(spark, sf).where(F.col("hour").cast("int").between(6, 11)).select("event_id", "hour")


@query(
    "SELECT event_id, CASE WHEN CAST(hour AS INT) BETWEEN 6 AND 11 THEN 'Morning' WHEN CAST(hour AS INT) BETWEEN 12 AND 17 "
    "THEN 'Afternoon' WHEN CAST(hour AS INT) BETWEEN 18 AND 22 THEN 'Evening' ELSE 'Night' END AS time_of_day FROM impressions"
)
def time_of_day_bands(spark, sf):
    h = F.col("hour").cast("int")
    # The hours that bound the bands.
    band = (
        F.when(h.between(6, 11), "Morning").when(h.between(12, 17), "Afternoon")
        .when(h.between(18, 22), "Evening").otherwise("Night")
    )
    return ads(spark, sf).select("event_id", band.alias("time_of_day"))


@query("SELECT event_id, CASE WHEN day_of_week IN ('6', '7') THEN 1 ELSE 0 END AS is_weekend FROM impressions")
def case_when(spark, sf):
    return ads(spark, sf).select(
        "event_id", F.when(F.col("day_of_week").isin("6", "7"), 1).otherwise(0).alias("is_weekend")
    )


@query("SELECT event_id, CAST(history_a_1 < 50 AS TINYINT) AS is_low FROM impressions")
def condition_as_flag(spark, sf):
    return ads(spark, sf).select("event_id", (F.col("history_a_1") < 50).cast("tinyint").alias("is_low"))


@query(f"SELECT event_id, day_name FROM impressions JOIN {D_DAYS} ON day_of_week = code")
def value_map(spark, sf):
    return ads(spark, sf).replace(DAY_NAMES, subset=["day_of_week"]).select("event_id", F.col("day_of_week").alias("day_name"))


@query("SELECT event_id, coalesce(feat_e_3, -1) AS feat_e_3, coalesce(gender, '-1') AS gender FROM impressions")
def fill_per_column(spark, sf):
    return ads(spark, sf).fillna({"feat_e_3": -1.0, "gender": "-1"}).select("event_id", "feat_e_3", "gender")


@query("SELECT event_id, coalesce(feat_e_3, 0) AS feat_e_3, gender FROM impressions")
def fill_all_numbers(spark, sf):
    """Only number columns are filled; text stays null."""
    return ads(spark, sf).fillna(0.0).select("event_id", "feat_e_3", "gender")


@query("SELECT event_id, CASE WHEN history_a_1 <= 10 THEN NULL ELSE history_a_1 END AS x FROM impressions")
def infinity_to_null(spark, sf):
    x = F.when(F.col("history_a_1") <= 10, F.lit(float("inf"))).otherwise(F.col("history_a_1"))
    return ads(spark, sf).select("event_id", casts.finite(x).alias("x"))


@query("SELECT event_id, CASE WHEN feat_e_3 IS NULL THEN 0.5 ELSE least(greatest(feat_e_3 / 100, CAST(0.000001 AS DOUBLE)), CAST(0.999999 AS DOUBLE)) END AS p FROM impressions")
def clip_probability(spark, sf):
    return ads(spark, sf).select("event_id", numeric.clip01(F.col("feat_e_3") / 100, missing=0.5).alias("p"))


@query("SELECT event_id, coalesce(gender, '__NA__') AS gender, coalesce(age_group, '__NA__') AS age_group FROM impressions")
def missing_level(spark, sf):
    return ads(spark, sf).select(
        "event_id", casts.na_level("gender").alias("gender"), casts.na_level("age_group").alias("age_group")
    )


@query("SELECT event_id FROM impressions WHERE gender IS NOT NULL AND feat_e_3 IS NOT NULL")
def drop_null_rows(spark, sf):
    return ads(spark, sf).dropna(subset=["gender", "feat_e_3"]).select("event_id")


@query("SELECT CAST(0 AS INT) AS absent, gender, event_id FROM impressions")
def reindex_to_schema(spark, sf):
    return tables.reindex(ads(spark, sf), ["absent", "gender", "event_id"], 0)


@query('SELECT "ID", CASE WHEN event_id % 5 < 4 THEN clicked END AS clicked, gender FROM impressions')
def union_of_schemas(spark, sf):
    """Rows of train and test under the columns of either; absent ones are null."""
    train, test = train_test(ads(spark, sf).select("ID", "clicked", "gender", "event_id"))
    train, test = train.select("clicked", "gender", "ID"), test.select("ID", "gender")
    names = tables.union_names(train, test)
    both = tables.reindex(train, names).unionByName(tables.reindex(test, names))
    return both.select("ID", F.col("clicked").cast("int").alias("clicked"), "gender")


@query("SELECT event_id % 5 = 4 AS is_test, gender, age_group FROM impressions")
def shared_feature_columns(spark, sf):
    """Both splits under the columns they share."""
    train, test = train_test(ads(spark, sf))
    names = tables.shared_features(
        train.select("event_id", "clicked", "gender", "age_group", "hour"), test.drop("hour"), ["event_id", "clicked"]
    )
    parts = [df.select(F.lit(is_test).alias("is_test"), *names) for df, is_test in ((train, False), (test, True))]
    return parts[0].unionByName(parts[1])


@query('SELECT event_id, feat_a_1, feat_c_2, feat_e_3, history_a_1, history_a_2, l_feat_1, clicked FROM impressions')
def number_columns(spark, sf):
    df = ads(spark, sf)
    return df.select(*tables.column_groups(df)["number"])


@query("SELECT CAST(event_id AS VARCHAR) AS row_id, user_id FROM events", raw=True)
def synthetic_row_id(spark, sf):
    from clickloom.sources.readers import with_row_index

    rows = with_row_index(spark, f"{sf}/events.parquet")
    return rows.select(F.col("row_index").cast("string").alias("row_id"), "user_id")


@query("SELECT event_id, coalesce(CAST(CAST(age_group AS DOUBLE) AS BIGINT), -1) + 1 AS age_index FROM impressions")
def index_shift(spark, sf):
    return ads(spark, sf).select(
        "event_id", (F.coalesce(casts.strict_int("age_group"), F.lit(-1)) + 1).alias("age_index")
    )


@query("SELECT event_id, hour AS hr FROM impressions")
def first_present_name(spark, sf):
    df = ads(spark, sf).withColumnRenamed("hour", "hr")
    return df.select("event_id", F.col(tables.first_present(df, ["hour", "Hour", "hour_of_day", "hr"])))


PREVIEW = ["gender", "age_group", "inventory_id", "day_of_week", "hour", "feat_c_2", "clicked"]


@query(
    "SELECT u.column_name AS \"column\", u.v AS value FROM (SELECT "
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in PREVIEW)
    + " FROM impressions ORDER BY event_id LIMIT 1) UNPIVOT INCLUDE NULLS (v FOR column_name IN ("
    + ", ".join(PREVIEW) + ")) AS u"
)
def first_row_listed(spark, sf):
    """The first row as (column, value) pairs."""
    first = ads(spark, sf).orderBy("event_id").limit(1)
    return first.select(*[F.col(c).cast("string").alias(c) for c in PREVIEW]).unpivot([], PREVIEW, "column", "value")


# ---- sorting and set operations --------------------------------------------------------------

@query(f"SELECT hour, count(*) AS n, {d6('avg(clicked)')} AS ctr FROM impressions GROUP BY hour ORDER BY n DESC, hour")
def order_groups(spark, sf):
    return (
        ads(spark, sf).groupBy("hour").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("clicked")).alias("ctr"))
        .orderBy(F.desc("n"), "hour")
    )


@query("SELECT inventory_id, count(*) AS n FROM impressions GROUP BY 1 ORDER BY n DESC, inventory_id LIMIT 10")
def top_groups(spark, sf):
    return (
        ads(spark, sf).groupBy("inventory_id").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "inventory_id").limit(10)
    )


@query(f"SELECT day_name, {d6('avg(clicked)')} AS ctr FROM impressions JOIN {D_DAYS} ON day_of_week = code GROUP BY day_name, place ORDER BY place")
def click_rate_in_week_order(spark, sf):
    day = F.col("day_of_week")
    return (
        ads(spark, sf).groupBy(day.cast("int").alias("place"), day).agg(r6(F.avg("clicked")).alias("ctr"))
        .replace(DAY_NAMES, subset=["day_of_week"])
        .orderBy("place").select(F.col("day_of_week").alias("day_name"), "ctr")
    )


@query(
    f"SELECT DISTINCT CAST(hour AS DOUBLE) AS hour, {d6('sin(2 * pi() * CAST(hour AS DOUBLE) / 24)')} AS sin_hour, "
    f"{d6('cos(2 * pi() * CAST(hour AS DOUBLE) / 24)')} AS cos_hour FROM impressions ORDER BY hour"
)
def distinct_hours_on_circle(spark, sf):
    hours = ads(spark, sf).select(casts.lenient("hour").alias("hour")).distinct().dropna()
    sine, cosine = numeric.cyclic(F.col("hour"), 24)
    return hours.select("hour", r6(sine).alias("sin_hour"), r6(cosine).alias("cos_hour")).orderBy("hour")


@query(
    "SELECT event_id, clicked FROM impressions WHERE clicked = 1 UNION ALL "
    f"SELECT event_id, clicked FROM impressions WHERE clicked = 0 AND {duck_hash('event_id')} % 10 = 0"
)
def union_all_rows(spark, sf):
    df = ads(spark, sf).select("event_id", "clicked")
    return df.where("clicked = 1").unionByName(df.where("clicked = 0").where(in_pool("event_id")))


@query(
    "SELECT age_group FROM impressions WHERE event_id % 5 < 4 UNION SELECT age_group FROM impressions WHERE event_id % 5 = 4"
)
def union_distinct_categories(spark, sf):
    train, test = train_test(ads(spark, sf))
    return train.select("age_group").union(test.select("age_group")).distinct()


@query("SELECT event_id, clicked FROM impressions")
def shuffled_rows(spark, sf):
    """Rows in a repeatable random order; as a set they are unchanged."""
    from clickloom.functions.hashing import hash60

    return ads(spark, sf).select("event_id", "clicked").repartitionByRange(hash60(F.col("event_id"), 42)).sortWithinPartitions(
        hash60(F.col("event_id"), 42), "event_id"
    )
