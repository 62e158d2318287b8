"""Group statistics joined back, lookups with defaults, membership, fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import joins
from clickloom.operators.profile import distinct_with_null
from clickloom.operators.sampling import in_pool
from clickloom.plans.catalog.registry import ads, d6, duck_hash, query, r6
from clickloom.sources.impressions import train_test
from clickloom.state import settle


@query("""
SELECT event_id, n AS user_rows, mean_value FROM impressions LEFT JOIN (
  SELECT feat_c_2, count(*) AS n, round(avg(history_a_1), 6) AS mean_value FROM impressions GROUP BY feat_c_2
) USING (feat_c_2)""")
def group_stats_joined_back(spark, sf):
    df = ads(spark, sf)
    stats = settle(joins.with_group_stats(
        df, ["feat_c_2"], user_rows=F.count(F.lit(1)), mean_value=r6(F.avg("history_a_1"))
    ), "stats")
    return joins.lookup_join(df, stats, ["feat_c_2"], "user_rows", ["event_id"]).select(
        "event_id", "user_rows", "mean_value"
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, supplier_rows, l_quantity - mean_quantity AS above_mean
FROM lineitem LEFT JOIN (
  SELECT l_suppkey, count(*) AS supplier_rows, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY l_suppkey
) USING (l_suppkey)""", raw=True)
def supplier_stats_joined_back(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    stats = settle(joins.with_group_stats(
        lines, ["l_suppkey"], supplier_rows=F.count(F.lit(1)), mean_quantity=F.avg("l_quantity")
    ), "stats")
    joined = joins.lookup_join(
        lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey"),
        stats, ["l_suppkey"], "supplier_rows", ["l_orderkey", "l_linenumber"],
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "supplier_rows",
        (F.col("l_quantity") - F.col("mean_quantity")).alias("above_mean"),
    )


@query("""
, train AS (SELECT * FROM impressions WHERE event_id % 5 < 4), test AS (SELECT * FROM impressions WHERE event_id % 5 = 4)
SELECT event_id, exposures, inventories FROM test LEFT JOIN (
  SELECT feat_c_2, count(*) AS exposures,
         count(DISTINCT inventory_id) + max(CASE WHEN inventory_id IS NULL THEN 1 ELSE 0 END) AS inventories
  FROM train GROUP BY feat_c_2) USING (feat_c_2)""")
def train_stats_on_test(spark, sf):
    train, test = train_test(ads(spark, sf))
    stats = settle(joins.with_group_stats(
        train, ["feat_c_2"], exposures=F.count(F.lit(1)), inventories=distinct_with_null("inventory_id")
    ), "stats")
    return joins.lookup_join(test, stats, ["feat_c_2"], "exposures", ["event_id"]).select(
        "event_id", "exposures", "inventories"
    )


@query(f"""
, train AS (SELECT * FROM impressions WHERE event_id % 5 < 4), test AS (SELECT * FROM impressions WHERE event_id % 5 = 4)
SELECT event_id, {d6('coalesce(rate, (SELECT avg(clicked) FROM train))')} AS rate FROM test LEFT JOIN (
  SELECT age_group, inventory_id, hour, avg(clicked) AS rate FROM train GROUP BY ALL
) USING (age_group, inventory_id, hour)""")
def lookup_with_default(spark, sf):
    """Keys never seen in training, and null keys, get the global mean."""
    train, test = train_test(ads(spark, sf))
    keys = ["age_group", "inventory_id", "hour"]
    rates = settle(joins.with_group_stats(train, keys, rate=F.avg("clicked"), n=F.count(F.lit(1))), "rates")
    prior = train.agg(F.avg("clicked").alias("prior"))
    found = joins.cross_one(joins.lookup_join(test, rates, keys, "n", ["event_id"]), prior)
    return found.select("event_id", r6(F.coalesce("rate", "prior")).alias("rate"))


@query("""
SELECT event_id, clicked FROM impressions WHERE inventory_id IN (
  SELECT inventory_id FROM (SELECT inventory_id, count(*) AS n FROM impressions GROUP BY 1 ORDER BY n DESC, inventory_id LIMIT 5))""")
def rows_of_top_groups(spark, sf):
    df = ads(spark, sf)
    top = df.groupBy("inventory_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "inventory_id").limit(5)
    return df.join(F.broadcast(top), "inventory_id", "left_semi").select("event_id", "clicked")


@query(f"SELECT event_id FROM impressions WHERE NOT ({duck_hash('event_id')} % 10 = 0)")
def complement_of_pool(spark, sf):
    return ads(spark, sf).where(~in_pool("event_id")).select("event_id")


@query(f"""
, train AS (SELECT * FROM impressions WHERE event_id % 5 < 4), test AS (SELECT * FROM impressions WHERE event_id % 5 = 4)
SELECT "ID", {d6('coalesce(own, (SELECT avg(clicked) FROM train))')} AS p, CASE WHEN own IS NULL THEN 1 ELSE 0 END AS by_fallback
FROM test LEFT JOIN (SELECT age_group, inventory_id, avg(clicked) AS own FROM train
  WHERE age_group IS NOT NULL AND inventory_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60
) USING (age_group, inventory_id)""")
def segment_score_or_global(spark, sf):
    """Segments with enough training rows use their own score, all other rows the global one."""
    train, test = train_test(ads(spark, sf))
    keys = ["age_group", "inventory_id"]
    own = settle(
        joins.with_group_stats(train, keys, own=F.avg("clicked"), n=F.count(F.lit(1))).where("n >= 60"), "own"
    )
    both = joins.cross_one(
        joins.lookup_join(test, own, keys, "n", ["event_id"]), train.agg(F.avg("clicked").alias("prior"))
    )
    return both.select("ID", r6(F.coalesce("own", "prior")).alias("p"), F.col("own").isNull().cast("int").alias("by_fallback"))


@query(f"SELECT event_id, {d6('history_a_2 - (SELECT min(history_a_2) FROM impressions)')} AS above_min FROM impressions")
def global_minimum_on_rows(spark, sf):
    df = ads(spark, sf)
    low = df.agg(F.min("history_a_2").alias("low"))
    return joins.cross_one(df, low).select("event_id", r6(F.col("history_a_2") - F.col("low")).alias("above_min"))
