"""Samples, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions.hashing import affine_fold
from clickloom.operators import sampling
from clickloom.plans.catalog.registry import ads, duck_hash, query

H = duck_hash("event_id", 42)


@query(f"SELECT event_id FROM impressions WHERE {H} % 1000000 < 100000")
def bernoulli_tenth(spark, sf):
    return sampling.bernoulli(ads(spark, sf), "event_id", 0.1).select("event_id")


@query(f"SELECT event_id FROM impressions ORDER BY {H}, event_id LIMIT 3000")
def fixed_size_sample(spark, sf):
    return sampling.fixed_size(ads(spark, sf), "event_id", 3000).select("event_id")


@query(f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {H}, event_id) - 1 AS r, count(*) OVER () AS n FROM impressions)
WHERE r < n * 0.1""")
def exact_tenth(spark, sf):
    return sampling.exact_fraction(ads(spark, sf), "event_id", 0.1).select("event_id")


@query(f"""SELECT event_id, clicked FROM (SELECT event_id, clicked, row_number() OVER (PARTITION BY clicked ORDER BY {H}, event_id) - 1 AS r,
count(*) OVER () AS n FROM impressions) WHERE r < n * 0.3""")
def capped_class_sample(spark, sf):
    """Each class capped at 30 % of all rows: the small class is kept whole."""
    return sampling.capped_per_class(ads(spark, sf), "event_id", "clicked", 0.3).select("event_id", "clicked")


D_DOWN = """SELECT event_id, clicked FROM impressions WHERE clicked = 1 UNION ALL SELECT event_id, clicked FROM (
SELECT event_id, clicked, row_number() OVER (ORDER BY {h}, event_id) AS r FROM impressions WHERE clicked = 0 {pool})
WHERE r <= {ratio} * (SELECT count(*) FROM impressions WHERE clicked = 1)"""


@query(D_DOWN.format(h=H, pool="", ratio=2))
def negatives_twice_positives(spark, sf):
    return sampling.downsample_negatives(ads(spark, sf), "event_id", "clicked").select("event_id", "clicked")


@query(f", s AS ({D_DOWN.format(h=H, pool='', ratio=1)}) SELECT event_id, clicked FROM s ORDER BY {duck_hash('event_id', 43)}, event_id LIMIT 400000")
def smoke_sample(spark, sf):
    return sampling.smoke_sample(ads(spark, sf), "event_id", "clicked").select("event_id", "clicked")


@query(f", t AS ({D_DOWN.format(h=H, pool='AND ' + duck_hash('event_id') + ' % 10 = 0', ratio=2)}), f AS ({D_DOWN.format(h=H, pool='AND NOT ' + duck_hash('event_id') + ' % 10 = 0', ratio=2)}) SELECT 'tune' AS part, * FROM t UNION ALL SELECT 'final', * FROM f")
def tune_and_final_pools(spark, sf):
    """Positives in both sets, negatives from disjoint hash pools."""
    df = ads(spark, sf).select("event_id", "clicked")
    pool = sampling.in_pool("event_id")
    tune = sampling.downsample_negatives(df, "event_id", "clicked", pool=pool)
    final = sampling.downsample_negatives(df, "event_id", "clicked", pool=~pool)
    return tune.select(F.lit("tune").alias("part"), "*").unionByName(final.select(F.lit("final").alias("part"), "*"))


D_FOLD5 = f"CAST((row_number() OVER (PARTITION BY clicked ORDER BY {H}, event_id) - 1) * 5 // count(*) OVER (PARTITION BY clicked) AS INT)"


@query(f"SELECT event_id, clicked, {D_FOLD5} AS fold FROM impressions")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(ads(spark, sf), "event_id", "clicked", 5).select("event_id", "clicked", "fold")


@query(f"SELECT event_id, clicked FROM (SELECT event_id, clicked, {D_FOLD5} AS fold FROM impressions) WHERE fold = 0")
def stratified_holdout(spark, sf):
    return sampling.stratified_folds(ads(spark, sf), "event_id", "clicked", 5).where("fold = 0").select("event_id", "clicked")


@query(f"SELECT event_id, CAST({H} % 5 AS INT) AS fold FROM impressions")
def hash_folds(spark, sf):
    return ads(spark, sf).select("event_id", sampling.hash_folds("event_id", 5).alias("fold"))


D_EDGE = "v[1 + CAST(floor(CAST({q} AS DOUBLE) * (n - 1) + 0.5) AS BIGINT)]"
D_TIME = ", t AS (SELECT event_id, epoch_us(event_time) AS t FROM impressions), s AS (SELECT list_sort(list(t)) AS v, count(*) AS n FROM t)"


@query(D_TIME + f""", b AS (SELECT event_id, {' + '.join(f"CAST((t >= {D_EDGE.format(q=q)}) AS INT)" for q in (0.25, 0.5, 0.75))} AS block FROM t, s)
SELECT event_id, CAST(split AS INT) AS split, CASE WHEN block = split THEN 'valid' ELSE 'train' END AS part FROM b, range(1, 4) AS r(split) WHERE block <= split""")
def expanding_time_splits(spark, sf):
    return sampling.expanding_splits(ads(spark, sf), "event_time", 3).select("event_id", "split", "part")


@query(D_TIME + f" SELECT event_id, CAST((t >= {D_EDGE.format(q=0.8)}) AS INT) AS is_valid FROM t, s")
def latest_rows_holdout(spark, sf):
    return sampling.last_holdout(ads(spark, sf), "event_time").select("event_id", "is_valid")


@query("SELECT event_id, CAST((event_id * 104729 + 42) % 5 AS INT) AS fold FROM events", raw=True)
def positional_folds(spark, sf):
    from clickloom.sources.readers import with_row_index

    rows = with_row_index(spark, f"{sf}/events.parquet")
    return rows.select("event_id", affine_fold(F.col("row_index")).alias("fold"))


@query(f"""SELECT event_id, inventory_id FROM (SELECT event_id, inventory_id, row_number() OVER (PARTITION BY inventory_id ORDER BY {H}, event_id) AS r FROM impressions
WHERE inventory_id IS NOT NULL) WHERE r <= 500""")
def segments_capped(spark, sf):
    """Training rows per segment, large segments sampled down."""
    return sampling.per_key_cap(ads(spark, sf), "event_id", ["inventory_id"], 500).select("event_id", "inventory_id")
