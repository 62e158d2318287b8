import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash60
from clickloom.operators import joins, sampling
from clickloom.operators.ranking import (
    dense_codes, exact_quantiles, hash_rank, keep_first_by_hash, running_totals,
)
from clickloom.state import settle


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are null."""
    rng = np.random.default_rng(3)
    key = np.where(np.arange(6000) % 3 == 0, 7, rng.integers(0, 2000, 6000)).astype(float)
    key[::50] = np.nan
    pdf = pd.DataFrame({"id": np.arange(6000), "key": key, "x": np.round(rng.gamma(1.0, 30.0, 6000), 1)})
    df = spark.createDataFrame(pdf).withColumn("key", F.when(~F.isnan("key"), F.col("key").cast("bigint")))
    return df, pdf


@pytest.mark.parametrize("weight", ["n", None])
def test_large_lookup_equals_merge(spark, skewed, weight):
    df, pdf = skewed
    stats = settle(joins.with_group_stats(df, ["key"], n=F.count(F.lit(1)), m=F.avg("x")).where("key % 10 <> 4"))
    big = joins.lookup_join(df, stats, ["key"], weight, ["id"], limit=0)
    small = joins.lookup_join(df, stats, ["key"], weight)
    assert big.columns == ["id", "key", "x", "n", "m"]
    a, b = (t.select("id", "n", F.round("m", 6).alias("m")).toPandas().sort_values("id", ignore_index=True) for t in (big, small))
    pd.testing.assert_frame_equal(a, b)
    counts = pdf.groupby("key").size()
    want = pdf["key"].map(counts).where(pdf["key"] % 10 != 4)
    assert len(a) == 6000 and a["n"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_hot_and_null_keys_are_spread_over_tasks(spark, skewed, many_ranges):
    """A third of the rows has one key; no shuffle task of the join may receive anything like that."""
    df, _ = skewed
    stats = settle(joins.with_group_stats(df, ["key"], n=F.count(F.lit(1)), m=F.avg("x")))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        big = joins.lookup_join(df, stats, ["key"], "n", ["id"], limit=0)
        largest = big.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert big.count() == 6000 and largest < 500
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_running_totals_across_ranges(spark, skewed, many_ranges):
    df, pdf = skewed
    counts = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    for descending in (False, True):
        got = running_totals(counts, ["x"], ["n"], descending=descending).toPandas().set_index("x")["cum_n"]
        want = pdf.groupby("x").size().sort_index(ascending=not descending).cumsum()
        assert got.sort_index().tolist() == want.sort_index().tolist()


def test_quantiles_equal_numpy(spark, skewed, many_ranges):
    df, pdf = skewed
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = exact_quantiles(df, "x", probs).first()
    assert np.allclose(list(got), np.quantile(pdf["x"], probs))
    grouped = exact_quantiles(df.withColumn("g", F.when(F.col("id") % 4 > 0, F.col("id") % 4)), "x", [0.3], ["g"])
    want = pdf.groupby(pdf["id"] % 4)["x"].quantile(0.3)
    for r in grouped.collect():
        assert abs(r["q0"] - want[r["g"] or 0]) < 1e-9


def test_codes_follow_sort_order(spark, many_ranges):
    words = spark.createDataFrame([(f"w{i * 7919 % 500:04d}",) for i in range(3000)] + [(None,)], "v string")
    got = {r["v"]: r["code"] for r in dense_codes(words, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(f"w{i:04d}" for i in range(500)))}


def test_hash_rank_is_a_permutation_per_class(spark, skewed, many_ranges):
    df, _ = skewed
    rows = df.select("id", (F.col("id") % 3).alias("c"), hash60(F.col("id"), 42).alias("h"))
    ranked = hash_rank(rows, "id", ["c"]).join(rows.drop("c"), "id").toPandas().sort_values(["c", "h"])
    for _, part in ranked.groupby("c"):
        assert part["hash_rank"].tolist() == list(range(2000))


@pytest.mark.parametrize("need", [0, 1, 777, 6000, 99999])
def test_fixed_size_is_exact_and_takes_the_smallest_hashes(spark, skewed, need):
    df, _ = skewed
    got = {r["id"] for r in sampling.fixed_size(df, "id", need).collect()}
    order = df.select("id", hash60(F.col("id"), 42).alias("h")).toPandas().sort_values(["h", "id"])
    assert got == set(order["id"][:need])


def test_quota_per_class_drops_other_classes(spark, skewed):
    df, _ = skewed
    rows = df.withColumn("c", F.col("id") % 3)
    quotas = spark.createDataFrame([(0, 10), (1, 5000)], "c int, need int")
    got = keep_first_by_hash(rows, "id", quotas, ["c"]).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {0: 10, 1: 2000}


def test_results_do_not_depend_on_partitioning(spark, skewed):
    df, _ = skewed
    for n in (1, 7):
        parts = df.repartition(n)
        assert exact_quantiles(parts, "x", [0.77]).first()[0] == exact_quantiles(df, "x", [0.77]).first()[0]
        a = {r["id"] for r in sampling.fixed_size(parts, "id", 100).collect()}
        assert a == {r["id"] for r in sampling.fixed_size(df, "id", 100).collect()}


def test_folds_cover_all_rows_and_are_even(spark, skewed):
    df, _ = skewed
    folds = sampling.stratified_folds(df.withColumn("y", (F.col("id") % 5 == 0).cast("int")), "id", "y", 4)
    assert folds.columns[-1] == "fold" and len(folds.columns) == 5
    sizes = folds.groupBy("y", "fold").count().toPandas()
    assert sizes["count"].sum() == 6000
    assert sizes.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1
