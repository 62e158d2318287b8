"""Lookups of large tables: several columns at once, hot keys, plans."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.functions.casts import na_level
from clickloom.operators import encoding, joins
from clickloom.operators import target_encoding as te
from clickloom.state import settle


@pytest.fixture(scope="module")
def clicks(spark):
    rows = [
        (i, None if i % 11 == 0 else "hot" if i % 3 else f"u{i % 700}", f"g{i % 5}", None if i % 7 == 0 else f"h{i % 24}", int(i % 4 == 0))
        for i in range(4000)
    ]
    return settle(spark.createDataFrame(rows, "i int, user string, g string, h string, y int"), "clicks")


CATS = ["user", "g", "h"]


def fold():
    return F.pmod(F.col("i"), F.lit(5))


def by_id(df):
    return df.toPandas().sort_values("i", ignore_index=True)


@pytest.fixture(scope="module")
def fitted(clicks):
    return te.fit(clicks.where("i < 3000"), CATS, "y", fold())


@pytest.mark.parametrize("limits", [{"limit": 0}, {"limit": 20}])
def test_encodings_by_shuffle_equal_those_by_broadcast(clicks, fitted, limits):
    new = clicks.where("i >= 2500").withColumn("user", F.when(F.col("i") % 10 == 3, "never seen").otherwise(F.col("user")))
    train = clicks.where("i < 3000")
    pd.testing.assert_frame_equal(by_id(te.apply_full(new, fitted, ["i"])), by_id(te.apply_full(new, fitted, ["i"], **limits)))
    pd.testing.assert_frame_equal(
        by_id(te.apply_train(train, fitted, fold(), ["i"])), by_id(te.apply_train(train, fitted, fold(), ["i"], **limits))
    )
    hot = joins.hot_levels(new, {c: na_level(c) for c in CATS})
    assert {"never seen"} < {r["key"] for r in hot.collect()}
    pd.testing.assert_frame_equal(by_id(te.apply_full(new, fitted, ["i"])), by_id(te.apply_full(new, fitted, ["i"], hot=hot, **limits)))


def test_codes_and_rare_levels_by_shuffle(clicks):
    rare = encoding.rare_levels(clicks, CATS)
    leveled = encoding.bucket_rare(clicks, rare, CATS, ["i"])
    pd.testing.assert_frame_equal(by_id(leveled), by_id(encoding.bucket_rare(clicks, rare, CATS, ["i"], limit=0)))
    codes = encoding.fit_codes(leveled, CATS)
    pd.testing.assert_frame_equal(by_id(encoding.apply_codes(leveled, codes, CATS)), by_id(encoding.apply_codes(leveled, codes, CATS, spread=["i"], limit=0)))


def test_rows_move_once_for_several_columns(spark, clicks, fitted):
    """The wide rows are read and shuffled once, their keys once more as short rows; nothing runs while planning."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = clicks.withColumn("_wide", F.lit("x"))
        before = spark.sparkContext.statusTracker().getJobIdsForGroup()
        assert fitted.sizes
        out = te.apply_full(wide, fitted, ["i"], limit=0)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in plan.splitlines() if "Relation" in line and "user#" in line]
        assert len(scans) == 2, plan
        physical = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in physical.splitlines() if "Exchange hashpartitioning(i#" in line]
        assert len(exchanges) == 2 and sum("_salt#" in line for line in physical.splitlines() if "Exchange hashpartitioning" in line) == 2, physical
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_chained_lookups_run_no_job_over_the_rows(spark, clicks):
    table = settle(clicks.where("user is not null").groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")), "users")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(x):
        seen.add(1)
        return x

    rows = clicks.withColumn("t", touch("i"))
    for k in range(3):
        rows = joins.lookup_join(rows, table.withColumnsRenamed({"n": f"n{k}", "m": f"m{k}"}), ["user"], f"n{k}", ["i"], limit=0, rows=table.count())
    assert seen.value == 0
    assert rows.count() == clicks.count()


def test_wide_tables_are_not_broadcast(spark):
    narrow = spark.range(100).selectExpr("cast(id as string) AS column", "id AS n")
    wide = narrow.withColumn("key", F.repeat(F.lit("x"), 100_000))
    assert joins.lookup_size(narrow) == 100 and joins.lookup_size(wide) > 60_000
    assert joins.lookup_size(wide.limit(0)) == 0
