"""Micro-batch scoring: batch equality, restart after a killed batch, tables that do not move."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clickloom.operators import joins
from clickloom.state import new_path, open_bucketed, settle, settle_bucketed
from clickloom.streaming.scoring import score_arrivals

SCHEMA = "id long, k long"


@pytest.fixture(scope="module")
def users(spark):
    table = spark.range(500).selectExpr("id AS k", "CASE WHEN id = 7 THEN 100000 ELSE 1 + id % 9 END AS n", "id * 0.5D AS v")
    return settle_bucketed(table, ["k"], 16, "users")


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows has one key, some keys are null or unknown."""
    return settle(spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 700 END AS k").repartition(6), "rows")


def answer(df):
    return sorted((r["id"], r["v"]) for r in df.select("id", "v").collect())


def wanted(rows):
    return sorted((r["id"], r["k"] * 0.5 if r["k"] is not None and r["k"] < 500 else None) for r in rows.collect())


def test_bucketed_table_does_not_move(spark, rows, users, many_ranges):
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for partitions in ("8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = joins.lookup_bucketed(rows, users, ["k"], "n")
            assert answer(out) == wanted(rows)
            plan = out._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.index("SortMergeJoin"):]
            right = join[join.index("SortMergeJoin"):].split("\n")
            # The join's second input is the bucketed scan itself, with no exchange of its own.
            scans = [i for i, line in enumerate(right) if "Bucketed: true" in line]
            assert scans and plan.count("Exchange hashpartitioning") == 1, plan
        parts = joins.lookup_bucketed(rows, users, ["k"], "n").where("k <> 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert parts < 700
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_bucketed_table_in_another_session(spark, rows, users):
    path = users.inputFiles()[0].rsplit("/", 1)[0]
    again = open_bucketed(spark.newSession(), path, "k bigint, n bigint, v double", ["k"], 16)
    assert again.count() == 500
    assert len(users.inputFiles()) <= 16


def test_restart_after_a_killed_batch(spark, rows, users):
    """A run dies after a batch has been written but before it is committed: nothing comes twice, nothing is lost."""
    source, sink, checkpoint = (new_path(spark, n) for n in ("source", "sink", "offsets"))
    rows.write.parquet(source)
    calls = []

    def scorer(df, broken=False):
        calls.append(1)
        out = joins.lookup_bucketed(df, users, ["k"], "n")
        if broken and len(calls) == 4:
            spark.createDataFrame([(-1, None)], "id long, v double").write.mode("overwrite").parquet(f"{sink}/batch=2")
            raise RuntimeError("killed")
        return out.select("id", "v")

    with pytest.raises(StreamingQueryException):
        score_arrivals(spark, source, rows.schema, lambda df: scorer(df, True), sink, checkpoint, files_per_batch=1)
    assert 0 < spark.read.parquet(f"{sink}/batch=*").count() < 3000
    out = score_arrivals(spark, source, rows.schema, scorer, sink, checkpoint, files_per_batch=1)
    assert answer(out) == wanted(rows)
    # Nothing new: nothing is scored again. New files: only they are.
    before = len(calls)
    assert score_arrivals(spark, source, rows.schema, scorer, sink, checkpoint).count() == 3000 and len(calls) == before + 1
    spark.createDataFrame([(9000, 4)], SCHEMA).write.mode("append").parquet(source)
    out = score_arrivals(spark, source, rows.schema, scorer, sink, checkpoint)
    assert out.count() == 3001 and out.where("id = 9000").first()["v"] == 2.0


def test_no_file_has_arrived(spark, rows):
    source = new_path(spark, "source")
    rows.limit(0).write.parquet(source)
    out = score_arrivals(spark, source, rows.schema, lambda df: df.withColumn("v", F.lit(1.0)), new_path(spark, "sink"), new_path(spark, "offsets"))
    assert out.count() == 0 and out.columns == ["id", "k", "v"]
