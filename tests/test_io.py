from pyspark.sql import functions as F

from clickloom.operators import sampling
from clickloom.sources import readers, writers
from clickloom.state import new_path


def test_row_index_over_many_files(spark, monkeypatch):
    path = new_path(spark, "files")
    spark.range(1000).repartition(7).write.parquet(path)
    for most in (readers.MOST_FILES, 0):
        monkeypatch.setattr(readers, "MOST_FILES", most)
        rows = readers.with_row_index(spark, path)
        assert rows.columns == ["id", "row_index"]
        assert sorted(r["row_index"] for r in rows.collect()) == list(range(1000))
        placed = spark.read.parquet(path).select("id", F.col("_metadata.file_path").alias("f")).join(rows, "id")
        spans = placed.groupBy("f").agg(F.min("row_index").alias("a"), F.max("row_index").alias("b")).orderBy("f").collect()
        assert all(x["b"] + 1 == y["a"] for x, y in zip(spans, spans[1:]))


def test_null_keys_belong_to_no_group_file(spark):
    path = new_path(spark, "groups")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    writers.write_by_group(df, path, ["k"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_stage_is_built_once(spark):
    path, calls = new_path(spark, "stage"), []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(3):
        table, _built = writers.stage(spark, path, build)
        assert table.count() == 5
    assert calls == [1]


def test_only_large_groups_are_cut(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 > 0, "small").alias("k"))
    want = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    got = {r["k"]: r["count"] for r in sampling.per_key_cap(df, "id", ["k"], 500).groupBy("k").count().collect()}
    assert want["small"] > 500 and got == {"big": want["big"], "small": 500, None: want[None]}


def test_half_written_stage_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "half")
    spark.range(10).repartition(2).write.parquet(path)
    (tmp_path / "half" / "_SUCCESS").unlink()
    out, built = writers.stage(spark, path, lambda: spark.range(7))
    assert built and out.count() == 7
    assert writers.stage(spark, path, lambda: spark.range(3))[1] is False
