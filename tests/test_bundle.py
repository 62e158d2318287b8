"""Published fits: whole or refused."""

import pytest
from pyspark.sql import functions as F

from clickloom import bundle
from clickloom.operators import models
from clickloom.state import new_path


@pytest.fixture
def root(spark):
    return new_path(spark, "bundles")


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.range(200).selectExpr("id", "cast(id % 2 as int) AS clicked", "id * 1.0D AS x")
    return models.fit(rows, ["x"], models.linear(rounds=2))


def test_round_trip_of_all_kinds(spark, root, model):
    tables = {"a": spark.range(10).withColumn("s", F.lit("é")), "empty": spark.range(0)}
    version = bundle.publish(spark, root, tables, {"m": model}, {"vocabulary": [3, 1], "limits": {"rare": 50}})
    got = bundle.load(spark, root)
    assert got.version == version and got.values == {"vocabulary": [3, 1], "limits": {"rare": 50}}
    assert got.tables["a"].dtypes == tables["a"].dtypes and got.tables["a"].count() == 10 and got.tables["empty"].count() == 0
    assert got.models["m"].stages[-1].coefficients == model.stages[-1].coefficients


def test_the_last_published_counts(spark, root):
    versions = [bundle.publish(spark, root, {"a": spark.range(n)}) for n in (1, 2, 3)]
    assert bundle.load(spark, root).tables["a"].count() == 3
    assert bundle.load(spark, root, versions[0]).tables["a"].count() == 1
    assert {r["version"] for r in bundle.published(spark, root).collect()} == set(versions)


def test_a_bundle_without_manifest_is_not_there(spark, root, monkeypatch):
    with pytest.raises(bundle.NotPublished):
        bundle.load(spark, root)
    whole = bundle.publish(spark, root, {"a": spark.range(5)})

    class Broken:
        def write(self):
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        bundle.publish(spark, root, {"a": spark.range(9)}, {"m": Broken()})
    assert bundle.load(spark, root).version == whole and bundle.load(spark, root).tables["a"].count() == 5
    with pytest.raises(bundle.NotPublished):
        bundle.load(spark, root, "other")


def test_parts_that_do_not_match_the_manifest_are_refused(spark, root):
    version = bundle.publish(spark, root, {"a": spark.range(5), "b": spark.range(5)})
    spark.range(1).write.mode("append").parquet(f"{root}/{version}/tables/a")
    with pytest.raises(bundle.NotPublished, match="table a .* 6 rows"):
        bundle.load(spark, root)
