"""Model jobs held against their stored parts: scores recomputed in numpy, searches, sketches, densities."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clickloom.operators import encoding, metrics, models, profile, sampling, sketches
from clickloom.state import settle

N = 1500


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(N, 2))
    user = rng.integers(0, 40, N)
    liking = rng.normal(size=40) * 1.5
    y = (rng.random(N) < 1 / (1 + np.exp(1.2 - x[:, 0] + 0.5 * x[:, 1] ** 2 - liking[user]))).astype(int)
    return x, user, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, user, y = data
    return settle(spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), f"u{user[i]:02d}", i) for i in range(N)],
                                        "id int, clicked int, a double, b double, user string, t int").withColumn("time", F.timestamp_seconds(F.col("t") * 60)), "rows")


def probabilities(rows, model):
    return np.array([r["p"] for r in models.score(rows, model, ["id"]).orderBy("id").collect()])


def average_precision(y, p):
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    return (hits / np.arange(1, len(y) + 1))[y[order] == 1].mean()


def test_linear_scores_come_from_the_stored_coefficients(rows, data):
    x, _, y = data
    model = models.fit(rows, ["a", "b"], models.linear(10))
    fitted = model.stages[-1]
    p = probabilities(rows, model)
    assert np.allclose(p, 1 / (1 + np.exp(-(x @ fitted.coefficients.toArray() + fitted.intercept))))
    assert average_precision(y, p) > y.mean() * 1.2


def tree_value(text, row):
    """Value of one row in the printed form of a tree."""
    lines = [(len(s) - len(s.lstrip()), s.strip()) for s in text.splitlines()[1:] if s.strip()]
    i = 0
    while True:
        depth, line = lines[i]
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, op, value = re.match(r"If \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line).groups()
        met = row[int(feature)] <= float(value) if op == "<=" else row[int(feature)] > float(value)
        if met:
            i += 1
        else:
            i = next(j for j in range(i + 1, len(lines)) if lines[j][0] == depth and lines[j][1].startswith("Else")) + 1


def test_boosted_scores_come_from_the_stored_trees(rows, data):
    x, _, y = data
    model = models.fit(rows, ["a", "b"], models.boosted_trees(rounds=5, depth=3))
    fitted = model.stages[-1]
    texts, weights = [t.toDebugString for t in fitted.trees], fitted.treeWeights
    p = probabilities(rows, model)
    for i in range(0, N, 10):
        margin = sum(w * tree_value(t, x[i]) for t, w in zip(texts, weights, strict=True))
        assert abs(p[i] - 1 / (1 + np.exp(-2 * margin))) < 1e-9
    assert average_precision(y, p) > y.mean() * 1.3


def test_factor_machine_on_fields(spark, rows, data):
    """Scores from the stored factors; users lift the ranking; unseen and null users have a slot of their own."""
    x, user, y = data
    codes = encoding.fit_codes(rows.where("user <> 'u07'"), ["user"])

    def coded(df):
        return encoding.apply_codes(df, codes, ["user"], spread=["id"]).withColumn("user", (F.col("user") + 1).cast("double"))

    train = coded(rows.where("user <> 'u07'"))
    model = models.field_model(train, ["user"], ["a", "b"], models.factor_machine(factors=3, rounds=60, step=0.1))
    fitted = model.stages[-1]
    offsets, (size,) = models.field_offsets(model), [n + 1 for n in model.stages[0].categorySizes]
    known = len(set(user)) - 1
    assert offsets == [0] and size == known + 2
    # An unseen user is slot 0; a code that the encoder has not seen goes to the last slot.
    odd = spark.createDataFrame([(9001, 0.3, -1.0, "u07", None), (9002, 0.3, -1.0, None, None), (9003, 0.3, -1.0, "u01", 999.0)], "id int, a double, b double, user string, put double")
    test = coded(odd).withColumn("user", F.coalesce("put", "user")).drop("put").unionByName(train.select("id", "a", "b", "user"))
    scored = model.transform(test).select("id", vector_to_array("features").alias("v"), F.element_at(vector_to_array("probability"), 2).alias("p")).orderBy("id").collect()
    v = np.array([r["v"] for r in scored])
    assert (v[:, :size].sum(1) == 1).all() and v.shape[1] == size + 2
    assert [np.flatnonzero(r[:size])[0] for r in v[-3:]] == [0, 0, size - 1]
    factors, linear = fitted.factors.toArray(), fitted.linear.toArray()
    pairs = 0.5 * ((v @ factors) ** 2 - (v**2) @ (factors**2)).sum(1)
    assert np.allclose([r["p"] for r in scored], 1 / (1 + np.exp(-(fitted.intercept + v @ linear + pairs))), atol=1e-9)
    mine = np.array([r["id"] for r in scored[:-3]])
    p = np.array([r["p"] for r in scored[:-3]])
    plain = probabilities(rows, models.fit(rows, ["a", "b"], models.factor_machine(3, 60, 0.1)))[mine]
    assert average_precision(y[mine], p) > max(1.3 * y[mine].mean(), average_precision(y[mine], plain))


def test_search_over_time(spark, rows, data):
    x, _, y = data
    candidates = {"weak": models.linear(10, 0.001), "flat": models.linear(10, 1000.0)}
    best, table = models.search_over_time(rows, ["a", "b"], candidates, "time", "id", splits=3)
    got = {(r["split"], r["candidate"]): r for r in table.collect()}
    block = {r["id"]: r["block"] for r in sampling.time_blocks(rows, "time", 4).collect()}
    blocks = np.array([block[i] for i in range(N)])
    assert set(got) == {(k, c) for k in (1, 2, 3) for c in candidates}
    for k in (1, 2, 3):
        for name, learner in candidates.items():
            assert (got[k, name]["train_rows"], got[k, name]["valid_rows"]) == ((blocks < k).sum(), (blocks == k).sum())
            early = {i for i in range(N) if blocks[i] < k}
            model = models.fit(rows.where(F.col("id").isin(*early)), ["a", "b"], learner)
            held = models.score(rows.where(F.col("id").isin(*np.flatnonzero(blocks == k).tolist())), model, ["clicked"])
            assert abs(metrics.evaluate(held, "clicked", "p").first()["score"] - got[k, name]["score"]) < 1e-9
    means = {c: np.mean([got[k, c]["score"] for k in (1, 2, 3)]) for c in candidates}
    assert {r["candidate"] for r in table.where("best").collect()} == {max(means, key=means.get)} == {"weak"}
    whole = models.fit(rows, ["a", "b"], candidates["weak"])
    assert np.allclose(best.stages[-1].coefficients.toArray(), whole.stages[-1].coefficients.toArray())


def test_search_over_time_without_clicks_in_a_block(spark, rows):
    few = rows.withColumn("clicked", F.when(F.col("id") < 900, F.col("clicked")).otherwise(0))
    _, table = models.search_over_time(few, ["a"], {"one": models.linear(3)}, "time", "id", splits=3)
    assert {r["split"]: r["score"] is None for r in table.collect()} == {1: False, 2: False, 3: True}
    with pytest.raises(ValueError, match="both classes"):
        models.search_over_time(rows.withColumn("clicked", F.lit(0)), ["a"], {"one": models.linear(3)}, "time", "id")


def test_sketches_of_parts(spark):
    df = spark.range(60_000).selectExpr("id", "cast(id % 9000 as string) AS c", "CASE WHEN id % 3 > 0 THEN id * 1.0D END AS x", "cast(NULL AS double) AS none")
    parts = settle(sketches.sketch_parts(df, F.col("id") % 10, ["c"], ["x", "none"]), "parts")
    assert parts.count() == 30
    for days in (10, 4):
        held = df.where(F.col("id") % 10 < days)
        whole = sketches.merged(parts.where(F.col("part") < days))
        exact = held.select("c").distinct().count()
        assert abs(sketches.distinct_counts(whole).first()["distinct"] - exact) <= sketches.COUNT_ERROR * exact
        values = np.array(sorted(r["x"] for r in held.where("x is not null").collect()))
        for r in sketches.quantiles(whole, [0.1, 0.5, 0.999]).collect():
            assert r["column"] == "x" and abs(np.searchsorted(values, r["value"]) / len(values) - r["q"]) <= sketches.RANK_ERROR
    assert sketches.merged(parts.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 50, 3000])
def test_density_equals_the_direct_sum(spark, n):
    rng = np.random.default_rng(n)
    x = np.r_[rng.gamma(1.0, 30.0, n).round(1), 4000.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    got = profile.density(df, "x").orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["x_at"] for r in got], grid) and np.allclose([r["density"] for r in got], want, atol=1e-14)
    plan = profile.density(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("values", [[], [3.0], [3.0, 3.0]])
def test_density_without_spread_is_null(spark, values):
    got = profile.density(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    assert len(got) == 200 and all(r["density"] is None for r in got)
