import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics, models, segments
from clickloom.operators.joins import lookup_join
from clickloom.state import new_path, settle
from clickloom.streaming.scoring import score_arrivals


def brute(y, p):
    y, p = np.array(y), np.clip(np.array(p, float), 1e-6, 1 - 1e-6)
    ap = area = 0.0
    pos, neg = (y == 1).sum(), (y == 0).sum()
    for t in sorted(set(p), reverse=True):
        at = p >= t
        ap += ((y == 1) & (p == t)).sum() / pos * ((y == 1) & at).sum() / at.sum()
        area += ((y == 0) & (p == t)).sum() * (((y == 1) & (p > t)).sum() + ((y == 1) & (p == t)).sum() / 2)
    wll = 0.5 * -np.log(p[y == 1]).mean() + 0.5 * -np.log(1 - p[y == 0]).mean()
    return ap, area / (pos * neg), wll, 0.5 * ap + 0.5 / (1 + wll)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(800) < 0.2).astype(int)
    p = np.round(np.clip(0.2 * y + rng.random(800) * 0.8, 0, 1), 2)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), y, p


def test_evaluation_equals_a_plain_loop(scored, many_ranges):
    df, y, p = scored
    r = metrics.evaluate(df, "y", "p").first()
    assert np.allclose([r["ap"], r["auc"], r["wll"], r["score"]], brute(y, p))


def test_monotone_scores_rank_alike(scored):
    df, _, _ = scored
    a = metrics.ranking_metrics(df, "y", "p").first()
    b = metrics.ranking_metrics(df.withColumn("p", F.col("p") * 0.5 + 0.1), "y", "p").first()
    assert abs(a["ap"] - b["ap"]) < 1e-12 and abs(a["auc"] - b["auc"]) < 1e-12


def test_one_class_only(spark):
    for y in (0, 1):
        df = spark.createDataFrame([(y, 0.25), (y, 0.5), (y, None)], "y int, p double")
        r = metrics.evaluate(df, "y", "p").first()
        want = np.mean([-math.log(q if y else 1 - q) for q in (0.25, 0.5, 0.5)])
        assert r["ap"] == 0 and r["auc"] is None and abs(r["wll"] - want) < 1e-12


def test_temperature_is_the_best_of_the_grid(scored):
    df, y, p = scored
    p = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    losses = []
    for t in metrics.TEMPERATURES:
        q = np.clip(1 / (1 + np.exp(-z / t)), 1e-9, 1 - 1e-9)
        losses.append(0.5 * -np.log(q[y == 1]).mean() + 0.5 * -np.log(1 - q[y == 0]).mean())
    best = metrics.fit_temperature(df, "y", "p").first()
    assert best["t"] == metrics.TEMPERATURES[int(np.argmin(losses))] and abs(best["wll"] - min(losses)) < 1e-9
    assert best["wll"] <= losses[10] + 1e-12


def segment_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        s = "hot" if i % 3 == 0 else ["a", "b", "c"][i % 5 % 3]
        x = float(rng.normal())
        slope = {"hot": 2.0, "a": -1.0, "b": 0.5, "c": 0.0}[s]
        rows.append((i, s, x, int(rng.random() < 1 / (1 + math.exp(-(slope * x - 0.5))))))
    rows += [(2000 + i, "nine", 0.1 * i, i % 2) for i in range(9)] + [(3000 + i, "ten", 0.1 * i, i % 2) for i in range(10)]
    rows += [(4000 + i, None, 0.3 * i, i % 2) for i in range(5)]
    return rows, spark.createDataFrame(rows, "id int, seg string, x double, y int")


def newton(x, y, steps, ridge):
    a = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(2), np.diag([1e-9, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + pen
        w = w + np.linalg.solve(h, a.T @ (y - p) - pen @ w)
    return w


def test_segment_models_equal_separate_fits(spark):
    rows, df = segment_rows(spark)
    fitted = segments.fit_segments(df, ["seg"], ["x"], "y", steps=6)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    x = (x - x.mean()) / x.std()
    seg = np.array([r[1] or "" for r in rows])
    got = {r["seg"]: (r["w0"], r["w1"]) for r in fitted.weights.collect()}
    assert set(got) == {"hot", "a", "b", "c", "ten"}
    for s, w in got.items():
        assert np.allclose(w, newton(x[seg == s], y[seg == s], 6, 1.0), atol=1e-8)
    whole = fitted.whole.first()
    assert np.allclose([whole["w0"], whole["w1"]], newton(x, y, 6, 1.0), atol=1e-8)

    new = spark.createDataFrame([(1, "hot", 0.0), (2, "new", 0.0), (3, None, 0.0), (4, "nine", 0.0)], "id int, seg string, x double")
    p = {r["id"]: r for r in segments.score_segments(new, fitted, ["id"]).collect()}
    assert p[1]["own_model"] and not p[2]["own_model"] and p[2]["p"] == p[3]["p"] == p[4]["p"] != p[1]["p"]
    q = {r["id"]: r["p"] for r in segments.score_segments(new, fitted, ["id"], null_segment="default").collect()}
    assert q[3] == 0.5 and q[2] == p[2]["p"]


def test_weighting_and_scores(spark):
    _, df = segment_rows(spark)
    rows = df.withColumnRenamed("y", "clicked").withColumn("x2", F.col("x") * F.col("x"))
    weights = models.with_weight(rows).groupBy("clicked").agg(F.sum("weight").alias("w")).collect()
    assert abs(weights[0]["w"] - weights[1]["w"]) < 1e-6
    scored = models.score(rows, models.fit(rows, ["x", "x2"], models.linear(5)), ["id", "clicked"])
    assert scored.where("p <= 0 OR p >= 1 OR p IS NULL").count() == 0 and scored.count() == rows.count()


def test_stream_equals_batch_and_restarts_without_repeats(spark):
    table = settle(spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5)], "k string, v double, n int"))
    source, sink, marks = (new_path(spark, n) for n in ("source", "sink", "marks"))

    def scorer(df):
        return lookup_join(df, table, ["k"], "n").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))

    first = spark.range(0, 100).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("k"))
    first.repartition(4).write.parquet(source)
    schema = first.schema
    out = score_arrivals(spark, source, schema, scorer, sink, marks, files_per_batch=2)
    assert out.count() == 100
    second = first.withColumn("id", F.col("id") + 100)
    second.repartition(2).write.mode("append").parquet(source)
    out = score_arrivals(spark, source, schema, scorer, sink, marks)
    batch = scorer(spark.read.schema(schema).parquet(source))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_auc_of_margins_and_tiny_scores(spark):
    for scores in ([3.0, 2.0, -1.0, -2.0], [0.4, 3e-7, 2e-7, 1e-8]):
        df = spark.createDataFrame(list(zip([1, 1, 0, 0], scores, strict=True)), "y int, p double")
        row = metrics.ranking_metrics(df, "y", "p").first()
        assert (row["auc"], row["ap"]) == (1.0, 1.0)


def test_segment_models_with_sixty_features(spark, monkeypatch):
    """Weights equal those of a direct solve per segment, also when partial sums are handed on early."""
    rng = np.random.default_rng(4)
    n, d = 3000, 60
    x = rng.normal(size=(n, d))
    seg = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 9, n))
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, :3].sum(1)))).astype(int)
    names = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(int(i), f"s{s}" if s < 8 else None, int(t), *map(float, r)) for i, (s, t, r) in enumerate(zip(seg, y, x))], ["id", "seg", "y", *names])
    z = np.c_[np.ones(n), (x - x.mean(0)) / x.std(0)]

    def direct(rows):
        w, penalty = np.zeros(d + 1), np.diag([1e-9] + [2.0] * d)
        for _ in range(4):
            p = 1 / (1 + np.exp(-z[rows] @ w))
            w = w + np.linalg.solve((z[rows] * (p * (1 - p))[:, None]).T @ z[rows] + penalty, z[rows].T @ (y[rows] - p) - penalty @ w)
        return w

    monkeypatch.setattr(segments, "HELD_BYTES", 1)
    fitted = segments.fit_segments(df.repartition(5), ["seg"], names, "y", steps=4, ridge=2.0)
    names = [f"w{i}" for i in range(d + 1)]
    got = {r["seg"]: np.array([r[w] for w in names]) for r in fitted.weights.collect()}
    assert set(got) == {f"s{s}" for s in range(8)}
    for s in range(8):
        assert np.allclose(got[f"s{s}"], direct(seg == s), atol=1e-8)
    assert np.allclose(np.array(fitted.whole.select(*names).first()), direct(np.full(n, True)), atol=1e-8)
