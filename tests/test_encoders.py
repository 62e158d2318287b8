from collections import defaultdict
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from clickloom.functions import casts, numeric
from clickloom.functions.hashing import affine_fold, blake2b_bucket
from clickloom.operators import encoding, scaling, target_encoding as te


def fold():
    return affine_fold(F.col("i"))


def te_rows():
    """Categories seen 1, 19 and 20 times, a frequent one, a missing one and one in a single fold."""
    keys = ["once"] + ["nineteen"] * 19 + ["twenty"] * 20 + [None] * 25 + ["often"] * 300
    rows = [(i, k, i * 7 % 3 % 2) for i, k in enumerate(keys)]
    same_fold = [i for i in range(1000, 1400) if (i * 104729 + 42) % 5 == 2][:30]
    return rows + [(i, "one_fold", 1) for i in same_fold]


def brute_te(rows):
    s, n, fs, fn = (defaultdict(float) for _ in range(4))
    raw = defaultdict(int)
    for _, k, _y in rows:
        raw[k or "__NA__"] += 1
    level = lambda k: "__RARE__" if 0 < raw[k or "__NA__"] < 20 else (k or "__NA__")
    for i, k, y in rows:
        f = (i * 104729 + 42) % 5
        s[level(k)] += y
        n[level(k)] += 1
        fs[level(k), f] += y
        fn[level(k), f] += 1
    prior = sum(y for *_, y in rows) / len(rows)
    smooth = lambda a, b: (a + 50 * prior) / (b + 50) if b > 0 else prior
    oof = {}
    for i, k, _y in rows:
        f = (i * 104729 + 42) % 5
        oof[i] = smooth(s[level(k)] - fs[level(k), f], n[level(k)] - fn[level(k), f])
    return oof, lambda k: smooth(s[level(k)], n[level(k)]) if raw[k or "__NA__"] else prior


def test_encoding_equals_a_plain_loop(spark):
    rows = te_rows()
    df = spark.createDataFrame(rows, "i int, k string, y int")
    enc = te.fit(df, ["k"], "y", fold())
    oof, full = brute_te(rows)
    for limits in ({}, {"limit": 0}):
        got = te.apply_train(df, enc, fold(), ["i"], **limits).collect()
        assert len(got) == len(rows) and all(abs(r["k_te"] - oof[r["i"]]) < 1e-12 for r in got)
        new = spark.createDataFrame([(0, "often"), (1, "unseen"), (2, None), (3, "once"), (4, "one_fold")], "i int, k string")
        for r in te.apply_full(new, enc, ["i"], **limits).collect():
            assert abs(r["k_te"] - full(r["k"])) < 1e-12


def test_own_fold_labels_do_not_matter(spark):
    """Swapping labels inside one fold leaves that fold's encodings as they were."""
    rows = te_rows()
    mine = [r for r in rows if (r[0] * 104729 + 42) % 5 == 2]
    labels = dict(zip((r[0] for r in mine), (r[2] for r in reversed(mine))))
    swapped = [(i, k, labels.get(i, y)) for i, k, y in rows]
    assert swapped != rows
    got = []
    for data in (rows, swapped):
        df = spark.createDataFrame(data, "i int, k string, y int")
        out = te.apply_train(df, te.fit(df, ["k"], "y", fold()), fold())
        got.append({r["i"]: r["k_te"] for r in out.collect() if r["i"] in labels})
    assert got[0] == got[1]


def test_rare_limit_and_unseen_values(spark):
    rows = [("a",)] * 49 + [("b",)] * 50 + [("c",)] * 51 + [(None,)] * 3
    train = spark.createDataFrame(rows, "c string")
    rare = encoding.rare_levels(train, ["c"])
    test = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    got = [r["c"] for r in encoding.bucket_rare(test, rare, ["c"]).collect()]
    assert sorted(got) == sorted([casts.RARE, "b", "new", casts.NA])
    codes = encoding.fit_codes(encoding.bucket_rare(train, rare, ["c"]), ["c"])
    coded = encoding.apply_codes(test, codes, ["c"]).collect()
    assert sorted(r["c"] for r in coded) == [-1, -1, 2, -1] or sorted(r["c"] for r in coded) == [-1, -1, -1, 2]


def test_one_hot_of_unseen_and_null(spark):
    levels = encoding.dummy_levels(spark.createDataFrame([("a",), ("b",), (None,)], "g string"), ["g"])
    got = encoding.one_hot(spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, g string"), levels).collect()
    assert {r["i"]: (r["g_a"], r["g_b"]) for r in got} == {1: (1, 0), 2: (0, 0), 3: (0, 0)}


def test_normal_inverse_matches_the_standard_library(spark):
    ps = [1e-7, 1e-5, 0.01, 0.07, 0.075, 0.3, 0.5, 0.9, 0.925, 0.999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", numeric.normal_ppf(F.col("p")).alias("z"))
    for r in df.collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-9


def brute_quantile(train, values, points=512):
    x = np.sort(train)
    k = min(points, len(x))
    ref = np.linspace(0, 1, k)
    q = np.quantile(x, ref)
    out = []
    for v in values:
        if v + 1e-7 > q[-1]:
            u = 1.0
        elif v - 1e-7 < q[0]:
            u = 0.0
        else:
            u = 0.5 * (np.interp(v, q, ref) - np.interp(-v, -q[::-1], -ref[::-1]))
        out.append(NormalDist().inv_cdf(min(max(u, 1e-7), 1 - 1e-7)))
    return out


def test_quantile_transform(spark):
    rng = np.random.default_rng(1)
    big, few = np.round(rng.gamma(1, 20, 3000), 0), rng.normal(size=20)
    train = spark.createDataFrame(
        [(i, float(big[i]), float(few[i]) if i < 20 else None, 1.0 if i == 0 else None) for i in range(3000)],
        "id int, big double, few double, single double",
    )
    fitted = scaling.fit_quantiles(train, ["big", "few", "single"])
    probe = [0.0, 1.0, 2.0, 15.0, 37.5, 1000.0, -5.0]
    test = spark.createDataFrame([(i, v, v / 10, v) for i, v in enumerate(probe)] + [(99, None, None, None)],
                                 "id int, big double, few double, single double")
    got = scaling.apply_quantiles(test, fitted, ["big", "few", "single"]).orderBy("id").collect()
    assert np.allclose([r["big"] for r in got[:-1]], brute_quantile(big, probe), atol=1e-6)
    assert np.allclose([r["few"] for r in got[:-1]], brute_quantile(few, [v / 10 for v in probe]), atol=1e-6)
    assert [r["single"] for r in got[:-1]] == probe and got[-1]["big"] is None
    by_value = sorted((v, r["big"]) for v, r in zip(probe, got))
    assert all(a[1] <= b[1] for a, b in zip(by_value, by_value[1:]))


def test_log_edges(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(numeric.log_plus_one(F.col("x"))).collect()]
    assert got[0] is None and got[1] is None and got[2] == 0 and abs(got[3] - np.log(2)) < 1e-12 and got[4] is None


def test_blake2b_bucket(spark):
    import hashlib

    df = spark.range(50).select("id", blake2b_bucket(F.col("id"), 10).alias("b"))
    for r in df.collect():
        assert r["b"] == int(hashlib.blake2b(str(r["id"]).encode(), digest_size=8).hexdigest(), 16) % 10


def test_no_value_is_lost_in_large_tables(spark):
    df = spark.range(250_000).selectExpr("id", "id AS wide", "CASE WHEN id < 5 THEN id * 1.0D END AS sparse", "CAST(id AS double) AS x")
    fitted = {r["column"]: r["quantiles"] for r in scaling.fit_quantiles(df, ["sparse", "x"]).collect()}
    assert fitted["sparse"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert len(fitted["x"]) == 512 and (fitted["x"][0], fitted["x"][-1]) == (0.0, 249_999.0)
    codes = encoding.categorify(df, ["wide"])
    assert codes.count() == 250_000 and codes.agg({"code": "max"}).first()[0] == 250_000
    assert len(encoding.dummy_levels(df.limit(1500), ["wide"])["wide"]) == 1500
