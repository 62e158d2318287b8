import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from clickloom.functions import casts, sequences
from clickloom.plans import features

TEXTS = [None, "", " ", "5", "x", "1,x, 2,", "3,3,3,1,1,2", "1,2,1,2", ",".join(str(i % 37) for i in range(900)),
         ",".join(str(i * i % 11) for i in range(60)), "-4,-4,9000000000"]


def brute(text):
    ids = []
    for t in (text or "").split(","):
        try:
            ids.append(int(t))
        except ValueError:
            pass
    n = len(ids)
    if n == 0:
        return ids, [0] * 10
    c = Counter(ids)
    top = c.most_common(2)
    last = {v: i for i, v in enumerate(ids)}
    run = best = 1
    for a, b in zip(ids, ids[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return ids, [
        n, len(c), len(c) / n, top[0][0], top[0][1] / n, top[1][1] / n if len(top) > 1 else 0, ids[-1],
        -sum(v / n * math.log(v / n + 1e-12) for v in c.values()), best,
        sum(2 ** (-(n - 1 - i) / 10) for i in last.values()),
    ]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, seq string")


def test_statistics_match_a_plain_loop(spark):
    df = features.with_sequence_features(rows(spark), [1, 2, 3], 16, "blake2b")
    for r in df.collect():
        ids, want = brute(TEXTS[r["k"]])
        got = [r[c] for c in sequences.STAT_COLUMNS]
        assert all(abs(g - w) < 1e-9 for g, w in zip(got, want)), (r["k"], got, want)
        counts, n = Counter(ids), max(len(ids), 1)
        assert all(abs(r["ratio"][i] - counts[v] / n) < 1e-12 for i, v in enumerate([1, 2, 3]))
        bag = [0.0] * 16
        for v, c in counts.items():
            bag[int(hashlib.blake2b(str(v).encode(), digest_size=8).hexdigest(), 16) % 16] += c / n
        assert all(abs(a - b) < 1e-12 for a, b in zip(r["bag"], bag))


def test_bag_sums_to_one_and_ratios_to_at_most_one(spark):
    df = features.with_sequence_features(rows(spark), [1, 2, 3], 128)
    for r in df.collect():
        assert abs(sum(r["bag"]) - (1 if r["seq_len"] else 0)) < 1e-9
        assert sum(r["ratio"]) <= 1 + 1e-9


def test_filter_on_a_feature_keeps_results(spark):
    df = features.with_sequence_features(rows(spark), [1], 8)
    kept = {r["k"] for r in df.where("entropy > 1 AND rep_run_max < 3").select("k").collect()}
    want = {k for k, t in enumerate(TEXTS) if brute(t)[1][7] > 1 and brute(t)[1][8] < 3}
    assert kept == want


def test_parsers(spark):
    df = rows(spark).where("k < 8").select(
        "k", casts.ids_lenient("seq").alias("lenient"), casts.ids_or_null("seq").alias("nullable"),
        F.size(casts.tokens("seq")).alias("n"),
    )
    got = {r["k"]: r for r in df.collect()}
    assert got[0]["lenient"] == [] and got[0]["nullable"] is None and got[0]["n"] is None
    assert got[1]["lenient"] == [] and got[1]["n"] == 1
    assert got[5]["lenient"] == [1, 2] and got[5]["nullable"] == [1, None, 2, None]


def test_strict_parser_rejects_bad_text(spark):
    import pytest

    ok = spark.createDataFrame([("1,,2",), (None,)], "seq string").select(casts.ids_strict("seq").alias("v"))
    assert [r["v"] for r in ok.collect()] == [[1, 2], []]
    bad = spark.createDataFrame([("1,x",)], "seq string").select(casts.ids_strict("seq"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.collect()


def test_ends_means_and_bins(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([7],), ([None, 3],), ([],)], "a array<int>")
    got = df.select(
        sequences.last_mean(F.col("a"), 3).alias("m"), sequences.at_end(F.col("a"), 2).alias("e")
    ).collect()
    assert [tuple(r) for r in got] == [(3.0, 3), (7.0, -1), (3.0, -1), (None, -1)]
    lengths = spark.createDataFrame([(n,) for n in (1, 49, 50, 51, 200, 201, 500, 501, None)], "n int")
    bins = [r[0] for r in lengths.select(sequences.length_bin(F.col("n"))).collect()]
    assert bins == ["0-50", "0-50", "0-50", "51-200", "51-200", "201-500", "201-500", "500+", "500+"]
