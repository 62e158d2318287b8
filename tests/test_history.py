import datetime as dt
import random

from clickloom.sources.impressions import with_history


def test_history_of_a_busy_user_equals_a_plain_loop(spark, many_ranges):
    """One user holds a third of the rows; slices are far shorter than the history."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    data = [
        (i, 1 if i % 3 == 0 else rng.randrange(2, 40), start + dt.timedelta(seconds=rng.randrange(200_000)), str(i % 19))
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "id int, user int, ts timestamp_ntz, token string")
    got = {r["id"]: r["seq"] for r in with_history(df, "user", ["ts", "id"], "token").collect()}
    past, want = {}, {}
    for i, user, ts, token in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        before = past.setdefault(user, [])
        want[i] = ",".join(before[-20:]) or None
        before.append(token)
    assert got == want


def test_null_tokens_users_and_times_like_a_plain_window(spark):
    rows = []
    for i in range(240):
        user = None if i % 3 == 0 else i % 3
        token = None if i % 4 == 0 or user == 2 else str(i)
        rows.append((i, user, None if i % 50 == 7 else 60.0 * i, token))
    df = spark.createDataFrame(rows, "id int, user int, s double, token string").selectExpr(
        "id", "user", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS ts", "token"
    )
    plain = df.selectExpr(
        "id", "array_join(collect_list(struct(token)) OVER (PARTITION BY user ORDER BY ts, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING).token, ',') AS seq"
    )
    want = {r["id"]: r["seq"] or None for r in plain.collect()}
    got = {r["id"]: r["seq"] for r in with_history(df, "user", ["ts", "id"], "token").collect()}
    assert got == want
