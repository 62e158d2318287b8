"""Target encoding, category codes, scaling and the whole feature recipes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from clickloom.functions import casts, numeric
from clickloom.functions.hashing import affine_fold
from clickloom.operators import encoding, scaling, target_encoding
from clickloom.operators import joins
from clickloom.plans import features
from clickloom.plans.catalog.functions import D_EXPLODED, D_ITEMS, D_STATS, REAL_STATS
from clickloom.plans.catalog.registry import D_IDS, ads, d6, duck_hash, logs, query, r6
from clickloom.sources.impressions import CATS, train_test
from clickloom.state import settle

FOLD = affine_fold
D_FOLD = "(event_id * 104729 + 42) % 5"
D_SPLIT = ", train AS (SELECT * FROM impressions WHERE event_id % 5 < 4), test AS (SELECT * FROM impressions WHERE event_id % 5 = 4)"


def _duck_te(cats, source: str = "impressions") -> str:
    """Encoding tables ``oof_<c>`` (key, fold, te) and ``full_<c>`` (key, te) for DuckDB."""
    parts = [f", prior AS (SELECT sum(clicked) / greatest(count(*), 1) AS prior FROM {source})"]
    for c in cats:
        parts.append(f"""
, k_{c} AS (SELECT coalesce(CAST({c} AS VARCHAR), '__NA__') AS key, {D_FOLD} AS fold, clicked FROM {source}),
l_{c} AS (SELECT key, CASE WHEN count(*) < 20 THEN '__RARE__' ELSE key END AS level FROM k_{c} GROUP BY key),
f_{c} AS (SELECT level, fold, sum(clicked) AS fs, count(*) AS fn FROM k_{c} JOIN l_{c} USING (key) GROUP BY 1, 2),
t_{c} AS (SELECT level, sum(fs) AS s, sum(fn) AS n FROM f_{c} GROUP BY 1),
oof_{c} AS (SELECT key, fold, CASE WHEN n - fn > 0 THEN (s - fs + 50 * prior) / (n - fn + 50) ELSE prior END AS te
  FROM l_{c} JOIN f_{c} USING (level) JOIN t_{c} USING (level), prior),
full_{c} AS (SELECT key, (s + 50 * prior) / (n + 50) AS te FROM l_{c} JOIN t_{c} USING (level), prior)""")
    return "".join(parts)


def _duck_te_join(cats, kind: str, rows: str) -> str:
    out = f"FROM {rows} AS i"
    for c in cats:
        on = f"coalesce(CAST(i.{c} AS VARCHAR), '__NA__') = {kind}_{c}.key"
        if kind == "oof":
            on += f" AND (i.event_id * 104729 + 42) % 5 = {kind}_{c}.fold"
        out += f" LEFT JOIN {kind}_{c} ON {on}"
    return out


TE_CATS = [*CATS, "feat_c_2"]


@query(_duck_te(TE_CATS) + " SELECT event_id, " + ", ".join(d6(f"oof_{c}.te") + f" AS {c}_te" for c in TE_CATS) + " " + _duck_te_join(TE_CATS, "oof", "impressions"))
def target_encoding_out_of_fold(spark, sf):
    """Five small categories and the user id."""
    df = ads(spark, sf)
    fold = FOLD(F.col("event_id"))
    enc = target_encoding.fit(df, TE_CATS, "clicked", fold)
    out = target_encoding.apply_train(df, enc, fold, ["event_id"])
    return out.select("event_id", *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_CATS])


@query(D_SPLIT + _duck_te(TE_CATS, "train") + " SELECT event_id, " + ", ".join(d6(f"coalesce(full_{c}.te, (SELECT prior FROM prior))") + f" AS {c}_te" for c in TE_CATS) + " " + _duck_te_join(TE_CATS, "full", "test"))
def target_encoding_of_new_rows(spark, sf):
    train, test = train_test(ads(spark, sf))
    enc = target_encoding.fit(train, TE_CATS, "clicked", FOLD(F.col("event_id")))
    out = target_encoding.apply_full(test, enc, ["event_id"])
    return out.select("event_id", *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_CATS])


@query(D_SPLIT + _duck_te(TE_CATS, "train") + " SELECT event_id, " + ", ".join(d6(f"coalesce(full_{c}.te, (SELECT prior FROM prior))") + f" AS {c}_te" for c in TE_CATS) + " " + _duck_te_join(TE_CATS, "full", "test"))
def target_encoding_by_shuffle(spark, sf):
    """As for tables too large to broadcast: all six columns are looked up in one shuffle."""
    train, test = train_test(ads(spark, sf))
    enc = target_encoding.fit(train, TE_CATS, "clicked", FOLD(F.col("event_id")))
    out = target_encoding.apply_full(test, enc, ["event_id"], limit=0)
    return out.select("event_id", *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_CATS])


@query(f"""
, t AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, (l_orderkey * 104729 + 42) % 5 AS fold FROM lineitem),
prior AS (SELECT sum(y) / count(*) AS prior FROM t),
f AS (SELECT l_suppkey, fold, sum(y) AS fs, count(*) AS fn FROM t GROUP BY 1, 2),
a AS (SELECT l_suppkey, sum(fs) AS s, sum(fn) AS n FROM f GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey,
{d6('CASE WHEN n - fn > 0 THEN (s - fs + 50 * prior) / (n - fn + 50) ELSE prior END')} AS l_suppkey_te
FROM t JOIN f USING (l_suppkey, fold) JOIN a USING (l_suppkey), prior""")
def supplier_target_encoding(spark, sf):
    """Out-of-fold encoding at the size of the lineitem table; folds by order."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    fold = FOLD(F.col("l_orderkey"))
    enc = target_encoding.fit(lines, ["l_suppkey"], "y", fold)
    out = target_encoding.apply_train(lines, enc, fold, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6("l_suppkey_te").alias("l_suppkey_te"))


H_TEST = ", ".join(f"{d6(f'coalesce(sum(c) FILTER (b = {j}), 0) / min(n)')} AS h{j}" for j in range(128))
R_TEST = ", ".join(f"{d6(f'coalesce(sum(c) FILTER (v = {v}), 0) / min(n)')} AS ratio_id_{v}" for v in range(18))
WIDE = [*[f"ratio_id_{v}" for v in range(18)], *[f"h{j}" for j in range(128)]]


def _duck_enriched(kind: str, rows: str, extra: str) -> str:
    return f"""
, wide AS (SELECT event_id, {R_TEST}, {H_TEST} FROM (SELECT *, {duck_hash('v')} % 128 AS b FROM per_id) GROUP BY event_id)
SELECT i.event_id, i.gender, i.history_a_1, {', '.join(d6(f'coalesce({kind}_{c}.te, (SELECT prior FROM prior))') + f' AS {c}_te' for c in CATS)}, {D_STATS},
{', '.join(f'coalesce({w}, 0) AS {w}' for w in WIDE)} {extra}
{_duck_te_join(CATS, kind, rows)} LEFT JOIN ids ON ids.event_id = i.event_id LEFT JOIN stats ON stats.event_id = i.event_id
LEFT JOIN runs ON runs.event_id = i.event_id LEFT JOIN wide ON wide.event_id = i.event_id"""


def _rounded(df):
    real = {*[f"{c}_te" for c in CATS], *REAL_STATS, *WIDE}
    return df.selectExpr(*[f"round({c}, 6) + 0D AS {c}" if c in real else c for c in df.columns])


@query(D_EXPLODED + _duck_te(CATS) + _duck_enriched("oof", "impressions", ", CAST(i.clicked AS TINYINT) AS clicked"))
def enriched_train_table(spark, sf):
    """Originals, encodings, sequence statistics, vocabulary ratios, hashed bag, target."""
    # Written once: the histories feed the vocabulary and the table.
    df = settle(logs(spark, sf), "histories")
    fold = FOLD(F.col("event_id"))
    enc = target_encoding.fit(df, CATS, "clicked", fold)
    vocab = features.fit_vocab(df)
    wide = features.enriched(df, enc, vocab, ["event_id", "gender", "history_a_1"], fold, narrow=False, spread=["event_id"])
    return _rounded(wide)


@query(D_SPLIT + D_EXPLODED + _duck_te(CATS, "train") + _duck_enriched("full", "test", ""))
def enriched_test_table(spark, sf):
    train, test = train_test(settle(logs(spark, sf), "histories"))
    enc = target_encoding.fit(train, CATS, "clicked", FOLD(F.col("event_id")))
    vocab = features.fit_vocab(train)
    wide = features.enriched(test, enc, vocab, ["event_id", "gender", "history_a_1"], narrow=False, spread=["event_id"])
    return _rounded(wide)


# ---- codes -----------------------------------------------------------------------------------

D_RARE = D_SPLIT + ", n AS (SELECT feat_c_2, count(*) AS n FROM train GROUP BY 1)"


@query(D_RARE + """ SELECT event_id, coalesce(CASE WHEN n < 50 THEN '__RARE__' ELSE CAST(test.feat_c_2 AS VARCHAR) END, '__NA__') AS feat_c_2,
coalesce(gender, '__NA__') AS gender FROM test LEFT JOIN n ON test.feat_c_2 = n.feat_c_2""")
def rare_values_bucketed(spark, sf):
    train, test = train_test(ads(spark, sf))
    cats = ["feat_c_2", "gender"]
    rare = encoding.rare_levels(train, cats)
    return encoding.bucket_rare(test, rare, cats, ["event_id"]).select("event_id", *cats)


D_SPOT = "age_group || '_' || inventory_id || '_' || hour"


@query(D_SPLIT + f""", codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT {D_SPOT} AS v FROM train WHERE age_group IS NOT NULL))
SELECT event_id, coalesce(code, -1) AS spot FROM test LEFT JOIN codes ON {D_SPOT} = v""")
def ordinal_codes(spark, sf):
    """Sorted training values numbered from 0; unseen and missing values are -1."""
    df = ads(spark, sf).withColumn("spot", casts.joined("age_group", "inventory_id", "hour"))
    train, test = train_test(df)
    codes = encoding.fit_codes(train, ["spot"])
    return encoding.apply_codes(test, codes, ["spot"], spread=["event_id"]).select("event_id", "spot")


@query("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY coalesce(age_group, 'nan')) - 1 AS INT) AS age_group,
CAST(dense_rank() OVER (ORDER BY coalesce(hour, 'nan')) - 1 AS INT) AS hour FROM impressions""")
def joint_label_codes(spark, sf):
    df = ads(spark, sf)
    cats = ["age_group", "hour"]
    codes = encoding.joint_codes(*train_test(df), cats)
    return encoding.apply_codes(df.fillna("nan", cats), codes, cats, spread=["event_id"]).select("event_id", *cats)


@query(D_SPLIT + """, codes AS (SELECT feat_c_2 AS v, row_number() OVER (ORDER BY count(*) DESC, CAST(feat_c_2 AS VARCHAR)) AS code FROM train GROUP BY 1)
SELECT event_id, CAST(coalesce(code, 0) AS INT) AS feat_c_2 FROM test LEFT JOIN codes ON feat_c_2 = v""")
def frequency_codes(spark, sf):
    train, test = train_test(ads(spark, sf))
    codes = encoding.categorify(train, ["feat_c_2"])
    return encoding.apply_codes(test, codes, ["feat_c_2"], 0, spread=["event_id"]).select("event_id", "feat_c_2")


@query(D_SPLIT + """ SELECT event_id, CASE WHEN gender = '1.0' THEN 1 ELSE 0 END AS "gender_1.0", CASE WHEN gender = '2.0' THEN 1 ELSE 0 END AS "gender_2.0" FROM test""")
def one_hot_columns(spark, sf):
    train, test = train_test(ads(spark, sf))
    return encoding.one_hot(test.select("event_id", "gender"), encoding.dummy_levels(train, ["gender"]))


@query("""SELECT 'feat_c_2' AS "column", max(feat_c_2) + 1 AS size FROM impressions UNION ALL SELECT 'l_feat_1', max(l_feat_1) + 1 FROM impressions""")
def field_sizes(spark, sf):
    return encoding.field_sizes(ads(spark, sf), ["feat_c_2", "l_feat_1"])


# ---- scaling ---------------------------------------------------------------------------------

@query(D_SPLIT + f""" SELECT event_id, {', '.join(f"{d6(f'({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train)')} AS {c}" for c in ('history_a_1', 'feat_e_3'))},
{d6('l_feat_1 - l_feat_1')} AS constant FROM test""")
def standard_scaling(spark, sf):
    """Fitted on train; a constant column is only centred."""
    train, test = (t.withColumn("constant", F.lit(7.0)) for t in train_test(ads(spark, sf)))
    cols = ["history_a_1", "feat_e_3", "constant"]
    fitted = scaling.fit_standard(train, cols)
    return scaling.apply_standard(test, fitted, cols).select("event_id", *[r6(c).alias(c) for c in cols])


def _duck_poly(coefficients, x: str) -> str:
    text = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def _duck_quantile(column: str, train: str, test: str) -> str:
    """Quantile-to-normal transform of one column in DuckDB."""
    grid = "[" + ", ".join(repr(i / 511) for i in range(512)) + "]"
    mid, near, far = numeric.PPND_MID, numeric.PPND_NEAR, numeric.PPND_FAR
    top = repr(NormalDist().inv_cdf(1 - 1e-7))
    ratio = lambda pair, x: f"{_duck_poly(pair[0], x)} / {_duck_poly(pair[1], x)}"
    return f"""
, g AS (SELECT quantile_cont({column}, CAST({grid} AS DOUBLE[])) AS q FROM {train}),
c AS (SELECT event_id, {column} AS x, q, len(list_filter(q, lambda v: v <= {column})) AS le, len(list_filter(q, lambda v: v < {column})) AS lt FROM {test}, g),
u AS (SELECT event_id, x, CASE WHEN x IS NULL THEN NULL WHEN x + 1e-7 > q[512] THEN 1 WHEN x - 1e-7 < q[1] THEN 0 ELSE
 (le - 1 + CASE WHEN q[le] = x THEN 0 ELSE (x - q[le]) / (q[le + 1] - q[le]) END
  + CASE WHEN q[lt + 1] = x THEN lt ELSE lt - 1 + (x - q[lt]) / (q[lt + 1] - q[lt]) END) / CAST(1022 AS DOUBLE) END AS u FROM c),
b AS (SELECT event_id, x, least(greatest(u, CAST(1e-7 AS DOUBLE)), 1 - CAST(1e-7 AS DOUBLE)) AS p FROM u WHERE x IS NOT NULL),
t AS (SELECT *, p - CAST(0.5 AS DOUBLE) AS d, sqrt(-ln(least(p, 1 - p))) AS s FROM b),
z AS (SELECT event_id, CASE WHEN abs(d) <= CAST(0.425 AS DOUBLE) THEN d * {ratio(mid, "(CAST(0.180625 AS DOUBLE) - d * d)")}
 WHEN s <= 5 THEN sign(d) * {ratio(near, "(s - CAST(1.6 AS DOUBLE))")} ELSE sign(d) * {ratio(far, "(s - 5)")} END AS z FROM t)
SELECT event_id, CASE WHEN z IS NOT NULL THEN round(least(greatest(z, -{top}), {top}), 5) + CAST(0 AS DOUBLE) END AS {column} FROM {test} LEFT JOIN z USING (event_id)"""


@query(D_SPLIT + _duck_quantile("feat_e_3", "train", "test"))
def quantile_to_normal(spark, sf):
    train, test = train_test(ads(spark, sf))
    fitted = scaling.fit_quantiles(train, ["feat_e_3"])
    out = scaling.apply_quantiles(test.select("event_id", "feat_e_3"), fitted, ["feat_e_3"])
    return out.withColumn("feat_e_3", F.round("feat_e_3", 5) + F.lit(0.0))


# ---- recipes ---------------------------------------------------------------------------------

D_INT = ", ".join(f"CAST(CAST({c} AS DOUBLE) AS BIGINT) AS {c}" for c in CATS)
D_USERS = """(SELECT l_feat_1, count(*) AS user_exposure_count,
 count(DISTINCT inventory_id) + max(CASE WHEN inventory_id IS NULL THEN 1 ELSE 0 END) AS user_unique_inventory_count FROM impressions GROUP BY 1)"""
D_SHIFTED = d6("ln(history_a_2 - (SELECT min(history_a_2) FROM impressions) + 1)")


@query(f"""SELECT event_id, user_exposure_count, user_unique_inventory_count FROM impressions LEFT JOIN {D_USERS} USING (l_feat_1)""")
def user_exposure_features(spark, sf):
    df = ads(spark, sf)
    users = features.fit_exposure(df).users
    return joins.lookup_join(df, users, ["l_feat_1"], "user_exposure_count", ["event_id"]).select(
        "event_id", "user_exposure_count", "user_unique_inventory_count"
    )


@query(f"""
, c AS (SELECT * REPLACE (CAST(CAST(gender AS DOUBLE) AS BIGINT) AS gender, CAST(CAST(age_group AS DOUBLE) AS BIGINT) AS age_group,
 CAST(inventory_id AS BIGINT) AS inventory_id, CAST(day_of_week AS BIGINT) AS day_of_week, CAST(hour AS BIGINT) AS hour),
 coalesce(len(string_split(seq, ',')), 0) AS sl, coalesce(len(list_distinct(string_split(seq, ','))), 0) AS su FROM impressions)
SELECT event_id, coalesce(gender, -1) + 1 AS gender, coalesce(age_group, -1) + 1 AS age_group, inventory_id + 1 AS inventory_id,
 day_of_week + 1 AS day_of_week, hour + 1 AS hour, coalesce(feat_e_3, -1) AS feat_e_3, CAST(sl AS INT) AS seq_length, CAST(su AS INT) AS seq_unique_count,
 gender || '_' || age_group AS gender_age_interaction, age_group || '_' || inventory_id AS age_inventory_interaction,
 user_exposure_count, user_unique_inventory_count, {d6('ln(history_a_1 + 1)')} AS log_history_a_1, {d6('ln(sl + 1)')} AS log_seq_length,
 {d6('ln(su + 1)')} AS log_seq_unique_count, {D_SHIFTED} AS log_history_a_2 FROM c LEFT JOIN {D_USERS} USING (l_feat_1)""")
def exposure_recipe(spark, sf):
    df = logs(spark, sf)
    out = features.exposure_features(df, features.fit_exposure(ads(spark, sf)), spread=["event_id"])
    logged = [c for c in out.columns if c.startswith("log_")]
    return out.withColumns({c: r6(c) for c in logged}).select(
        "event_id", *CATS, "feat_e_3", "seq_length", "seq_unique_count", "gender_age_interaction",
        "age_inventory_interaction", "user_exposure_count", "user_unique_inventory_count", *logged,
    )


@query(f"""
, c AS (SELECT *, {D_ITEMS} AS items FROM impressions)
SELECT event_id, CAST(coalesce(CAST(gender AS DOUBLE), -1) AS INT) AS gender, CAST(coalesce(len(items), 0) AS INT) AS seq_length,
 CAST(coalesce(len(list_distinct(items)) + CASE WHEN list_contains(list_transform(items, lambda v: v IS NULL), true) THEN 1 ELSE 0 END, 0) AS INT) AS seq_unique_count,
 coalesce(items[-1], 0) AS last_item_in_seq, coalesce(items[1], 0) AS first_item_in_seq,
 {d6("coalesce(list_aggregate(list_slice(items, greatest(len(items) - 2, 1), len(items)), 'avg'), 0)")} AS last_3_items_mean,
 {d6("coalesce(list_aggregate(list_slice(items, greatest(len(items) - 4, 1), len(items)), 'avg'), 0)")} AS last_5_items_mean,
 user_exposure_count, {d6('ln(user_exposure_count + 1)')} AS log_user_exposure_count, {D_SHIFTED} AS log_history_a_2
FROM c LEFT JOIN {D_USERS} USING (l_feat_1)""")
def sequence_exposure_recipe(spark, sf):
    df = logs(spark, sf)
    out = features.sequence_exposure_features(df, features.fit_exposure(ads(spark, sf)), spread=["event_id"])
    real = ["last_3_items_mean", "last_5_items_mean", "log_user_exposure_count", "log_history_a_2"]
    return out.withColumns({c: r6(c) for c in real}).select(
        "event_id", "gender", "seq_length", "seq_unique_count", "last_item_in_seq", "first_item_in_seq", *real,
        "user_exposure_count",
    )


D_USER_STATS = """(SELECT feat_c_2, count(*) AS user_total_exposure, CAST(sum(clicked) AS BIGINT) AS user_total_clicks,
 count(DISTINCT inventory_id) AS user_unique_inventories, avg(len(string_split(seq, ','))) AS user_mean_session_length,
 CAST(max(len(string_split(seq, ','))) AS INT) AS user_max_session_length, stddev_samp(len(string_split(seq, ','))) AS user_session_length_std,
 sum(clicked) / count(*) AS user_ctr FROM {0} GROUP BY 1)"""
USER_REAL = ["user_mean_session_length", "user_session_length_std", "user_ctr"]
USER_COUNTS = ["user_total_exposure", "user_total_clicks", "user_unique_inventories", "user_max_session_length"]


@query(D_SPLIT + f""" SELECT event_id, {', '.join(USER_COUNTS)}, {', '.join(f'{d6(c)} AS {c}' for c in USER_REAL)}
FROM test LEFT JOIN {D_USER_STATS.format('train')} USING (feat_c_2)""")
def user_session_features(spark, sf):
    """Statistics of the training rows on test rows."""
    train, test = train_test(logs(spark, sf))
    users = features.fit_users(train)
    out = joins.lookup_join(test, users, ["feat_c_2"], "user_total_exposure", ["event_id"])
    return out.select("event_id", *USER_COUNTS, *[r6(c).alias(c) for c in USER_REAL])


@query(D_SPLIT + f""" SELECT event_id, {', '.join(USER_COUNTS)}, {', '.join(f'{d6(c)} AS {c}' for c in USER_REAL)}
FROM test LEFT JOIN {D_USER_STATS.format('train')} USING (feat_c_2)""")
def user_features_from_bucketed_table(spark, sf):
    """The user table stored by user: only the rows move when they are looked up."""
    train, test = train_test(logs(spark, sf))
    users = features.fit_users(train, buckets=8)
    out = joins.lookup_bucketed(test, users, ["feat_c_2"], "user_total_exposure")
    return out.select("event_id", *USER_COUNTS, *[r6(c).alias(c) for c in USER_REAL])


@query("""SELECT event_id, CASE WHEN n <= 50 THEN '0-50' WHEN n <= 200 THEN '51-200' WHEN n <= 500 THEN '201-500' ELSE '500+' END AS length_bin,
CAST(n < 50 AS TINYINT) AS is_very_short FROM (SELECT event_id, len(string_split(seq, ',')) * 20 AS n FROM impressions)""")
def length_bins(spark, sf):
    from clickloom.functions import sequences

    n = F.size(casts.tokens("seq")) * 20
    return logs(spark, sf).select(
        "event_id", sequences.length_bin(n).alias("length_bin"), (n < 50).cast("tinyint").alias("is_very_short")
    )


@query("""SELECT event_id, CAST(day_of_week IN ('6', '7') AS TINYINT) AS weekend_from_one, CAST(day_of_week IN ('5', '6') AS TINYINT) AS weekend_from_zero FROM impressions""")
def weekend_flags(spark, sf):
    """Two numberings of the week."""
    day = F.col("day_of_week")
    return ads(spark, sf).select(
        "event_id", day.isin("6", "7").cast("tinyint").alias("weekend_from_one"),
        day.isin("5", "6").cast("tinyint").alias("weekend_from_zero"),
    )


@query(f"""SELECT event_id, {d6('ln(1 + history_a_1)')} AS history_a_1, CAST(day_of_week IN ('6', '7') AS TINYINT) AS is_weekend,
 {d6('sin(pi() * CAST(hour AS DOUBLE) / 12)')} AS hour_sin, {d6('cos(pi() * CAST(hour AS DOUBLE) / 12)')} AS hour_cos,
 age_group || '_' || gender AS age_x_gender, CAST(len(string_split(seq, ',')) AS INT) AS seq_length,
 {d6("ln(1 + len(string_split(seq, ',')))")} AS log_seq_length, CAST(len(string_split(seq, ',')) < 50 AS TINYINT) AS is_very_short_session,
 CASE WHEN seq IS NULL THEN '500+' ELSE '0-50' END AS seq_length_binned, {', '.join(USER_COUNTS)}, {', '.join(f'{d6(c)} AS {c}' for c in USER_REAL)}
FROM impressions LEFT JOIN {D_USER_STATS.format('impressions')} USING (feat_c_2)""")
def session_recipe(spark, sf):
    df = logs(spark, sf)
    out = features.session_features(df, features.fit_users(df), spread=["event_id"])
    real = ["history_a_1", "hour_sin", "hour_cos", "log_seq_length", *USER_REAL]
    return out.withColumns({c: r6(c) for c in real}).select(
        "event_id", "is_weekend", "age_x_gender", "seq_length", "is_very_short_session", "seq_length_binned",
        *USER_COUNTS, *real,
    )


@query(D_SPLIT + f""" SELECT event_id, {d6('m')} AS feat_a_1_mean, {d6('s')} AS feat_a_1_std, CAST(length(seq) - length(replace(seq, ',', '')) + 1 AS INT) AS seq_length,
CASE WHEN CAST(day_of_week AS INT) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend
FROM test LEFT JOIN (SELECT inventory_id, avg(feat_a_1) AS m, stddev(feat_a_1) AS s FROM train GROUP BY 1) USING (inventory_id)""")
def sql_recipe(spark, sf):
    _, test = train_test(logs(spark, sf))
    train, _ = train_test(ads(spark, sf))
    out = features.sql_features(train, test)
    return out.select(
        "event_id", r6("feat_a_1_mean").alias("feat_a_1_mean"), r6("feat_a_1_std").alias("feat_a_1_std"),
        "seq_length", "is_weekend",
    )


@query(f"""
, c AS (SELECT * REPLACE (replace(seq, 'x', '') AS seq) FROM impressions), d AS (SELECT *, {D_IDS} AS ids FROM c)
SELECT event_id, CAST(len(ids) AS INT) AS seq_length, CAST(len(list_distinct(ids)) AS INT) AS seq_unique_count,
 {d6("coalesce(list_aggregate(ids, 'avg'), 0)")} AS seq_mean, {d6("coalesce(list_aggregate(ids, 'stddev_pop'), 0)")} AS seq_std,
 coalesce(list_aggregate(ids, 'max'), 0) AS seq_max, coalesce(ids[-1], -1) AS seq_last_1, coalesce(ids[-2], -1) AS seq_last_2,
 {d6('sin(2 * pi() * CAST(hour AS DOUBLE) / 24)')} AS hour_sin, {d6('cos(2 * pi() * CAST(hour AS DOUBLE) / 24)')} AS hour_cos,
 {d6('sin(2 * pi() * (CAST(day_of_week AS INT) % 7) / 7)')} AS day_of_week_sin, {d6('cos(2 * pi() * (CAST(day_of_week AS INT) % 7) / 7)')} AS day_of_week_cos,
 CASE WHEN gender = '1.0' THEN 1 ELSE 0 END AS "gender_1.0", CASE WHEN gender = '2.0' THEN 1 ELSE 0 END AS "gender_2.0" FROM d""")
def segment_recipe(spark, sf):
    df = logs(spark, sf).withColumn("seq", F.replace("seq", F.lit("x"), F.lit("")))
    out = features.segment_features(df, encoding.dummy_levels(ads(spark, sf), ["gender"]))
    real = ["seq_mean", "seq_std", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]
    return out.withColumns({c: r6(c) for c in real}).select(
        "event_id", "seq_length", "seq_unique_count", "seq_max", "seq_last_1", "seq_last_2", *real,
        F.col("`gender_1.0`"), F.col("`gender_2.0`"),
    )


READY = ["event_id", "gender", "hour", "history_a_1", "clicked"]


@query(D_SPLIT + """
, lv AS (SELECT hour, CASE WHEN count(*) < 330 THEN '__RARE__' ELSE hour END AS level FROM train GROUP BY hour),
tl AS (SELECT DISTINCT level FROM lv), hc AS (SELECT level, CAST(row_number() OVER (ORDER BY level) - 1 AS INT) AS code FROM tl),
gl AS (SELECT coalesce(gender, '__NA__') AS g, CASE WHEN gender IS NOT NULL AND count(*) < 330 THEN '__RARE__' ELSE coalesce(gender, '__NA__') END AS glevel FROM train GROUP BY gender),
gc AS (SELECT glevel, CAST(row_number() OVER (ORDER BY glevel) - 1 AS INT) AS gcode FROM (SELECT DISTINCT glevel FROM gl)),
base AS (SELECT event_id, gcode AS gender, code AS hour FROM test LEFT JOIN lv USING (hour) LEFT JOIN hc USING (level)
  LEFT JOIN gl ON coalesce(gender, '__NA__') = g LEFT JOIN gc USING (glevel))
, nums AS (SELECT * FROM (""" + "WITH one AS (SELECT 1)" + _duck_quantile("history_a_1", "train", "test") + """))
SELECT event_id, coalesce(gender, -1) AS gender, coalesce(hour, -1) AS hour, history_a_1 FROM base JOIN nums USING (event_id)""")
def model_ready_table(spark, sf):
    """Integer categories and normal scores, all fitted on train; rare limit raised to show it."""
    train, test = (t.select(*READY) for t in train_test(ads(spark, sf)))
    fitted = features.fit_ready(train, "event_id", rare_below=330)
    out = features.model_ready(test, fitted, "event_id", narrow=False)
    return out.select("event_id", "gender", "hour", (F.round("history_a_1", 5) + F.lit(0.0)).alias("history_a_1"))
