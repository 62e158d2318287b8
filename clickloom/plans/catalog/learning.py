"""Model jobs and the scoring stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from clickloom.functions.hashing import affine_fold
from clickloom import bundle
from clickloom.functions import casts, sequences
from clickloom.operators import encoding, joins, metrics, models, scaling, segments, target_encoding
from clickloom.plans import features
from clickloom.plans.catalog.encoders import D_SPLIT, D_USER_STATS, TE_CATS, _duck_quantile, _duck_te, _duck_te_join
from clickloom.plans.catalog.samples import D_EDGE, D_TIME
from clickloom.plans.catalog.registry import D_IDS, ads, d6, logs, query, r6
from clickloom.sources.impressions import CATS, train_test
from clickloom.state import new_path, settle
from clickloom.streaming.scoring import score_arrivals

NUMBERS = ["history_a_1", "feat_a_1", "feat_e_3", "hour_n", "l_feat_1"]
SEGMENTS = ["age_group", "inventory_id"]


def _model_rows(spark, sf):
    """Numeric features without nulls, written once for the training passes."""
    df = ads(spark, sf).withColumn("hour_n", F.col("hour").cast("double"))
    rows = df.select("event_id", "clicked", *SEGMENTS, *NUMBERS).fillna(0.0, NUMBERS)
    return train_test(settle(rows, "model_rows"))


@query()
def boosted_tree_scores(spark, sf):
    train, test = _model_rows(spark, sf)
    held = train.withColumn("is_valid", F.col("event_id") % 5 == 3)
    model = models.fit(held, NUMBERS, models.boosted_trees(rounds=8, depth=3, valid="is_valid"))
    return models.score(test, model, ["event_id"])


@query()
def factor_machine_scores(spark, sf):
    train, test = _model_rows(spark, sf)
    return models.score(test, models.fit(train, NUMBERS, models.factor_machine(rounds=10)), ["event_id"])


@query()
def parameter_search(spark, sf):
    train, _ = _model_rows(spark, sf)
    learner = models.linear(rounds=5)
    grid = ParamGridBuilder().addGrid(learner.regParam, [0.01, 0.1]).build()
    return models.search(train, NUMBERS, learner, grid, "event_id", folds=2)[1]


def _duck_newton(name: str, keys: list[str], steps: int, ridge: float = 1.0) -> str:
    """Tables ``<name>_0 .. <name>_<steps>`` of weights w0, w1, w2 per key: ridge Newton steps, solved by Cramer's rule."""
    by = ", ".join(keys)
    out = f", {name}_0 AS (SELECT {by}, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2 FROM scaled WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {by} HAVING count(*) >= 10)"
    x = ("1", "x1", "x2")
    h = {(i, j): f"h{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    det = lambda m: " + ".join(
        f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3)
    )
    whole = [[h[i, j] for j in range(3)] for i in range(3)]
    swapped = lambda k: [[f"g{i}" if j == k else h[i, j] for j in range(3)] for i in range(3)]
    for step in range(1, steps + 1):
        grads = ", ".join(f"sum((y - p) * {x[i]}) - {0 if i == 0 else ridge} * w{i} AS g{i}" for i in range(3))
        curves = ", ".join(f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {(1e-9 if i == 0 else ridge) if i == j else 0} AS h{i}{j}" for i in range(3) for j in range(i, 3))
        out += f""",
{name}_s{step} AS (SELECT {by}, w0, w1, w2, {grads}, {curves} FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) AS p FROM scaled JOIN {name}_{step - 1} USING ({by})) GROUP BY {by}, w0, w1, w2),
{name}_{step} AS (SELECT {by}, {", ".join(f"w{k} + ({det(swapped(k))}) / ({det(whole)}) AS w{k}" for k in range(3))} FROM {name}_s{step})"""
    return out


D_SEGMENT_X = ", ".join(
    f"coalesce(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled), 0) AS x{i}" for i, c in ((1, "history_a_1"), (2, "hour_n"))
)


@query(D_SPLIT + f""", every AS (SELECT event_id, clicked AS y, age_group, inventory_id, 1 AS everyone, coalesce(history_a_1, 0) AS history_a_1, coalesce(CAST(hour AS DOUBLE), 0) AS hour_n FROM impressions),
filled AS (SELECT * FROM every WHERE event_id % 5 < 4), scaled AS (SELECT *, {D_SEGMENT_X} FROM filled), tested AS (SELECT *, {D_SEGMENT_X} FROM every WHERE event_id % 5 = 4)
{_duck_newton("own", SEGMENTS, 3)} {_duck_newton("whole", ["everyone"], 3)}
SELECT event_id, {d6("1 / (1 + exp(-(coalesce(o.w0, a.w0) + coalesce(o.w1, a.w1) * x1 + coalesce(o.w2, a.w2) * x2)))")} AS p, o.w0 IS NOT NULL AS own_model
FROM tested t LEFT JOIN own_3 o ON o.age_group = t.age_group AND o.inventory_id = t.inventory_id, whole_3 a""")
def segment_model_scores(spark, sf):
    """A logistic model per (age group, inventory), the model of all rows elsewhere."""
    train, test = _model_rows(spark, sf)
    fitted = segments.fit_segments(train, SEGMENTS, ["history_a_1", "hour_n"], "clicked", steps=3)
    return segments.score_segments(test, fitted, ["event_id"]).withColumn("p", r6("p"))


@query()
def fold_trained_scores(spark, sf):
    """Out-of-fold predictions of train, judged per fold."""
    train, test = _model_rows(spark, sf)
    held, _ = models.fold_models(train, test, NUMBERS, models.linear(rounds=5), "event_id", folds=3)
    return metrics.evaluate(held, "clicked", "p", ["fold"])


@query()
def batch_scoring(spark, sf):
    """One distributed transform in place of a loop over chunks."""
    train, test = _model_rows(spark, sf)
    return models.score(test, models.fit(train, NUMBERS, models.linear()), ["event_id"])


def _is_probability(p="p"):
    return F.coalesce(F.col(p).between(0, 1), F.lit(False))


@query("SELECT event_id, learner, true AS is_probability FROM impressions, (VALUES ('trees'), ('factors')) l(learner) WHERE event_id % 5 = 4")
def every_row_scored_by_each_learner(spark, sf):
    """Boosted trees and factorisation machine: each test row has one probability from each."""
    train, test = _model_rows(spark, sf)
    learners = {"trees": models.boosted_trees(rounds=3, depth=2), "factors": models.factor_machine(rounds=3)}
    scored = [
        models.score(test, models.fit(train, NUMBERS, learner), ["event_id"]).select("event_id", F.lit(name).alias("learner"), _is_probability().alias("is_probability"))
        for name, learner in learners.items()
    ]
    return scored[0].unionByName(scored[1])


@query("""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 'out of fold' ELSE 'mean of folds' END AS kind,
true AS is_probability FROM impressions""")
def fold_predictions_of_all_rows(spark, sf):
    """Train rows scored by the model that did not see them, test rows by the mean of the fold models."""
    train, test = _model_rows(spark, sf)
    held, mean = models.fold_models(train, test, NUMBERS, models.linear(rounds=3), "event_id", folds=3)
    parts = [df.select("event_id", F.lit(kind).alias("kind"), _is_probability().alias("is_probability")) for kind, df in (("out of fold", held), ("mean of folds", mean))]
    return parts[0].unionByName(parts[1])


@query("SELECT event_id, true AS is_probability, true AS same_after_reload FROM impressions WHERE event_id % 5 = 4")
def model_saved_and_reloaded(spark, sf):
    """A fitted pipeline written, read again and applied: scores equal those of the model in memory."""
    train, test = _model_rows(spark, sf)
    model = models.fit(train, NUMBERS, models.linear(rounds=5))
    path = new_path(spark, "click_model")
    model.write().overwrite().save(path)
    both = models.score(models.score(test, model, test.columns, "p"), PipelineModel.load(path), ["event_id", "p"], "q")
    return both.select("event_id", _is_probability().alias("is_probability"), F.col("p").eqNullSafe(F.col("q")).alias("same_after_reload"))


@query(D_SPLIT + _duck_te(CATS, "train") + ' SELECT "ID", ' + ", ".join(
    d6(f"coalesce(full_{c}.te, (SELECT prior FROM prior))") + f" AS {c}_te" for c in CATS
) + " " + _duck_te_join(CATS, "full", "test"))
def stream_scoring(spark, sf):
    """Encodings of arriving files; equal to the batch result."""
    train, test = train_test(ads(spark, sf))
    enc = target_encoding.fit(train, CATS, "clicked", affine_fold(F.col("event_id")))
    source = new_path(spark, "arrivals")
    arriving = settle(test.select("event_id", "ID", *CATS), path=source)

    def scorer(rows):
        out = target_encoding.apply_full(rows, enc, ["event_id"])
        return out.select("ID", *[r6(f"{c}_te").alias(f"{c}_te") for c in CATS])

    return score_arrivals(
        spark, source, arriving.schema, scorer, new_path(spark, "scored"), new_path(spark, "offsets")
    )


D_STREAMED = D_SPLIT + _duck_te(TE_CATS, "train") + ' SELECT "ID", ' + ", ".join(
    d6(f"coalesce(full_{c}.te, (SELECT prior FROM prior))") + f" AS {c}_te" for c in TE_CATS
)


@query(D_STREAMED + " " + _duck_te_join(TE_CATS, "full", "test"))
def stream_scoring_by_shuffle(spark, sf):
    """Encodings of arriving files with tables taken as too large to broadcast, the user id among them."""
    train, test = train_test(ads(spark, sf))
    enc = target_encoding.fit(train, TE_CATS, "clicked", affine_fold(F.col("event_id")))
    source = new_path(spark, "arrivals")
    arriving = settle(test.select("event_id", "ID", *TE_CATS), path=source)

    def scorer(rows):
        out = target_encoding.apply_full(rows, enc, ["event_id"], limit=0)
        return out.select("ID", *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_CATS])

    return score_arrivals(spark, source, arriving.schema, scorer, new_path(spark, "scored"), new_path(spark, "offsets"))


SERVED = [*[f"{c}_te" for c in TE_CATS], "history_a_1", "user_total_exposure", "user_mean_session_length"]


def _with_users(rows, users):
    """User statistics of the training rows; 0 for users never seen."""
    return joins.lookup_bucketed(rows, users, ["feat_c_2"], "user_total_exposure").fillna(0.0)


@query(D_STREAMED + f""", coalesce(u.user_total_exposure, 0) AS user_total_exposure, {d6("coalesce(u.user_mean_session_length, 0)")} AS user_mean_session_length,
true AS same_as_batch {_duck_te_join(TE_CATS, "full", "test")} LEFT JOIN {D_USER_STATS.format("train")} u ON u.feat_c_2 = i.feat_c_2""")
def stream_scoring_with_model(spark, sf):
    """Arriving files joined to encodings and the bucketed user table, then scored by a reloaded model."""
    train, test = train_test(settle(logs(spark, sf), "histories"))
    fold = affine_fold(F.col("event_id"))
    enc = target_encoding.fit(train, TE_CATS, "clicked", fold)
    users = features.fit_users(train, buckets=8)
    fitted = models.fit(_with_users(target_encoding.apply_train(train, enc, fold, ["event_id"]), users), SERVED, models.linear(rounds=5))
    path = new_path(spark, "click_model")
    fitted.write().overwrite().save(path)
    model = PipelineModel.load(path)
    source = new_path(spark, "arrivals")
    arriving = settle(test.select("event_id", "ID", *TE_CATS, "history_a_1"), path=source)

    def scorer(rows):
        made = _with_users(target_encoding.apply_full(rows, enc, ["event_id"], limit=0), users)
        return models.score(made, model, ["event_id", "ID", *SERVED])

    scored = score_arrivals(
        spark, source, arriving.schema, scorer, new_path(spark, "scored"), new_path(spark, "offsets"), files_per_batch=3
    )
    batch = scorer(arriving).select("event_id", F.col("p").alias("_p"))
    return scored.join(batch, "event_id", "left").select(
        "ID", *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_CATS], "user_total_exposure",
        r6("user_mean_session_length").alias("user_mean_session_length"), F.coalesce(F.abs(F.col("p") - F.col("_p")) < 1e-9, F.lit(False)).alias("same_as_batch"),
    )


SCALED = ["history_a_1", "feat_a_1"]


def _apply_bundle(rows, fit: bundle.Bundle):
    """All fitted state of a recipe on new rows: encodings, codes, scales, normal scores, vocabulary, two models."""
    enc = target_encoding.TargetEncoding(["gender"], fit.tables["encoding"])
    out = target_encoding.apply_full(rows, enc, ["event_id"])
    cats = fit.values["categories"]
    out = encoding.apply_codes(encoding.bucket_rare(out, fit.tables["rare"], cats, ["event_id"]), fit.tables["codes"], cats, suffix="_code", spread=["event_id"])
    out = segments.score_segments(out, segments.from_parts(fit.tables, fit.values["segments"]), out.columns, "segment_p").drop("own_model")
    out = models.score(out.fillna(0.0, fit.values["features"]), fit.models["clicks"], out.columns)
    out = scaling.apply_quantiles(scaling.apply_standard(out, fit.tables["scaler"], SCALED), fit.tables["quantiles"], ["history_a_2"])
    counted = sequences.with_counts(out.withColumn("_ids", casts.ids_lenient("seq")))
    return sequences.with_ratios(sequences.with_stats(counted), fit.values["vocabulary"])


@query(D_SPLIT + _duck_te(["gender"], "train") + f"""
, lv AS (SELECT hour, CASE WHEN count(*) < 330 THEN '__RARE__' ELSE hour END AS level FROM train GROUP BY hour),
hc AS (SELECT level, CAST(row_number() OVER (ORDER BY level) - 1 AS INT) AS code FROM (SELECT DISTINCT level FROM lv)),
nums AS (SELECT * FROM (WITH one AS (SELECT 1){_duck_quantile("history_a_2", "train", "test")})),
seqs AS (SELECT event_id, {D_IDS} AS ids FROM impressions),
top AS (SELECT v FROM (SELECT unnest(ids) AS v FROM seqs WHERE event_id % 5 < 4) GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
SELECT i.event_id, {d6("coalesce(full_gender.te, (SELECT prior FROM prior))")} AS gender_te, coalesce(code, -1) AS hour_code, nums.history_a_2,
{", ".join(f"{d6(f'(i.{c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train)')} AS {c}" for c in SCALED)},
{d6("CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda x: x = top.v)) / len(ids) ELSE 0 END")} AS top_ratio, true AS same_scores
{_duck_te_join(["gender"], "full", "test")} LEFT JOIN lv ON lv.hour = i.hour LEFT JOIN hc USING (level) JOIN nums ON nums.event_id = i.event_id JOIN seqs ON seqs.event_id = i.event_id CROSS JOIN top""")
def scored_by_published_bundle(spark, sf):
    """A whole fit published as one bundle, reloaded, and applied to the test rows."""
    train, test = train_test(settle(logs(spark, sf).withColumn("hour_n", F.col("hour").cast("double")), "histories"))
    cats, used = ["hour"], ["history_a_1", "hour_n"]
    rare = encoding.rare_levels(train, cats, 330)
    seg = segments.fit_segments(train, SEGMENTS, used, "clicked", steps=2)
    fitted = bundle.Bundle(
        "in memory",
        {
            "encoding": target_encoding.fit(train, ["gender"], "clicked", affine_fold(F.col("event_id"))).table,
            "rare": rare,
            "codes": encoding.fit_codes(encoding.bucket_rare(train.select("event_id", *cats), rare, cats, ["event_id"]), cats),
            "scaler": settle(scaling.fit_standard(train, SCALED), "scaler"),
            "quantiles": settle(scaling.fit_quantiles(train, ["history_a_2"]), "quantiles"),
            **segments.parts(seg),
        },
        {"clicks": models.fit(train.fillna(0.0, used), used, models.linear(rounds=5))},
        {"vocabulary": features.fit_vocab(train, 10), "categories": cats, "features": used, "segments": {"keys": SEGMENTS, "features": used}},
    )
    root = new_path(spark, "bundles")
    bundle.publish(spark, root, fitted.tables, fitted.models, fitted.values)
    made = _apply_bundle(test, bundle.load(spark, root))
    first = _apply_bundle(test, fitted).select("event_id", F.col("p").alias("_p"), F.col("segment_p").alias("_q"))
    same = (F.abs(F.col("p") - F.col("_p")) < 1e-12) & (F.abs(F.col("segment_p") - F.col("_q")) < 1e-12)
    return made.join(first, "event_id", "left").select(
        "event_id", r6("gender_te").alias("gender_te"), "hour_code", (F.round("history_a_2", 5) + F.lit(0.0)).alias("history_a_2"),
        *[r6(c).alias(c) for c in SCALED], r6(F.get("ratio", F.lit(0))).alias("top_ratio"), F.coalesce(same, F.lit(False)).alias("same_scores"),
    )


@query(D_TIME + f""", b AS (SELECT event_id, {" + ".join(f"CAST((t >= {D_EDGE.format(q=q)}) AS INT)" for q in (0.25, 0.5, 0.75))} AS block FROM t, s),
n AS (SELECT block, count(*) AS n FROM b GROUP BY block)
SELECT CAST(split AS INT) AS split, candidate, CAST((SELECT sum(n) FROM n WHERE block < split) AS BIGINT) AS train_rows, (SELECT n FROM n WHERE block = split) AS valid_rows,
true AS judged FROM range(1, 4) AS r(split), (VALUES ('strong'), ('trees'), ('weak')) AS c(candidate)""")
def search_over_time_blocks(spark, sf):
    """Three candidates on three expanding splits; the best one is refitted on all rows."""
    df = ads(spark, sf).withColumn("hour_n", F.col("hour").cast("double"))
    rows = df.select("event_id", "event_time", "clicked", *NUMBERS).fillna(0.0, NUMBERS)
    candidates = {"weak": models.linear(5, 0.01), "strong": models.linear(5, 1.0), "trees": models.boosted_trees(rounds=3, depth=2)}
    _, results = models.search_over_time(rows, NUMBERS, candidates, "event_time", "event_id", splits=3)
    return results.select("split", "candidate", "train_rows", "valid_rows", F.col("score").between(0, 1).alias("judged"))


FIELDS = ["gender", "age_group", "inventory_id", "hour", "feat_c_2"]


@query(D_SPLIT + "".join(
    f", k_{c} AS (SELECT v, row_number() OVER (ORDER BY v) AS slot, count(*) OVER () + 2 AS size FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM train WHERE {c} IS NOT NULL))" for c in FIELDS
) + " SELECT event_id, array_to_string([" + ", ".join(
    " + ".join([*[f"(SELECT max(size) FROM k_{d})" for d in FIELDS[:i]], f"coalesce(k_{c}.slot, 0)"]) for i, c in enumerate(FIELDS)
) + "], ' ') AS slots, true AS is_probability FROM test " + " ".join(f"LEFT JOIN k_{c} ON k_{c}.v = CAST(test.{c} AS VARCHAR)" for c in FIELDS))
def factor_machine_on_fields(spark, sf):
    """Category fields, the user id among them, as one sparse vector; the slots each row fills."""
    train, test = train_test(settle(ads(spark, sf).select("event_id", "clicked", *FIELDS, "history_a_1"), "field_rows"))
    codes = encoding.fit_codes(train, FIELDS)

    def coded(df):
        out = encoding.apply_codes(df, codes, FIELDS, spread=["event_id"])
        return out.withColumns({c: (F.col(c) + 1).cast("double") for c in FIELDS} | {"x": F.log1p("history_a_1")})

    model = models.field_model(coded(train), FIELDS, ["x"], models.factor_machine(factors=2, rounds=10))
    slots = [F.lit(at) + F.col(c).cast("bigint") for c, at in zip(FIELDS, models.field_offsets(model), strict=True)]
    rows = coded(test).withColumn("slots", F.concat_ws(" ", *slots))
    return models.score(rows, model, ["event_id", "slots"]).select("event_id", "slots", _is_probability().alias("is_probability"))
