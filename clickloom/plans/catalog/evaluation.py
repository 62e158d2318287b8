"""Metrics, calibration, blending and the submission table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import numeric
from clickloom.functions.hashing import affine_fold
from clickloom.operators import metrics
from clickloom.plans.catalog.registry import D_SCORE, ads, d6, pseudo_score, query, r6
from clickloom.sources.impressions import train_test

D_P = f"least(greatest({D_SCORE}, CAST(1e-6 AS DOUBLE)), 1 - CAST(1e-6 AS DOUBLE))"


def _duck_metrics(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""
, rows AS (SELECT CAST((event_id * 104729 + 42) % 5 AS INT) AS fold, clicked AS y, {D_P} AS p FROM impressions),
s AS (SELECT {keys}p, sum(y) AS tp, sum(1 - y) AS fp FROM rows GROUP BY {keys}p),
c AS (SELECT *, sum(tp) OVER ({part}ORDER BY p DESC) AS ctp, sum(fp) OVER ({part}ORDER BY p DESC) AS cfp FROM s),
tot AS (SELECT {keys}sum(tp) AS pos, sum(fp) AS neg FROM s{group}),
m AS (SELECT {keys}sum(tp * (ctp / (ctp + cfp))) / min(pos) AS ap, sum(fp * (ctp - tp + tp / 2)) / (min(pos) * min(neg)) AS auc
 FROM c JOIN tot {using}{group}),
w AS (SELECT {keys}0.5 * avg(CASE WHEN y = 1 THEN -ln(p) END) + 0.5 * avg(CASE WHEN y = 0 THEN -ln(1 - p) END) AS wll FROM rows{group})
SELECT {keys}{d6('ap')} AS ap, {d6('auc')} AS auc, {d6('wll')} AS wll, {d6('0.5 * ap + 0.5 / (1 + wll)')} AS score FROM m JOIN w {using}"""


def _scored(spark, sf):
    return ads(spark, sf).withColumn("p", pseudo_score())


def _rounded(df):
    return df.withColumns({c: r6(c) for c in ("ap", "auc", "wll", "score") if c in df.columns})


@query(_duck_metrics())
def combined_evaluation(spark, sf):
    """Average precision, ROC AUC, balanced log loss and the combined score."""
    return _rounded(metrics.evaluate(_scored(spark, sf), "clicked", "p"))


@query(_duck_metrics("fold"))
def evaluation_per_fold(spark, sf):
    df = _scored(spark, sf).withColumn("fold", affine_fold(F.col("event_id")))
    return _rounded(metrics.evaluate(df, "clicked", "p", ["fold"]))


@query(f"SELECT ap, auc FROM ({'WITH one AS (SELECT 1)' + _duck_metrics()})")
def ranking_metrics(spark, sf):
    return _rounded(metrics.ranking_metrics(_scored(spark, sf), "clicked", "p"))


@query(f"""SELECT {d6(f'0.5 * avg(CASE WHEN clicked = 1 THEN -ln({D_P}) END) + 0.5 * avg(CASE WHEN clicked = 0 THEN -ln(1 - {D_P}) END)')} AS wll FROM impressions""")
def balanced_log_loss(spark, sf):
    return _rounded(metrics.balanced_log_loss(_scored(spark, sf), "clicked", "p"))


D_LOSSES = f"""
, rows AS (SELECT clicked AS y, ln({D_P} / (1 - {D_P})) AS z FROM impressions), g AS (SELECT CAST(i AS INT) AS step, CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * i AS t FROM range(51) AS r(i)),
q AS (SELECT step, t, y, least(greatest(1 / (1 + exp(-z / t)), CAST(1e-9 AS DOUBLE)), 1 - CAST(1e-9 AS DOUBLE)) AS p FROM rows, g),
l AS (SELECT step, t, 0.5 * avg(CASE WHEN y = 1 THEN -ln(p) END) + 0.5 * avg(CASE WHEN y = 0 THEN -ln(1 - p) END) AS wll FROM q GROUP BY 1, 2)"""


@query(D_LOSSES + f" SELECT step, {d6('t')} AS t, {d6('wll')} AS wll FROM l")
def temperature_losses(spark, sf):
    losses = metrics.temperature_losses(_scored(spark, sf), "clicked", "p")
    return losses.select("step", r6("t").alias("t"), r6("wll").alias("wll"))


@query(D_LOSSES + f" SELECT {d6('t')} AS t, {d6('wll')} AS wll FROM l ORDER BY l.wll, l.step LIMIT 1")
def fitted_temperature(spark, sf):
    best = metrics.fit_temperature(_scored(spark, sf), "clicked", "p")
    return best.select(r6("t").alias("t"), r6("wll").alias("wll"))


@query(f'SELECT "ID", {d6(f"1 / (1 + exp(-ln({D_P} / (1 - {D_P})) / 1.7))")} AS p FROM impressions')
def temperature_applied(spark, sf):
    return _scored(spark, sf).select("ID", r6(numeric.temper(F.col("p"), 1.7)).alias("p"))


@query(f'SELECT "ID", {d6(f"({D_SCORE} + {D_SCORE} * {D_SCORE} + sqrt({D_SCORE})) / 3")} AS p FROM impressions')
def mean_of_fold_predictions(spark, sf):
    df = _scored(spark, sf).select("ID", "p")
    parts = [df, df.withColumn("p", F.col("p") * F.col("p")), df.withColumn("p", F.sqrt("p"))]
    return metrics.mean_predictions(parts, "ID", "p").withColumn("p", r6("p"))


@query(f'SELECT "ID", {d6(f"0.6 * {D_SCORE} + 0.4 * {D_SCORE} * {D_SCORE}")} AS p FROM impressions')
def weighted_blend(spark, sf):
    df = _scored(spark, sf).select("ID", "p")
    return metrics.blend(df, df.withColumn("p", F.col("p") * F.col("p")), "ID", "p").withColumn("p", r6("p"))


@query(f"""SELECT "ID", {d6(f'CASE WHEN event_id % 5 = 4 AND event_id % 3 <> 0 THEN {D_SCORE} ELSE 0.05 END')} AS clicked FROM impressions WHERE event_id % 5 = 4""")
def submission_table(spark, sf):
    """Template ids with their predictions; ids without one get the default."""
    _, test = train_test(_scored(spark, sf))
    return metrics.submission(
        test.select("ID"), test.where("event_id % 3 <> 0").select("ID", "p"), missing=0.05
    ).withColumn("clicked", r6("clicked"))
