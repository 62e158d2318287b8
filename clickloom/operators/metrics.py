"""Ranking and probability metrics, temperature calibration, blending."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import clip01, logit
from clickloom.operators.joins import match_join
from clickloom.operators.ranking import running_totals

TEMPERATURES = [0.5 + 0.05 * i for i in range(51)]


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = (), clipped: bool = False) -> DataFrame:
    """Positives and negatives per distinct score; a missing score counts as 0.5.

    ``clipped`` brings scores into (0, 1) first, which makes very small and very large ones equal.
    """
    p = F.col(score).cast("double")
    p = clip01(p, missing=0.5) if clipped else F.coalesce(p, F.lit(0.5))
    return df.groupBy(*by, p.alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) != 1).alias("fp")
    )


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), clipped: bool = False) -> DataFrame:
    """Average precision and ROC AUC per group (``by``: folds or nothing) of probabilities or raw margins.

    Rows with equal scores are one step of the curve. AP is 0 and AUC null with one class only.
    """
    by = list(by)
    cum = running_totals(score_counts(df, label, score, by, clipped), ["p"], ["tp", "fp"], by, descending=True)
    totals = cum.groupBy(*by).agg(F.max("cum_tp").alias("_pos"), F.max("cum_fp").alias("_neg"))
    steps = match_join(cum, totals, by, small=True)
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    above = F.col("cum_tp") - F.col("tp")
    both = (F.max("_pos") > 0) & (F.max("_neg") > 0)
    area = F.sum(F.col("fp") * (above + F.col("tp") / 2.0)) / (F.max("_pos") * F.max("_neg"))
    return steps.groupBy(*by).agg(
        F.when(both, F.sum(F.col("tp") * precision) / F.max("_pos")).otherwise(0.0).alias("ap"),
        F.when(both, area).alias("auc"),
    )


def _loss_sums(p: Column, label: str, eps: float) -> dict[str, Column]:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    is_pos = F.col(label) == 1
    return {
        "_lp": F.sum(F.when(is_pos, -F.ln(q)).otherwise(0.0)),
        "_ln": F.sum(F.when(~is_pos, -F.ln(1 - q)).otherwise(0.0)),
        "_np": F.count_if(is_pos),
        "_nn": F.count_if(~is_pos),
    }


def _balanced() -> Column:
    """Half the mean loss of each class; plain log loss when one class is absent."""
    halves = 0.5 * F.col("_lp") / F.col("_np") + 0.5 * F.col("_ln") / F.col("_nn")
    plain = (F.col("_lp") + F.col("_ln")) / (F.col("_np") + F.col("_nn"))
    return F.when((F.col("_np") > 0) & (F.col("_nn") > 0), halves).otherwise(plain)


def balanced_log_loss(df: DataFrame, label: str, score: str, by: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    """Log loss with both classes weighted one half, per group."""
    p = clip01(F.col(score).cast("double"), missing=0.5)
    sums = df.groupBy(*by).agg(*[a.alias(n) for n, a in _loss_sums(p, label, eps).items()])
    return sums.select(*by, _balanced().alias("wll"))


def evaluate(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AP, AUC, balanced log loss and the combined score, per group."""
    by = list(by)
    both = match_join(
        ranking_metrics(df, label, score, by, clipped=True), balanced_log_loss(df, label, score, by), by, "inner", small=True
    )
    return both.withColumn("score", 0.5 * F.col("ap") + 0.5 / (1 + F.col("wll")))


def temperature_losses(df: DataFrame, label: str, score: str) -> DataFrame:
    """Balanced log loss at each of the 51 temperatures, in one pass.

    Each task folds its rows into 51 running sums; only those are shuffled.
    """
    z = logit(clip01(F.col(score).cast("double"), missing=0.5))
    rows = df.where(F.col(label).isNotNull()).select(z.alias("z"), (F.col(label) == 1).alias("positive"))
    ddl = "step int, t double, _lp double, _ln double, _np bigint, _nn bigint"
    sums = rows.mapInArrow(_loss_sums_of_temperatures, ddl).groupBy("step", "t")
    return sums.agg(*[F.sum(c).alias(c) for c in ("_lp", "_ln", "_np", "_nn")]).select("step", "t", _balanced().alias("wll"))


def _loss_sums_of_temperatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, eps = np.array(TEMPERATURES), 1e-9
    losses, rows = np.zeros((2, len(steps))), np.zeros(2, np.int64)
    for b in batches:
        z, positive = b.column("z").to_numpy(), b.column("positive").to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            q = np.clip(1 / (1 + np.exp(-z[:, None] / steps)), eps, 1 - eps)
        losses[0] -= np.log(q[positive]).sum(0)
        losses[1] -= np.log(1 - q[~positive]).sum(0)
        rows += (positive.sum(), (~positive).sum())
    one = np.ones(len(steps), np.int64)
    columns = [np.arange(len(steps), dtype=np.int32), steps, *losses, rows[0] * one, rows[1] * one]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["step", "t", "_lp", "_ln", "_np", "_nn"])


def fit_temperature(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the temperature with the smallest loss, the lower one on a tie."""
    best = F.min(F.struct("wll", "step", "t")).alias("_b")
    return temperature_losses(df, label, score).agg(best).select(F.col("_b.t").alias("t"), F.col("_b.wll").alias("wll"))


def mean_predictions(parts: Sequence[DataFrame], id_col: str, score: str) -> DataFrame:
    """Mean of several models' predictions per id."""
    together = parts[0].select(id_col, score)
    for p in parts[1:]:
        together = together.unionByName(p.select(id_col, score))
    return together.groupBy(id_col).agg(F.avg(score).alias(score))


def blend(left: DataFrame, right: DataFrame, id_col: str, score: str, weight: float = 0.6) -> DataFrame:
    """``weight`` of the left and the rest of the right predictions."""
    other = right.select(id_col, F.col(score).alias("_other"))
    mixed = weight * F.col(score) + (1 - weight) * F.col("_other")
    return left.join(other, id_col).select(id_col, mixed.alias(score))


def submission(template: DataFrame, predictions: DataFrame, id_col: str = "ID", out: str = "clicked", missing: float = 0.5) -> DataFrame:
    """Every id of the template with its prediction, or ``missing``; ids are unique on both sides."""
    scores = predictions.select(id_col, F.col(predictions.columns[-1]).alias("_p"))
    return template.select(id_col).join(scores, id_col, "left").select(
        id_col, F.coalesce("_p", F.lit(missing)).alias(out)
    )
