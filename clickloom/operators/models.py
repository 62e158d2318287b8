"""Click models with Spark ML: boosted trees, factorisation machines, search, folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.joins import cross_one
from clickloom.operators.metrics import evaluate
from clickloom.operators.profile import class_ratio
from clickloom.operators.sampling import stratified_folds, time_blocks
from clickloom.state import settle

LABEL = "clicked"


def with_weight(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """Positives weigh negatives / positives, negatives 1."""
    ratio = class_ratio(df, label).withColumnRenamed("ratio", "_ratio")
    return cross_one(df, ratio).withColumn(out, F.when(F.col(label) == 1, F.col("_ratio")).otherwise(1.0)).drop("_ratio")


def boosted_trees(rounds: int = 20, depth: int = 4, step: float = 0.1, valid: str | None = None, seed: int = 42) -> GBTClassifier:
    """Boosted trees; with ``valid`` (a boolean column) rounds stop when those rows stop improving."""
    model = GBTClassifier(
        labelCol=LABEL, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth,
        stepSize=step, seed=seed,
    )
    return model.setValidationIndicatorCol(valid) if valid else model


def factor_machine(factors: int = 4, rounds: int = 20, step: float = 0.05, seed: int = 42) -> FMClassifier:
    return FMClassifier(labelCol=LABEL, featuresCol="features", factorSize=factors, maxIter=rounds, stepSize=step, seed=seed)


def linear(rounds: int = 20, reg: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol=LABEL, featuresCol="features", weightCol="weight", maxIter=rounds, regParam=reg)


def fit(df: DataFrame, features: Sequence[str], learner: Estimator) -> PipelineModel:
    """Assemble the features (no nulls left) and train on class-weighted rows."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assemble, learner]).fit(with_weight(df))


def score(df: DataFrame, model: PipelineModel, keep: Sequence[str], out: str = "p") -> DataFrame:
    """Predicted click probability of every row, scored where the rows lie."""
    return model.transform(df).select(*keep, F.element_at(vector_to_array("probability"), 2).alias(out))


class CombinedScore(Evaluator):
    """The combined ranking and loss score as a Spark ML evaluator."""

    def _evaluate(self, dataset: DataFrame) -> float:
        p = F.element_at(vector_to_array("probability"), 2)
        return float(evaluate(dataset.select(LABEL, p.alias("p")), LABEL, "p").first()["score"])

    def isLargerBetter(self) -> bool:
        return True


def search(df: DataFrame, features: Sequence[str], learner: Estimator, grid: list, id_col: str, folds: int = 3) -> tuple[PipelineModel, DataFrame]:
    """Try every parameter map on stratified folds; the best one is refitted on all rows.

    Returns the model and a table of the mean combined score per candidate.
    """
    folded = settle(stratified_folds(with_weight(df), id_col, LABEL, folds), "search_rows")
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    tuned = CrossValidator(
        estimator=Pipeline(stages=[assemble, learner]), estimatorParamMaps=grid,
        evaluator=CombinedScore(), foldCol="fold", numFolds=folds,
    ).fit(folded)
    rows = [
        ("; ".join(f"{p.name}={v}" for p, v in m.items()), float(s))
        for m, s in zip(grid, tuned.avgMetrics)
    ]
    return tuned.bestModel, df.sparkSession.createDataFrame(rows, "candidate string, score double")


def search_over_time(
    df: DataFrame, features: Sequence[str], candidates: Mapping[str, Estimator], time_col: str, id_col: str, splits: int = 3
) -> tuple[PipelineModel, DataFrame]:
    """Try every candidate on expanding time blocks: train on all blocks before a block, judge on that block.

    Rows are written once with their block's number, and every split is a filter on it: no row is copied.
    All candidates of a split score its block side by side in one pass, and one aggregation judges all splits
    and candidates. Returns the candidate with the best mean score, refitted on all rows, and the table
    (split, candidate, train_rows, valid_rows, ap, auc, wll, score, best). A block or a training part
    without both classes is left out of the means; ties go to the first name.
    """
    blocks = settle(time_blocks(df, time_col, splits + 1), "time_blocks")
    sizes = {r["block"]: r for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("clicks")).collect()}
    upto = lambda k, c: sum(sizes[b][c] for b in sizes if b < k)
    names, judged, counts = sorted(candidates), None, []
    for k in range(1, splits + 1):
        if k not in sizes:
            continue
        counts.append((k, upto(k, "n"), sizes[k]["n"]))
        if not (0 < upto(k, "clicks") < upto(k, "n") and 0 < sizes[k]["clicks"] < sizes[k]["n"]):
            continue
        scored = blocks.where(F.col("block") == k).select(id_col, LABEL, *features)
        train = blocks.where(F.col("block") < k)
        for i, name in enumerate(names):
            scored = score(scored, fit(train, features, candidates[name]), scored.columns, f"_p{i}")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"_p{i}").alias("p")) for i, n in enumerate(names)]))
        part = scored.select(LABEL, F.lit(k).alias("split"), each.alias("c")).select("split", "c.candidate", LABEL, "c.p")
        judged = part if judged is None else judged.unionByName(part)
    told = df.sparkSession.createDataFrame([(*c, n) for c in counts for n in names], "split int, train_rows bigint, valid_rows bigint, candidate string")
    if judged is None:
        raise ValueError("no block of time has both classes before it and in it")
    results = settle(evaluate(settle(judged, "time_scores"), LABEL, "p", ["split", "candidate"]), "time_results")
    best = results.groupBy("candidate").agg(F.avg("score").alias("mean")).orderBy(F.desc("mean"), "candidate").first()["candidate"]
    table = told.join(results, ["split", "candidate"], "left").withColumn("best", F.col("candidate") == best)
    return fit(blocks, features, candidates[best]), table


def field_model(df: DataFrame, cats: Sequence[str], numbers: Sequence[str], learner: Estimator) -> PipelineModel:
    """Train on one sparse vector per row: a slot per code of each category field, then the numbers.

    ``cats`` hold codes from ``encoding.apply_codes`` moved up by one, so that 0 is the slot of unknown
    values; codes beyond those of training share one more slot. A field may have millions of codes: a row
    stores one index per field. Numbers must have no nulls.
    """
    slots = [f"{c}_slot" for c in cats]
    fields = OneHotEncoder(inputCols=list(cats), outputCols=slots, dropLast=False, handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*slots, *numbers], outputCol="features")
    return Pipeline(stages=[fields, vector, learner]).fit(with_weight(df))


def field_offsets(model: PipelineModel) -> list[int]:
    """First slot of each category field in the vectors of a ``field_model``."""
    sizes = [n + 1 for n in model.stages[0].categorySizes]
    return [sum(sizes[:i]) for i in range(len(sizes))]


def fold_models(
    train: DataFrame, test: DataFrame, features: Sequence[str], learner: Estimator, id_col: str, folds: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Train once per fold. Returns out-of-fold predictions of train and mean predictions of test.

    Test rows pass through all models side by side, so the mean needs no shuffle.
    """
    rows = settle(stratified_folds(train, id_col, LABEL, folds), "fold_rows")
    held, scored, names = [], test, []
    for k in range(folds):
        model = fit(rows.where(F.col("fold") != k), features, learner)
        held.append(score(rows.where(F.col("fold") == k), model, [id_col, LABEL, "fold"]))
        scored = score(scored, model, [*test.columns, *names], f"p_{k}")
        names.append(f"p_{k}")
    out_of_fold = held[0]
    for h in held[1:]:
        out_of_fold = out_of_fold.unionByName(h)
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / folds
    return settle(out_of_fold, "out_of_fold"), scored.select(id_col, mean.alias("p"))
