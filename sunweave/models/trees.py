"""Random forest and gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunweave.models.base import Forecaster, fit_pipeline
from sunweave.schema import SEED


def fit_forest(
    train: DataFrame,
    features: list[str],
    label: str = "target",
    trees: int = 200,
    depth: int = 30,
    seed: int = SEED,
    bins: int = 64,
) -> Forecaster:
    """Forest over all features per split, two rows per leaf at least.

    30 is Spark's depth limit and stands in for unlimited depth. Splits are found on ``bins``
    quantile bins, so trees differ from those of an exact splitter.
    """
    learner = RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=2,
        featureSubsetStrategy="all", seed=seed, maxBins=bins,
    )
    return fit_pipeline("rf", train, features, learner)


def patient_best(losses: Sequence[float], patience: int) -> int:
    """Rounds to keep: the best one seen before ``patience`` rounds pass without improvement."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_boosted(
    train: DataFrame,
    features: list[str],
    label: str = "target",
    validation: DataFrame | None = None,
    rounds: int = 300,
    depth: int = 6,
    step: float = 0.05,
    rows: float = 0.8,
    columns: float = 0.8,
    patience: int = 20,
    seed: int = SEED,
    bins: int = 64,
) -> Forecaster:
    """Boosting with the round chosen by patience on the validation rows.

    Spark stops early by tolerance only, so the rounds are fitted in growing steps until patience runs
    out on the validation losses; the model is the first trees of the last fit, up to the chosen round. Columns
    are drawn per node, not per tree.
    """
    learner = GBTRegressor(
        labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), seed=seed, maxBins=bins,
    )
    if validation is None:
        model = fit_pipeline("gbt", train, features, learner)
        model.notes["rounds"] = rounds
        return model
    spent, size = 0.0, min(rounds, max(2 * patience, 1))
    while True:
        model = fit_pipeline("gbt", train, features, learner.setMaxIter(size))
        spent += model.fit_seconds
        losses = round_losses(model, validation)
        keep = patient_best(losses, patience)
        if size == rounds or keep + patience <= size:
            break
        size = min(2 * size, rounds)
    if keep < size:
        model = first_trees(model, keep)
    model.fit_seconds = spent
    model.notes.update(rounds=keep, validation_losses=losses)
    return model


def first_trees(model: Forecaster, n: int) -> Forecaster:
    """The model after its first ``n`` rounds: their weighted sum, what a fit of ``n`` rounds with the same seed gives."""
    fitted = model.learner._java_obj
    sc = SparkSession.active().sparkContext
    trees, weights = list(fitted.trees())[:n], list(fitted.treeWeights())[:n]
    tree_array = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weight_array = sc._gateway.new_array(sc._jvm.double, len(weights))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        tree_array[i], weight_array[i] = tree, weight
    short = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(fitted.uid(), tree_array, weight_array, fitted.numFeatures())
    learner = GBTRegressionModel(fitted.copyValues(short, fitted.extractParamMap()))
    learner._transfer_params_from_java()
    learner.set(learner.maxIter, n)
    learner._java_obj.set("maxIter", n)
    return Forecaster(model.key, PipelineModel([*model.pipeline.stages[:-1], learner]), model.fit_seconds, dict(model.notes))


def round_losses(model: Forecaster, df: DataFrame) -> list[float]:
    """Mean squared error after each boosting round."""
    assembled = model.pipeline.stages[0].transform(df)
    return list(model.learner.evaluateEachIteration(assembled, "squared"))


def loss_history(model: Forecaster, train: DataFrame, validation: DataFrame) -> DataFrame:
    """Rows (model, round, train_loss, val_loss)."""
    pairs = zip(round_losses(model, train), round_losses(model, validation))
    rows = [(model.label, i, float(a), float(b)) for i, (a, b) in enumerate(pairs, 1)]
    return SparkSession.active().createDataFrame(
        rows, "model string, round int, train_loss double, val_loss double"
    )


def feature_importance(model: Forecaster, top: int | None = None) -> DataFrame:
    """Importance by feature, ranked from 1 (M05, D12, D13); one row per feature."""
    weights = model.learner.featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(model.features, weights)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    ranked = table.select(place.alias("rank"), "feature", "importance")
    return ranked if top is None else ranked.where(F.col("rank") <= top)
