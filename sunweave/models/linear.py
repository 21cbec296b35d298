"""Ridge regression."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.models.base import Forecaster, fit_pipeline


def fit_ridge(
    train: DataFrame, features: list[str], label: str = "target", alpha: float = 0.1, key: str = "lr"
) -> Forecaster:
    """Least squares with ``alpha * |w|^2`` added to the summed squared error, free intercept.

    Spark minimises the mean error of the label divided by its deviation, so the same penalty is
    ``alpha / n * stddev_pop(label)``. The normal-equation solver makes one pass over the rows.
    """
    n, spread = train.agg(F.count(label), F.stddev_pop(label)).first()
    if not n:
        raise ValueError("no training rows")
    learner = LinearRegression(
        featuresCol="features", labelCol=label, solver="normal", elasticNetParam=0.0,
        standardization=False, regParam=alpha / n * spread,
    )
    return fit_pipeline(key, train, features, learner)


def coefficients(model: Forecaster) -> DataFrame:
    """Rows (feature, coefficient) and the intercept."""
    from pyspark.sql import SparkSession

    fitted = model.learner
    rows = [(f, float(w)) for f, w in zip(model.features, fitted.coefficients.toArray())]
    rows.append(("(intercept)", float(fitted.intercept)))
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double")
