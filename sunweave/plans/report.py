"""All analysis tables in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunweave.functions import numeric_columns
from sunweave.models import Forecaster, WindowForecaster, feature_importance, loss_history
from sunweave.operators import eda, error_cube, evaluate
from sunweave.plans import studies
from sunweave.plans.prepare import Bundle
from sunweave.schema import DICTIONARY, get_site
from sunweave.session import stage
from sunweave.sources.results import final_report


def dataset_dictionary(spark: SparkSession, site: str) -> DataFrame:
    """Title, raw column, standard name, description and unit of each documented sensor."""
    raw = get_site(site).columns
    rows = [(title, raw[std], std, text, unit) for std, (title, text, unit) in DICTIONARY.items() if std in raw]
    return spark.createDataFrame(
        rows, "feature_name string, raw_column string, standard_name string, description string, unit string"
    )


def statistical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, min, max and median at three decimals."""
    stats = eda.describe(df, columns, probs=(0.5,))
    return stats.select("column", *[
        F.round(F.col(c), 3).alias(n)
        for c, n in (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"), ("p50", "median"))
    ])


def evaluation_tables(predictions: DataFrame) -> dict[str, DataFrame]:
    """Tables over predictions, all from one cube of error cells; only the coverage reads the predictions again."""
    cells = stage(error_cube.error_cells(predictions), "error-cells")
    scores = stage(error_cube.scores(cells), "scores")
    return {
        "comparison": evaluate.comparison_table(scores),
        "ranking": evaluate.metric_ranking(scores),
        "report": final_report(scores.withColumnRenamed("model", "label")),
        "seasonal": error_cube.scores(cells, ["model", "season"], ["rmse", "mae", "r2"]),
        "hourly": error_cube.scores(cells, ["model", "hour"], ["mae"]),
        "confusion": error_cube.confusion(cells),
        "accuracy": error_cube.accuracy(cells),
        "classification": error_cube.classification(cells),
        "coverage": error_cube.coverage(predictions, cells),
        "slices": error_cube.slice_scores(cells),
    }


def model_tables(bundle: Bundle, models: dict[str, Forecaster | WindowForecaster]) -> dict[str, DataFrame]:
    """What the models and the prepared rows tell: settings in use, sizes, importances, losses, horizons, training lengths."""
    tables = {
        "hyperparameters": studies.fitted_parameters(models),
        "complexity": studies.complexity_table(models, bundle),
        "horizons": studies.learned_horizons(bundle),
        "training_length": studies.training_length(bundle),
    }
    trees = [m for key, m in models.items() if key in ("rf", "gbt")]
    if trees:
        tables["importance"] = reduce(DataFrame.unionByName, [feature_importance(m).withColumn("model", F.lit(m.label)) for m in trees])
    if "gbt" in models:
        tables["loss_history"] = loss_history(models["gbt"], bundle.train, bundle.val)
    return tables


def analysis_tables(
    std: DataFrame, site: str, predictions: DataFrame, bundle: Bundle | None = None,
    models: dict[str, Forecaster | WindowForecaster] | None = None,
) -> dict[str, DataFrame]:
    """Every table of the analysis; absent inputs raise when a table is written.

    Tables about models need the prepared rows and the fitted models.
    """
    columns = numeric_columns(std)
    return {
        "dictionary": dataset_dictionary(std.sparkSession, site),
        "summary": statistical_summary(std, columns),
        "correlation": eda.correlations_listwise(std, columns),
        "monthly_box": eda.monthly_box(std),
        "best_day": eda.best_day(std),
        "yearly": eda.yearly_total(std),
        **evaluation_tables(predictions),
        **(model_tables(bundle, models) if bundle is not None and models else {}),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet folder per table."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
