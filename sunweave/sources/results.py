"""Result tables: write, re-read, and the closing report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv_result(df: DataFrame, path: str) -> None:
    """Header CSV for comparison tables, loss histories and predictions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Re-read a result; an absent one is an error, never a stand-in."""
    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(f"no result at {path}") from err
        raise


def final_report(comparison: DataFrame) -> DataFrame:
    """One line per model with its place; place 1 is the winner.

    The window runs over the comparison table: one row per model.
    """
    place = F.row_number().over(Window.orderBy("rmse", "label"))
    return comparison.select(
        place.alias("place"),
        "label",
        (place == 1).alias("winner"),
        F.format_string("%.2f", F.col("rmse").cast("double")).alias("rmse_w"),
        F.format_string("%.4f", F.col("r2").cast("double")).alias("r2_text"),
        F.format_string("%.2f", F.col("mape").cast("double")).alias("mape_pct"),
    )


def report_lines(comparison: DataFrame) -> DataFrame:
    """The closing report as text, best model first; write it with ``.write.text``."""
    line = F.format_string(
        "%d. %s%s: RMSE %s W, R2 %s, MAPE %s %%",
        "place", "label", F.when(F.col("winner"), " (winner)").otherwise(""), "rmse_w", "r2_text", "mape_pct",
    )
    return final_report(comparison).orderBy("place").select(line.alias("value"))
