"""Chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.operators.ordered import SERIES, series_lengths
from sunweave.schema import TRAIN_FRACTION, VALIDATION_FRACTION
from sunweave.session import small_side


def split_chronological(
    df: DataFrame,
    train: float = TRAIN_FRACTION,
    validation: float = VALIDATION_FRACTION,
    series: Sequence[str] = SERIES,
    bounded: bool = False,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: the first share of each series trains, the next validates, the rest tests.

    Needs a dense ``idx``. Series lengths come from the same window when series are bounded,
    else from a one-row-per-series aggregate; a caller that knows them passes ``lengths``
    (series, n_rows) and spares computing ``df`` for its row counts.
    """
    if bounded:
        sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(*series)))
    else:
        lengths = series_lengths(df, series) if lengths is None else lengths
        sized = df.join(small_side(lengths.withColumnRenamed("n_rows", "_n")), list(series))
    n_train = F.floor(F.col("_n") * F.lit(float(train)))
    n_valid = F.floor(F.col("_n") * F.lit(float(validation)))
    part = (
        F.when(F.col("idx") < n_train, "train")
        .when(F.col("idx") < n_train + n_valid, "val")
        .otherwise("test")
    )
    return sized.withColumn("split", part).drop("_n")


def split_summary(df: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*series, "split").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
