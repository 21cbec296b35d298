"""Scalers as parameter tables.

Spark ML's scalers use the sample deviation and map a constant column to the middle of the
range; here the deviation is the population one and a constant column becomes 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS = "feature string, mean double, scale double, min double, max double, kind string, list_hash string"


def feature_hash(features: Sequence[str]) -> str:
    """Identifies the feature list a scaler belongs to."""
    return hashlib.sha256("\x1f".join(features).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Scaler:
    """Fitted column parameters; as small as the feature list."""

    kind: str
    params: dict[str, tuple[float, float, float, float]]

    @property
    def features(self) -> list[str]:
        return list(self.params)

    def scaled(self, name: str) -> Column:
        mean, scale, lo, hi = self.params[name]
        if self.kind == "standard":
            return (F.col(name) - mean) / scale
        return (F.col(name) - lo) / ((hi - lo) or 1.0)

    def unscaled(self, c: Column, name: str) -> Column:
        mean, scale, lo, hi = self.params[name]
        return c * scale + mean if self.kind == "standard" else c * ((hi - lo) or 1.0) + lo

    def table(self, spark: SparkSession) -> DataFrame:
        key = feature_hash(self.features)
        rows = [(f, *p, self.kind, key) for f, p in self.params.items()]
        return spark.createDataFrame(rows, PARAMS)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def scaler_statistics(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean, population deviation (0 -> 1), min, max (F01); one aggregate."""
    stats = train.agg(*[
        F.struct(
            F.avg(c).alias("mean"), F.stddev_pop(c).alias("scale"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c)
        for c in columns
    ])
    one = stats.unpivot([], list(columns), "feature", "s").select("feature", "s.*")
    return one.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard") -> Scaler:
    """Fit on the training rows only."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {kind!r}; choose standard or minmax")
    rows = {r["feature"]: r for r in scaler_statistics(train, columns).collect()}
    return Scaler(kind, {c: (rows[c]["mean"], rows[c]["scale"], rows[c]["min"], rows[c]["max"]) for c in columns})


def load_scaler(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Scaler:
    """Reload a scaler; parameters of another feature list raise."""
    rows = spark.read.parquet(path).collect()
    found = {r["feature"]: (r["mean"], r["scale"], r["min"], r["max"]) for r in rows}
    order = list(features) if features is not None else list(found)
    if rows and feature_hash(order) != rows[0]["list_hash"]:
        raise ValueError("the stored scaler belongs to another feature list")
    return Scaler(rows[0]["kind"], {c: found[c] for c in order})


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Scale the fitted columns in place; values outside the training range are not clipped."""
    return df.withColumns({c: scaler.scaled(c) for c in scaler.features})


def fit_target_scaler(train: DataFrame, target: str = "target") -> Scaler:
    """Min-max scaler of the target."""
    return fit_scaler(train, [target], "minmax")


def scale_target(df: DataFrame, scaler: Scaler, target: str = "target", to: str = "target_scaled") -> DataFrame:
    return df.withColumn(to, scaler.scaled(target))


def inverse_scale(df: DataFrame, scaler: Scaler, column: str, target: str = "target") -> DataFrame:
    """Predictions back to watts."""
    return df.withColumn(column, scaler.unscaled(F.col(column), target))
