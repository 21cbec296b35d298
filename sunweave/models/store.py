"""Saved models of every kind."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sunweave.models.base import Forecaster, load_pipeline
from sunweave.models.registry import SEQUENCE, model_key
from sunweave.models.windows import WindowForecaster, load_window_forecaster


def load_forecaster(spark: SparkSession, key: str, path: str) -> Forecaster | WindowForecaster:
    """The model that ``save`` wrote: a pipeline, or the readout of a sequence model."""
    return load_window_forecaster(spark, path) if model_key(key) in SEQUENCE else load_pipeline(key, path)
