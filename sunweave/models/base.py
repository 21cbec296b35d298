"""A fitted pipeline with its label, prediction rule and persistence."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.functions import clamp_non_negative
from sunweave.models.registry import TABULAR, model_key, model_label


@dataclass
class Forecaster:
    key: str
    pipeline: PipelineModel
    fit_seconds: float = 0.0
    notes: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return model_label(self.key)

    @property
    def learner(self):
        return self.pipeline.stages[-1]

    @property
    def features(self) -> list[str]:
        return self.pipeline.stages[0].getInputCols()

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted``; tabular models never predict negative power, sequence models may."""
        scored = self.pipeline.transform(df).drop("features")
        value = F.col("prediction")
        if self.key in TABULAR:
            value = clamp_non_negative(value)
        return scored.withColumn("predicted", value).drop("prediction")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def fit_pipeline(key: str, train: DataFrame, features: list[str], learner) -> Forecaster:
    """Assemble the feature vector and fit, timing the fit."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    start = time.perf_counter()
    model = learner.fit(assembler.transform(train))
    return Forecaster(model_key(key), PipelineModel([assembler, model]), time.perf_counter() - start)


def load_pipeline(key: str, path: str) -> Forecaster:
    return Forecaster(model_key(key), PipelineModel.load(path))
