"""Forecasters over windows of past rows, fitted and applied without window rows.

The readout is ridge. Flat windows are fitted from lagged cross moments and applied as a sum of lagged scalars;
fixed encoders run on windows that exist only inside a task. Either way a row carries its own features.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunweave.models.registry import SEQUENCE, model_key, model_label
from sunweave.models.sequence import encode
from sunweave.operators.moments import VECTORS, collected, in_blocks, lagged_grams, segments, vectors, window_grams, windows
from sunweave.operators.ordered import look_back
from sunweave.schema import LOOKBACK, SEED

SERIES, IDX = ("site", "split"), "pos"
SHAPE = {"filters": 64, "units": 64, "kernel": 3, "seed": SEED}


def _encoder(kind: str, shape: dict):
    """Windows (n, steps, features) to encoded rows."""
    if kind == "seq_flat":
        return lambda x: x.reshape(len(x), -1)
    return lambda x: encode(kind, np.ascontiguousarray(x), **shape)


@dataclass
class WindowForecaster:
    """A fitted readout: ``predict`` forecasts the row ``horizon`` steps behind each window, on the fitted scale."""

    key: str
    features: list[str]
    lookback: int
    horizon: int
    weights: np.ndarray
    intercept: float
    shape: dict = field(default_factory=dict)
    fit_seconds: float = 0.0
    notes: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return model_label(self.key)

    @property
    def reach(self) -> int:
        return self.lookback + self.horizon - 1

    def predict(self, df: DataFrame, keep: Sequence[str], series: Sequence[str] = SERIES, idx: str = IDX, **layout) -> DataFrame:
        """``series``, ``idx``, ``keep`` and ``predicted`` of the rows that have a whole window before them."""
        if self.key == "seq_flat":
            return predict_flat([self], df, keep, series, idx, **layout).drop("horizon")
        names = list(dict.fromkeys([*series, idx, *keep]))
        width, f = len(self.features) + 1, len(self.features)
        blocks = in_blocks(df, [*self.features, idx], self.reach, series, idx, names)
        schema = blocks.select(*names).schema.add("predicted", "double")
        encoder, weights = _encoder(self.key, self.shape), self.weights
        lookback, horizon, intercept, reach = self.lookback, self.horizon, self.intercept, self.reach

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, before, own, batch in segments(batches, width, reach):
                for x, at in windows(rows, before, own, f, lookback, horizon):
                    part = batch.take(pa.array(at - before))
                    kept = [part.column(2 + width + i) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(encoder(x) @ weights + intercept)], names=[*names, "predicted"])

        return blocks.mapInArrow(run, schema)

    def save(self, path: str) -> None:
        """One line of JSON in a text folder."""
        stored = {
            "key": self.key, "features": self.features, "lookback": self.lookback, "horizon": self.horizon, "shape": self.shape,
            "weights": self.weights.tolist(), "intercept": self.intercept, "fit_seconds": self.fit_seconds,
        }
        rows = SparkSession.active().createDataFrame([(json.dumps(stored),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(path)


def load_window_forecaster(spark: SparkSession, path: str) -> WindowForecaster:
    stored = json.loads(spark.read.text(path).first().value)
    return WindowForecaster(**{**stored, "weights": np.array(stored["weights"])})


def predict_flat(
    models: Sequence[WindowForecaster], df: DataFrame, keep: Sequence[str], series: Sequence[str] = SERIES, idx: str = IDX, **layout
) -> DataFrame:
    """Forecasts of flat-window models of different horizons in one pass: one row per row and ``horizon``.

    Each row is reduced to one number per step and model; a forecast is the sum of the numbers of the rows before it.
    """
    steps = {}
    for k, model in enumerate(models):
        for s, weights in enumerate(model.weights.reshape(model.lookback, -1)):
            steps[f"_z{k}_{s}"] = sum((F.col(c) * float(w) for c, w in zip(model.features, weights)), F.lit(0.0))

    def build(w):
        out = {}
        for k, model in enumerate(models):
            lags = (F.lag(f"_z{k}_{s}", model.reach - s).over(w) for s in range(model.lookback))
            out[f"_p{k}"] = sum(lags, F.lit(model.intercept))
        return out

    names = list(dict.fromkeys([*series, idx, *keep]))
    slim = df.select(*names, *[expr.alias(name) for name, expr in steps.items()])
    ahead = look_back(slim, max(m.reach for m in models), build, series=series, idx=idx, order=(idx,), **layout)
    cells = F.array(*[
        F.struct(F.lit(m.horizon).alias("horizon"), F.lit(m.reach).alias("_reach"), F.col(f"_p{k}").alias("predicted")) for k, m in enumerate(models)
    ])
    return ahead.select(*names, F.inline(cells)).where(F.col(idx) >= F.col("_reach")).select(*names, "horizon", "predicted")


def fit_windows(
    kind: str, df: DataFrame, features: Sequence[str], target: str, lookback: int = LOOKBACK, horizons: Sequence[int] = (1,),
    alpha: float = 0.1, series: Sequence[str] = SERIES, idx: str = IDX, **shape,
) -> dict[int, WindowForecaster]:
    """One readout per horizon. Flat windows read the rows once for all horizons, encoded ones once for each.

    ``idx`` has to be dense within ``series``; windows never cross series.
    """
    key = model_key(kind)
    if key not in SEQUENCE:
        raise ValueError(f"{kind!r} is not a sequence model; choose from {SEQUENCE}")
    unknown = set(shape) - set(SHAPE)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}; choose from {sorted(SHAPE)}")
    features, start = list(features), time.perf_counter()
    shape = {} if key == "seq_flat" else {**SHAPE, **shape}
    if key == "seq_flat":
        found = lagged_grams(df, features, target, lookback, horizons, series, idx)
    else:
        found = {h: window_grams(df, features, target, lookback, h, _encoder(key, shape), series, idx) for h in horizons}
    out = {}
    for h, gram in found.items():
        weights, intercept = gram.ridge(alpha)
        out[h] = WindowForecaster(key, features, lookback, h, weights, intercept, shape, notes={"n": int(gram.n), "alpha": alpha, "means": gram.means})
    for model in out.values():
        model.fit_seconds = (time.perf_counter() - start) / len(out)
    return out


def imbalance(model: WindowForecaster, df: DataFrame, target: str, alpha: float = 0.1, series: Sequence[str] = SERIES, idx: str = IDX) -> np.ndarray:
    """What the normal equations leave of each encoded column, in deviations of the target: zero for a fitted readout.

    Works on the windows themselves, not on the moments that the fit may have used.
    """
    f, weights, intercept = len(model.features), model.weights, model.intercept
    encoder, lookback, horizon, reach = _encoder(model.key, model.shape), model.lookback, model.horizon, model.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 3)
        for rows, before, own, _ in segments(batches, f + 1, reach):
            for x, at in windows(rows, before, own, f, lookback, horizon):
                z, y = encoder(x), rows[at, -1]
                total += np.concatenate([z.T @ (y - z @ weights - intercept), [len(y), y.sum(), (y * y).sum()]])
        yield vectors({0: total})

    total = collected(in_blocks(df, [*model.features, target], reach, series, idx).mapInArrow(run, VECTORS))[0]
    n, y, yy = total[-3:]
    return (total[:-3] - alpha * weights) / (n * np.sqrt(max(yy / n - (y / n) ** 2, 1e-300)))
