"""Fixed random encoders for sequence windows; only a linear readout is trained.

The encoders are the published random-kernel and reservoir ideas: their weights come from a seed
and are never fitted. They run as Arrow-batched column functions on the executors; the readout
is the distributed ridge.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.models.base import Forecaster
from sunweave.models.linear import fit_ridge
from sunweave.models.registry import SEQUENCE, model_key
from sunweave.schema import LOOKBACK, SEED


@lru_cache(maxsize=8)
def conv_weights(width: int, filters: int, kernel: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random kernels and biases; a worker draws them once."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1 / np.sqrt(kernel * width), (kernel, width, filters))
    return weights, rng.uniform(-0.5, 0.5, filters)


@lru_cache(maxsize=8)
def reservoir_weights(width: int, units: int, seed: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Random input and inner weights, the latter scaled to a spectral radius; a worker draws them once."""
    rng = np.random.default_rng(seed + 1)
    inward = rng.normal(0, 1 / np.sqrt(width), (width, units))
    inner = rng.normal(0, 1, (units, units))
    return inward, inner * radius / np.abs(np.linalg.eigvals(inner)).max()


def conv_bank(x: np.ndarray, filters: int, kernel: int, seed: int) -> np.ndarray:
    """(n, steps, features) -> (n, steps // 2, filters): same-padded convolution, ReLU, max-pool 2."""
    n, steps, width = x.shape
    weights, bias = conv_weights(width, filters, kernel, seed)
    padded = np.pad(x, ((0, 0), (kernel // 2, kernel // 2), (0, 0)))
    out = bias + sum(padded[:, k:k + steps] @ weights[k] for k in range(kernel))
    out = np.maximum(out, 0)[:, : steps // 2 * 2]
    return out.reshape(n, steps // 2, 2, filters).max(axis=2)


def reservoir(x: np.ndarray, units: int, seed: int, radius: float = 0.9) -> np.ndarray:
    """(n, steps, features) -> (n, units): last state of a fixed random recurrence."""
    inward, inner = reservoir_weights(x.shape[2], units, seed, radius)
    state = np.zeros((len(x), units))
    for step in range(x.shape[1]):
        state = np.tanh(x[:, step] @ inward + state @ inner)
    return state


def encode(kind: str, x: np.ndarray, filters: int, units: int, kernel: int, seed: int) -> np.ndarray:
    if kind == "seq_conv":
        return conv_bank(x, filters, kernel, seed).reshape(len(x), -1)
    if kind == "seq_recurrent":
        return reservoir(x, units, seed)
    return reservoir(conv_bank(x, filters, kernel, seed), units, seed)


def encoder(kind: str, lookback: int, filters: int = 64, units: int = 64, kernel: int = 3, seed: int = SEED):
    """Column function: flattened window -> encoded window."""

    @F.pandas_udf("array<double>")
    def run(flat: pd.Series) -> pd.Series:
        if flat.empty:
            return pd.Series([], dtype=object)
        x = np.stack(flat.to_numpy()).reshape(len(flat), lookback, -1)
        return pd.Series(list(encode(kind, x, filters, units, kernel, seed)))

    return run


def sequence_features(
    sequences: DataFrame, kind: str, lookback: int = LOOKBACK, seq: str = "seq", **shape
) -> DataFrame:
    """Add the ``encoded`` vector of each window."""
    kind = model_key(kind)
    if kind not in SEQUENCE:
        raise ValueError(f"{kind!r} is not a sequence model; choose from {SEQUENCE}")
    flat: Column = F.flatten(F.col(seq))
    values = flat if kind == "seq_flat" else encoder(kind, lookback, **shape)(flat)
    return sequences.withColumn("encoded", array_to_vector(values)).drop(seq)


def fit_readout(encoded: DataFrame, kind: str, label: str = "y", alpha: float = 0.1) -> Forecaster:
    return fit_ridge(encoded, ["encoded"], label, alpha, key=kind)
