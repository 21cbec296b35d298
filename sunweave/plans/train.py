"""Training and scoring jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.models.base import Forecaster
from sunweave.models.linear import fit_ridge
from sunweave.models.registry import MODELS, SEQUENCE, TABULAR, model_key
from sunweave.models.trees import fit_boosted, fit_forest
from sunweave.models.windows import WindowForecaster, fit_windows, predict_flat
from sunweave.operators.evaluate import comparison_table, metrics
from sunweave.operators.scaling import inverse_scale
from sunweave.operators.sequences import build_sequences
from sunweave.plans.prepare import Bundle
from sunweave.schema import LOOKBACK, SEED

PREDICTIONS = ("model", "site", "idx", "ts", "actual", "predicted")


def fit_tabular(name: str, bundle: Bundle, seed: int = SEED, **params) -> Forecaster:
    """Fit on scaled features and watts; boosting also sees the validation rows."""
    key = model_key(name)
    if key == "lr":
        return fit_ridge(bundle.train, bundle.features, bundle.target, **params)
    if key == "rf":
        return fit_forest(bundle.train, bundle.features, bundle.target, seed=seed, **params)
    if key == "gbt":
        return fit_boosted(bundle.train, bundle.features, bundle.target, bundle.val, seed=seed, **params)
    raise ValueError(f"{name!r} is not a tabular model; choose from {TABULAR}")


def score_tabular(model: Forecaster, rows: DataFrame, target: str = "target") -> DataFrame:
    """Nowcast: same-time inputs. Long predictions at every row."""
    return model.predict(rows).select(
        F.lit(model.label).alias("model"), "site", F.col("pos").alias("idx"), "ts",
        F.col(target).alias("actual"), "predicted",
    )


def train_tabular(name: str, bundle: Bundle, **params) -> tuple[Forecaster, DataFrame]:
    """Fitted model and its predictions on the test rows."""
    model = fit_tabular(name, bundle, **params)
    return model, score_tabular(model, bundle.test, bundle.target)


def sequences_of(bundle: Bundle, part: str, lookback: int = LOOKBACK, horizon: int = 1) -> DataFrame:
    return build_sequences(
        bundle.part(part), bundle.features, "target_scaled", lookback,
        horizon=horizon, bounded=bundle.bounded, keep=("ts", bundle.target),
    )


def _in_watts(bundle: Bundle, scored: DataFrame, *more: str) -> DataFrame:
    rows = inverse_scale(scored, bundle.target_scaler, "predicted", bundle.target)
    return rows.select("model", "site", F.col("pos").alias("idx"), "ts", F.col(bundle.target).alias("actual"), "predicted", *more)


def fit_sequence(
    name: str, bundle: Bundle, lookback: int = LOOKBACK, horizons: Sequence[int] = (1,), alpha: float = 0.1,
    features: Sequence[str] | None = None, **shape,
) -> dict[int, WindowForecaster]:
    """One forecaster per horizon, trained on the scaled target of the training rows."""
    return fit_windows(name, bundle.train, bundle.features if features is None else features, "target_scaled", lookback, horizons, alpha, **shape)


def score_sequence(model: WindowForecaster, rows: DataFrame, bundle: Bundle) -> DataFrame:
    """Forecasts in watts of the rows with a whole window before them, as long predictions."""
    scored = model.predict(rows, ("ts", bundle.target), bounded=bundle.bounded)
    return _in_watts(bundle, scored.withColumn("model", F.lit(model.label)))


def score_horizons(models: dict[int, WindowForecaster], rows: DataFrame, bundle: Bundle) -> DataFrame:
    """Long predictions with ``horizon``; flat-window models of all horizons share one pass."""
    first = next(iter(models.values()))
    keep = ("ts", bundle.target)
    if first.key == "seq_flat":
        scored = predict_flat(list(models.values()), rows, keep, bounded=bundle.bounded)
    else:
        parts = [m.predict(rows, keep, bounded=bundle.bounded).withColumn("horizon", F.lit(h)) for h, m in models.items()]
        scored = reduce(DataFrame.unionByName, parts)
    return _in_watts(bundle, scored.withColumn("model", F.lit(first.label)), "horizon")


def train_sequence(name: str, bundle: Bundle, horizon: int = 1, **params) -> tuple[WindowForecaster, DataFrame]:
    """Forecast from past rows only, trained on the scaled target, reported in watts."""
    model = fit_sequence(name, bundle, horizons=(horizon,), **params)[horizon]
    return model, score_sequence(model, bundle.test, bundle)


def train_all(
    bundle: Bundle, names: Sequence[str] = tuple(MODELS), params: dict[str, dict] | None = None
) -> tuple[dict[str, Forecaster | WindowForecaster], DataFrame]:
    """Train the chosen models (J04): fitted models and their stacked test predictions."""
    params = params or {}
    models, parts = {}, []
    for key in dict.fromkeys(model_key(n) for n in names):
        run = train_sequence if key in SEQUENCE else train_tabular
        models[key], scored = run(key, bundle, **params.get(key, {}))
        parts.append(scored)
    return models, reduce(DataFrame.unionByName, parts)


def compare(predictions: DataFrame) -> DataFrame:
    return comparison_table(metrics(predictions))


def score(model: Forecaster | WindowForecaster, bundle: Bundle) -> DataFrame:
    """Test predictions of a model of either kind."""
    if isinstance(model, WindowForecaster):
        return score_sequence(model, bundle.test, bundle)
    return score_tabular(model, bundle.test, bundle.target)


def reload_and_score(models: dict[str, Forecaster | WindowForecaster], bundle: Bundle) -> DataFrame:
    """Score reloaded models of every kind on the test rows."""
    return reduce(DataFrame.unionByName, [score(m, bundle) for m in models.values()])
