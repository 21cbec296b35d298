"""Forecasters fitted by Spark ML on distributed feature tables."""

from sunweave.models.base import Forecaster  # noqa: F401
from sunweave.models.linear import coefficients, fit_ridge  # noqa: F401
from sunweave.models.registry import MODELS, model_key, model_label  # noqa: F401
from sunweave.models.sequence import sequence_features  # noqa: F401
from sunweave.models.store import load_forecaster  # noqa: F401
from sunweave.models.trees import feature_importance, fit_boosted, fit_forest, loss_history  # noqa: F401
from sunweave.models.windows import WindowForecaster, fit_windows, imbalance, predict_flat  # noqa: F401
