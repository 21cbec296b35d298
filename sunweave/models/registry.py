"""One spelling per model."""

from __future__ import annotations

# Labels say what the model is: the sequence models train a linear readout only.
MODELS = {
    "lr": "Linear Regression",
    "rf": "Random Forest",
    "gbt": "Gradient Boosting",
    "seq_flat": "Flat Window Ridge",
    "seq_conv": "Random Convolution Ridge",
    "seq_recurrent": "Reservoir Ridge",
    "seq_conv_recurrent": "Random Convolution Reservoir Ridge",
}
TABULAR = ("lr", "rf", "gbt")
SEQUENCE = ("seq_flat", "seq_conv", "seq_recurrent", "seq_conv_recurrent")


def model_key(name: str) -> str:
    """Trimmed and case-blind lookup; an unknown name raises."""
    key = name.strip().lower()
    if key not in MODELS:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(MODELS)}")
    return key


def model_label(name: str) -> str:
    return MODELS[model_key(name)]
