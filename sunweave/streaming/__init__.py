"""The ingest and resample chain on a stream."""

from sunweave.streaming.live import live_bins  # noqa: F401
from sunweave.streaming.features import live_features, live_forecasts  # noqa: F401
