"""Fill, lags, rolling values and a forecast on a running feed (X01 with P04, D02-D06, M08).

Bins are closed by the watermark in the JVM (``live_bins``); per site, a stateful processor keeps the last
rows a look-back may need: ``max_gap`` readings for fills, ``REACH`` kept rows for lags and rolling
values, and the number of rows so far. A site that stays silent for ``expiry`` is forgotten by a timer, so state is bounded by the
active sites. Whatever can be told from a row alone (calendar, clearness, scaling, the model) stays a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sunweave.functions import numeric_columns
from sunweave.models import Forecaster
from sunweave.operators.cleaning import filter_daytime
from sunweave.operators.features import LAGS, WINDOWS, add_clearness_index, add_time_features
from sunweave.operators.scaling import Scaler, apply_scaler
from sunweave.schema import RESAMPLE_RULE, TARGET
from sunweave.streaming.live import live_bins

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recent(StatefulProcessor):
    """The rows a site's next row looks back on."""

    def __init__(self, columns: Sequence[str], lagged: Sequence[str], rolled: Sequence[str], lags: Sequence[int], windows: Sequence[int], max_gap: int, expiry_ms: int) -> None:
        self.columns, self.lagged, self.rolled = list(columns), list(lagged), list(rolled)
        self.lags, self.windows, self.max_gap, self.expiry_ms = tuple(lags), tuple(windows), max_gap, expiry_ms
        self.reach = max([*self.lags, *(n - 1 for n in self.windows)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values = T.StructType([T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in self.columns]])
        self.read = handle.getListState("read", values)
        self.kept = handle.getListState("kept", values)
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names = ["ts", *self.columns]
        new = pd.concat(list(rows)).sort_values("ts")[names]
        read, kept = (pd.DataFrame([tuple(r) for r in state.get()], columns=names) for state in (self.read, self.kept))
        n = self.seen.get()[0] if self.seen.exists() else 0
        given = _stacked(read, new)
        filled = given.copy()
        filled[self.columns] = given[self.columns].astype(float).ffill(limit=self.max_gap)
        fresh = filled.iloc[len(read) :]
        every = _stacked(kept, fresh)
        out = every.copy()
        for c in self.lagged:
            for lag in self.lags:
                out[f"{c}_lag{lag}"] = every[c].shift(lag)
        for c in self.rolled:
            for size in self.windows:
                frame = every[c].rolling(size, min_periods=1)
                out[f"{c}_roll{size}_mean"] = frame.mean()
                out[f"{c}_roll{size}_std"] = frame.std().fillna(0.0)
        out["idx"] = range(n - len(kept), n + len(fresh))
        self._store(self.read, given.tail(self.max_gap))
        self._store(self.kept, every.tail(self.reach))
        self.seen.update((n + len(fresh),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(new["ts"].iloc[-1].timestamp() * 1000) + self.expiry_ms)
        first = max(self.lags)
        out = out.iloc[len(kept) :]
        out = out[out["idx"] >= first]
        out["idx"] -= first
        out.insert(0, "site", key[0])
        yield out

    @staticmethod
    def _store(state, rows: pd.DataFrame) -> None:
        rows = rows.astype(object).where(rows.notna(), None)
        if len(rows):
            state.put([tuple(r) for r in rows.itertuples(index=False)])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        for state in (self.read, self.kept, self.seen):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _stacked(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    return (pd.concat([old, new]) if len(old) else new).reset_index(drop=True)


def live_features(
    std: DataFrame,
    latitude,
    columns: Sequence[str] | None = None,
    rule: str = RESAMPLE_RULE,
    lateness: str = "30 minutes",
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    max_gap: int = 4,
    irr_col: str = "irr_horiz",
    target: str = TARGET,
    expiry_days: int = 30,
) -> DataFrame:
    """Feature rows of a standardised stream: those that the batch chain makes of the same readings.

    A bin's row comes out once the watermark has passed the bin; readings later than ``lateness`` are
    dropped. The first ``max(lags)`` rows of a site only warm it up. Needs the RocksDB state store (``STORE``).
    """
    columns = numeric_columns(std) if columns is None else list(columns)
    bins = live_bins(std, rule, lateness, columns, zoned=True)
    bins = filter_daytime(bins, irr_col)
    lagged, rolled = [c for c in (irr_col, target) if c in columns], [c for c in (irr_col,) if c in columns]
    made = [*(f"{c}_lag{n}" for c in lagged for n in lags), *(f"{c}_roll{n}_{part}" for c in rolled for n in windows for part in ("mean", "std"))]
    schema = T.StructType([T.StructField("site", T.StringType()), T.StructField("ts", T.TimestampType())])
    for c in [*columns, *made]:
        schema = schema.add(c, T.DoubleType())
    schema = schema.add("idx", T.LongType())
    processor = Recent(columns, lagged, rolled, lags, windows, max_gap, expiry_days * 86_400_000)
    rows = bins.groupBy("site").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return add_clearness_index(add_time_features(rows), latitude, irr_col)


def live_forecasts(features: DataFrame, model: Forecaster, scaler: Scaler, target: str = TARGET) -> DataFrame:
    """Nowcasts of a fitted tabular model on feature rows, scaled as in training; rows with an unknown feature go."""
    rows = features.dropna("any", subset=[*model.features, target])
    scored = model.predict(apply_scaler(rows, scaler))
    return scored.select(F.lit(model.label).alias("model"), "site", "idx", "ts", F.col(target).alias("actual"), "predicted")
