"""Feature engineering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.functions import clear_sky_irradiance, clearness_index, cyclic_time
from sunweave.operators.ordered import index_rows, look_back
from sunweave.schema import TARGET, known_latitudes

LAGS = (1, 4, 8)
WINDOWS = (4, 8)


def add_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Cyclic hour and day of year, and the month."""
    return df.withColumns(cyclic_time(F.col(ts)))


def site_latitude(latitude: float | dict[str, float] | Column | None = None) -> Column:
    """Latitude as a column: a number, a column, or a mapping by site; by default that of the registered sites.

    A row whose site is not in the mapping is an error when it is read.
    """
    if isinstance(latitude, Column):
        return latitude
    if latitude is None:
        latitude = known_latitudes()
    if not isinstance(latitude, dict):
        return F.lit(float(latitude))
    if not latitude:
        raise ValueError("the site latitude is required to compute clear-sky irradiance")
    unknown = F.raise_error(F.concat(F.lit("no latitude for site "), F.coalesce(F.col("site"), F.lit("NULL")))).cast("double")
    out = F.when(F.lit(False), F.lit(0.0))
    for site, deg in latitude.items():
        out = out.when(F.col("site") == site, F.lit(float(deg)))
    return out.otherwise(unknown)


def add_clearness_index(
    df: DataFrame,
    latitude: float | dict[str, float] | Column | None = None,
    irr_col: str = "irr_horiz",
    clearsky_col: str | None = None,
) -> DataFrame:
    """Clearness index from a supplied or computed clear-sky column."""
    if irr_col not in df.columns:
        return df
    if clearsky_col and clearsky_col in df.columns:
        sky = F.col(clearsky_col)
    else:
        sky = clear_sky_irradiance(F.col("ts"), site_latitude(latitude))
    return df.withColumn("clearness_index", clearness_index(F.col(irr_col), sky))


def lag_columns(columns: Sequence[str], lags: Sequence[int]):
    def build(w):
        return {f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in lags}
    return build


def rolling_columns(columns: Sequence[str], windows: Sequence[int]):
    def build(w):
        out = {}
        for c in columns:
            for size in windows:
                frame = w.rowsBetween(-(size - 1), 0)
                out[f"{c}_roll{size}_mean"] = F.avg(c).over(frame)
                # A window with one value has no sample deviation and counts as 0.
                out[f"{c}_roll{size}_std"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
        return out
    return build


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def add_lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = LAGS, **layout) -> DataFrame:
    """``{col}_lag{n}``: the value n rows earlier in the series."""
    return look_back(df, max(lags), lag_columns(_present(df, columns), lags), **layout)


def add_rolling_features(
    df: DataFrame, columns: Sequence[str], windows: Sequence[int] = WINDOWS, **layout
) -> DataFrame:
    """Rolling mean and sample deviation over the row and its predecessors."""
    return look_back(df, max(windows) - 1, rolling_columns(_present(df, columns), windows), **layout)


def engineer_features(
    df: DataFrame,
    latitude: float | dict[str, float] | Column | None,
    target: str = TARGET,
    irr_col: str = "irr_horiz",
    lag_cols: Sequence[str] | None = None,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    clearness: bool = True,
    bounded: bool = False,
    **layout,
) -> DataFrame:
    """All features, then the first ``max(lags)`` rows of each series go.

    Lags, rolling statistics and the row position share one window: one shuffle, one sort.
    """
    out = add_time_features(df)
    if clearness and irr_col in df.columns:
        out = add_clearness_index(out, latitude, irr_col)
    lagged = _present(df, [irr_col, target] if lag_cols is None else lag_cols)
    rolled = _present(df, [irr_col])
    if "idx" not in out.columns:
        out = index_rows(out, bounded=bounded)

    def build(w):
        return {**lag_columns(lagged, lags)(w), **rolling_columns(rolled, windows)(w)}

    reach = max([*lags, *(n - 1 for n in windows)], default=0)
    out = look_back(out, reach, build, bounded=bounded, **layout)
    return drop_warm_up(out, max(lags, default=0))


def drop_warm_up(df: DataFrame, rows: int) -> DataFrame:
    """The first rows of each series go and positions start at 0 again."""
    return df.where(F.col("idx") >= rows).withColumn("idx", F.col("idx") - rows)
