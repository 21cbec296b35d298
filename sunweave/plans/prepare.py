"""From standardised telemetry to scaled, split feature rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.operators.cleaning import (
    Audit,
    clean_bins,
    drop_bad_target,
    drop_sparse_columns,
    feature_rows,
    fill_gaps,
    filter_daytime,
    keep_numeric,
)
from sunweave.operators.features import engineer_features
from sunweave.operators.ordered import index_rows, reindex_rows, series_lengths
from sunweave.operators.scaling import Scaler, apply_scaler, fit_scaler, fit_target_scaler, scale_target
from sunweave.operators.split import split_chronological
from sunweave.schema import FEATURES_13, FEATURES_18, FEATURES_20, KEY_COLUMNS, TARGET
from sunweave.session import stage

PRESETS = ("documented", "cli13", "notebook")
PRESET_FEATURES = {"documented": FEATURES_20, "cli13": FEATURES_13, "notebook": FEATURES_18}


@dataclass(frozen=True)
class Bundle:
    """Prepared rows with everything a trainer needs.

    ``rows``: keys, ``split``, ``pos`` (dense within series and split), scaled features, the
    target in watts and ``target_scaled``. ``audit`` (preset ``documented``): rows and NULL cells by stage,
    counted while the rows were written.
    """

    rows: DataFrame
    features: list[str]
    scaler: Scaler
    target_scaler: Scaler
    bounded: bool
    target: str = TARGET
    audit: Audit | None = None

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def val(self) -> DataFrame:
        return self.part("val")

    @property
    def test(self) -> DataFrame:
        return self.part("test")


def clean_indexed(df: DataFrame, filter_night: bool = True, max_gap: int = 4) -> tuple[DataFrame, DataFrame]:
    """The cleaning chain without resampling (P06) for a frame with ``idx``, and the series lengths.

    The frame after the target filter is written once: the sparse-column test, the new row
    positions, the lengths and the result all read it. The target is known in every row, so
    filling drops none and the lengths hold for the result.
    """
    out = stage(drop_bad_target(df), "target-ok").transform(drop_sparse_columns)
    if filter_night:
        out = filter_daytime(out)
    return keep_numeric(fill_gaps(reindex_rows(out), max_gap)), series_lengths(out)


@dataclass(frozen=True)
class Frame:
    """Cleaned feature rows with a dense ``idx``; ``bounded`` if they lie on a regular grid."""

    rows: DataFrame
    bounded: bool
    lengths: DataFrame | None = None
    dropped: tuple[str, ...] = ()


def _dropped(before: DataFrame, after: DataFrame) -> tuple[str, ...]:
    """Measurements that cleaning left out, with what the irradiance stands behind."""
    gone = [c for c in before.columns if c not in after.columns and c not in KEY_COLUMNS]
    return (*gone, *(["clearness_index"] if "irr_horiz" in gone else []))


def feature_frame(
    std: DataFrame, preset: str = "documented", latitude=None, filter_night: bool = True, audit: Audit | None = None
) -> Frame:
    """Features and cleaning in the order the preset asks for."""
    if preset == "documented":
        grid, bounded = clean_bins(std, filter_night, audit=audit)
        return Frame(engineer_features(grid, latitude, bounded=bounded), bounded, dropped=_dropped(std, grid))
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; choose from {PRESETS}")
    featured = engineer_features(index_rows(std), latitude)
    if preset == "cli13":
        rows, lengths = clean_indexed(featured, filter_night)
        return Frame(rows, False, lengths, _dropped(featured, rows))
    grid, bounded = clean_bins(featured.drop("idx"), filter_night)
    return Frame(grid, bounded, dropped=_dropped(featured, grid))


def split_features(
    std: DataFrame, features: Sequence[str] | None = None, preset: str = "documented", latitude=None, audit: Audit | None = None
) -> tuple[DataFrame, bool]:
    """Complete feature rows of all three splits with ``pos``, unscaled and written once."""
    frame = feature_frame(std, preset, latitude, audit=audit)
    wanted = list(PRESET_FEATURES[preset] if features is None else features)
    parts = split_chronological(frame.rows, bounded=frame.bounded, lengths=frame.lengths)
    # A sensor dropped as too sparse is the one legitimate reason for a missing feature.
    rows = feature_rows(parts, wanted, allow_missing=frame.dropped if features is None else False)
    if audit:
        audit.dropped = frame.dropped
        rows = audit.watch(rows, "usable") if frame.bounded else rows
    if frame.bounded:
        placed = index_rows(rows, ("site", "split"), bounded=True, name="pos")
    else:
        # Positions need block counts of the finished rows: count the written rows, not the plan.
        placed = reindex_rows(stage(rows.withColumn("pos", F.col("idx")), "usable"), ("site", "split"), "pos")
    return stage(placed, "split"), frame.bounded


def prepare(
    std: DataFrame,
    features: Sequence[str] | None = None,
    preset: str = "documented",
    latitude=None,
    scaler: str = "standard",
) -> Bundle:
    """Clean, split, drop incomplete rows, fit scalers on train only, scale all."""
    audit = Audit() if preset == "documented" else None
    rows, bounded = split_features(std, features, preset, latitude, audit)
    names = [c for c in (PRESET_FEATURES[preset] if features is None else features) if c in rows.columns]
    train = rows.where(F.col("split") == "train")
    x_scaler = fit_scaler(train, names, scaler)
    y_scaler = fit_target_scaler(train)
    scaled = scale_target(apply_scaler(rows, x_scaler), y_scaler)
    return Bundle(scaled, names, x_scaler, y_scaler, bounded, audit=audit)
