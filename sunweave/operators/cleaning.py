"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sunweave.functions import numeric_columns
from sunweave.operators.ordered import MAX_SERIES_ROWS, index_rows, look_back, reindex_rows
from sunweave.operators.resample import complete_grid, grid_rows, resample_counted
from sunweave.schema import IRRADIANCE_FALLBACKS, KEY_COLUMNS, NIGHT_IRRADIANCE, RESAMPLE_RULE, TARGET
from sunweave.session import stage


def drop_bad_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """NULL and negative targets go."""
    return df.where(F.col(target) >= 0)


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column, as rows (column, null_fraction)."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "null_fraction")


def sparse_columns(df: DataFrame, threshold: float = 0.50) -> list[str]:
    """Columns with more than ``threshold`` NULLs, over all series so that the schema is one."""
    columns = [c for c in df.columns if c not in KEY_COLUMNS]
    if not columns:
        return []
    rows = null_fractions(df, columns).where(F.col("null_fraction") > threshold).collect()
    gone = {r["column"] for r in rows}
    return [c for c in columns if c in gone]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Drop columns whose NULL share is strictly above ``threshold`` (P02); one aggregate job."""
    return df.drop(*sparse_columns(df, threshold))


def irradiance_column(df: DataFrame, preferred: str = "irr_horiz") -> str | None:
    return next((c for c in (preferred, *IRRADIANCE_FALLBACKS) if c in df.columns), None)


def filter_daytime(df: DataFrame, irr_col: str = "irr_horiz", threshold: float = NIGHT_IRRADIANCE) -> DataFrame:
    """Keep rows above the night threshold; without an irradiance column keep all."""
    name = irradiance_column(df, irr_col)
    return df if name is None else df.where(F.col(name) > threshold)


def fill_gaps(
    df: DataFrame,
    max_gap: int = 4,
    target: str = TARGET,
    columns: Sequence[str] | None = None,
    **layout,
) -> DataFrame:
    """NULL takes the last value at most ``max_gap`` rows back; then NULL targets go."""
    columns = [c for c in df.columns if c not in KEY_COLUMNS] if columns is None else list(columns)

    def carried(w):
        frame = w.rowsBetween(-max_gap, 0)
        return {c: F.last(c, ignorenulls=True).over(frame) for c in columns}

    return look_back(df, max_gap, carried, **layout).where(F.col(target).isNotNull())


def keep_numeric(df: DataFrame) -> DataFrame:
    """Keys and numeric measurements only."""
    keys = [c for c in KEY_COLUMNS if c in df.columns]
    return df.select(*keys, *numeric_columns(df))


def clean_bins(
    df: DataFrame,
    filter_night: bool = True,
    rule: str = RESAMPLE_RULE,
    max_gap: int = 4,
    threshold: float = 0.50,
    target: str = TARGET,
    max_series: int = MAX_SERIES_ROWS,
    audit: Audit | None = None,
) -> tuple[DataFrame, bool]:
    """The cleaning chain with resampling (P06), and whether every series is short enough for one window.

    An ``audit`` counts rows and NULLs between the steps.

    The raw rows are read once. Bins are written with their reading counts, so the sparse-column
    test adds up a few counts per bin instead of scanning the raw rows a second time. A bin
    without readings has no irradiance and the night filter would drop it at once: with
    ``filter_night`` the empty bins are not generated in the first place. If the longest series
    has more than ``max_series`` rows on its grid, it goes through halo blocks. Either way the rows
    carry a dense ``idx``.
    """
    watch = audit.watch if audit else lambda rows, *_: rows
    good = watch(drop_bad_target(watch(df, "read"), target), "target known")
    columns = numeric_columns(good)
    bins = stage(resample_counted(good, columns, rule), "bins")
    per_site = bins.groupBy("site").agg(
        F.count("*").alias("_bins"), grid_rows(rule).alias("_grid"), F.sum("n_rows").alias("n_rows"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in columns],
    )
    filled, grid, n_rows, *known = per_site.agg(
        F.max("_bins"), F.max("_grid"), F.sum("n_rows"), *[F.sum(f"n_{c}") for c in columns]
    ).first()
    kept = [c for c, n in zip(columns, known) if not n_rows or 1 - n / n_rows <= threshold]
    out = bins.select("site", "ts", *kept)
    by_day = filter_night and irradiance_column(out) is not None
    bounded = ((filled if by_day else grid) or 0) <= max_series
    if by_day:
        out = filter_daytime(out)
    else:
        out = complete_grid(out if bounded else index_rows(out), rule, kept, bounded=bounded)
    if bounded:
        # Halo blocks sample their rows first, which would count them twice: only this layout is watched on.
        filled = watch(fill_gaps(watch(out, "gridded", kept), max_gap, target, bounded=True), "filled", kept)
        return keep_numeric(index_rows(filled, bounded=True)), True
    filled = fill_gaps(index_rows(out), max_gap, target)
    return keep_numeric(reindex_rows(stage(filled, "filled"))), False


def clean_grid(df: DataFrame, filter_night: bool = True, rule: str = RESAMPLE_RULE, **options) -> DataFrame:
    """The rows of :func:`clean_bins`: cleaned, resampled, on a regular grid."""
    return clean_bins(df, filter_night, rule, **options)[0].drop("idx")


def feature_rows(
    df: DataFrame, features: Sequence[str], target: str = TARGET, allow_missing: bool | Sequence[str] = False
) -> DataFrame:
    """Keys, features and target with every NULL row dropped (P07); a missing name raises.

    ``allow_missing`` lists columns that were dropped on purpose: they and what is derived from them
    may be absent. True allows any.
    """
    missing = [c for c in features if c not in df.columns]
    if not isinstance(allow_missing, bool):
        missing = [c for c in missing if not any(c == d or c.startswith(f"{d}_") for d in allow_missing)]
    if missing and allow_missing is not True:
        raise ValueError(f"feature columns not found: {missing}")
    have = [c for c in features if c in df.columns]
    keys = [c for c in KEY_COLUMNS if c in df.columns]
    return df.select(*keys, *have, target).dropna("any", subset=[*have, target])


def candidate_features(df: DataFrame, wanted: Sequence[str], target: str = TARGET) -> list[str]:
    """Wanted names that exist, in order, once each, without the target."""
    return [c for c in dict.fromkeys(wanted) if c in df.columns and c != target]


def date_slice(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Whole days first_day..last_day, both included."""
    start = F.lit(first_day).cast("timestamp_ntz")
    stop = F.lit(last_day).cast("timestamp_ntz") + F.expr("interval 1 day")
    return df.where((F.col("ts") >= start) & (F.col("ts") < stop))


class Audit:
    """Row and NULL counts of the stages of a plan, taken as the rows pass.

    They are there once the plan has run, at no extra job: ``rows`` waits for nothing but stages that ran.
    """

    def __init__(self) -> None:
        self.stages: list[tuple[str, Observation]] = []
        self.dropped: tuple[str, ...] = ()

    def watch(self, df: DataFrame, stage_name: str, columns: Sequence[str] = ()) -> DataFrame:
        out, obs = observed(df, stage_name, columns)
        self.stages.append((stage_name, obs))
        return out

    def rows(self) -> list[tuple[str, int, int]]:
        """(stage, rows, NULL cells of its watched columns), in order."""
        out = []
        for name, obs in self.stages:
            got = obs.get
            out.append((name, got["n_rows"], sum(v for k, v in got.items() if k.startswith("null_"))))
        return out


def observed(df: DataFrame, stage_name: str, columns: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """Count rows and NULLs as they pass, without another job."""
    obs = Observation(stage_name)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows"), *nulls), obs
