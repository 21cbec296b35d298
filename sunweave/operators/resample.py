"""Resampling to a regular time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.functions import numeric_columns
from sunweave.operators.ordered import MAX_SERIES_ROWS, index_rows, look_back
from sunweave.schema import RESAMPLE_RULE
from sunweave.session import stage

CALENDAR = ("day", "month", "year")


def bin_start(ts: Column, rule: str) -> Column:
    """Left edge of the bin: a calendar unit or a fixed interval."""
    if rule in CALENDAR:
        day = F.to_date(ts)
        return (day if rule == "day" else F.trunc(day, rule)).cast("timestamp_ntz")
    return F.window(ts, rule)["start"]



def grid_rows(rule: str) -> Column:
    """Aggregate: most rows a series can have on its complete grid, from its first and last ``ts``."""
    # The shortest length of each calendar unit in seconds.
    shortest = {"day": 86_400, "week": 604_800, "month": 28 * 86_400, "quarter": 90 * 86_400, "year": 365 * 86_400}
    seconds = F.lit(shortest[rule]) if rule in shortest else F.unix_seconds(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval {rule}"))
    stamp = lambda c: F.unix_seconds(c.cast("timestamp"))
    return F.floor((stamp(F.max("ts")) - stamp(F.min("ts"))) / seconds) + 1


def complete_grid(
    df: DataFrame,
    rule: str,
    values: Sequence[str],
    series: Sequence[str] = ("site",),
    bounded: bool = True,
    **layout,
) -> DataFrame:
    """Insert the missing bins between the first and last one, with NULL values.

    Each bin emits the bins missing since its predecessor and itself, so the raw rows are not
    read again for the time span and no join is needed. ``bounded`` as in
    :mod:`sunweave.operators.ordered`; otherwise the bins need ``idx``.
    """
    step = F.expr(f"interval 1 {rule}" if rule in CALENDAR else f"interval {rule}")
    linked = look_back(
        df, 1, lambda w: {"_start": F.coalesce(F.lag("ts").over(w) + step, F.col("ts"))},
        series, bounded=bounded, **layout,
    )
    bins = linked.withColumn("_bin", F.explode(F.sequence("_start", "ts", step)))
    own = F.col("_bin") == F.col("ts")
    return bins.select(
        *series,
        F.col("_bin").alias("ts"),
        *[F.when(own, F.col(c)).alias(c) for c in values],
    )


def resample(
    df: DataFrame,
    rule: str = RESAMPLE_RULE,
    agg: str = "avg",
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("site",),
    complete: bool = True,
    max_series: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """One row per series and bin with the mean or sum of each column.

    The complete grid is laid out by one window per series if the longest has at most ``max_series``
    rows on it, else through halo blocks.

    Partial aggregation runs before the shuffle, so a series or bin holding a large share of
    the rows arrives as one row per task. An empty bin has mean NULL but sum 0.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    fn = {"avg": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}[agg]
    bins = df.groupBy(*series, bin_start(F.col("ts"), rule).alias("ts")).agg(
        *[fn(c).alias(c) for c in columns]
    )
    if not complete:
        return bins
    bins = stage(bins, "bins")
    longest = bins.groupBy(*series).agg(grid_rows(rule).alias("n")).agg(F.max("n")).first()[0] or 0
    bounded = longest <= max_series
    grid = complete_grid(bins if bounded else index_rows(bins, series), rule, columns, series, bounded)
    return grid.fillna(0.0, subset=columns) if agg == "sum" else grid


def resample_mean(df: DataFrame, rule: str = RESAMPLE_RULE, complete: bool = True) -> DataFrame:
    return resample(df, rule, "avg", complete=complete)


def resample_counted(
    df: DataFrame, columns: Sequence[str], rule: str = RESAMPLE_RULE, series: Sequence[str] = ("site",)
) -> DataFrame:
    """Bins with each column's mean and, as ``n_{column}``, how many readings it had; ``n_rows`` in all.

    The counts let later steps judge the raw rows (how sparse is a sensor?) from the bins alone.
    """
    return df.groupBy(*series, bin_start(F.col("ts"), rule).alias("ts")).agg(
        F.count("*").alias("n_rows"),
        *[F.avg(c).alias(c) for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    )
