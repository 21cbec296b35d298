"""Coarser bins from finer ones: a bin state that merges.

The raw rows are read once into states of the finest rule (count, sum, least, largest, centred squares of each
column); hours, days, months and years are sums of states. Bins of a coarser rule must be made of whole finer ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.functions import numeric_columns
from sunweave.operators.ordered import MAX_SERIES_ROWS, index_rows
from sunweave.operators.resample import bin_start, complete_grid, grid_rows
from sunweave.schema import RESAMPLE_RULE
from sunweave.session import small_side, stage

PARTS = ("n", "sum", "min", "max", "m2")


def bin_states(df: DataFrame, columns: Sequence[str] | None = None, rule: str = RESAMPLE_RULE, series: Sequence[str] = ("site",)) -> DataFrame:
    """``series``, ``ts`` and ``{column}_{part}`` of every bin with rows, written once."""
    columns = numeric_columns(df) if columns is None else list(columns)
    states = []
    for c in columns:
        x = F.col(c).cast("double")
        n = F.count(x)
        states += [n.alias(f"{c}_n"), F.sum(x).alias(f"{c}_sum"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), (F.var_pop(x) * n).alias(f"{c}_m2")]
    return stage(df.groupBy(*series, bin_start(F.col("ts"), rule).alias("ts")).agg(F.count("*").alias("n_rows"), *states), "bin-states")


def columns_of(states: DataFrame) -> list[str]:
    return [c[: -len("_m2")] for c in states.columns if c.endswith("_m2")]


def roll_up(states: DataFrame, rule: str, series: Sequence[str] = ("site",)) -> DataFrame:
    """States of a coarser rule from those of a finer one."""
    columns = columns_of(states)
    rows = states.withColumn("ts", bin_start(F.col("ts"), rule))
    w = Window.partitionBy(*series, "ts")
    rows = rows.select("*", *[(F.sum(f"{c}_sum").over(w) / F.nullif(F.sum(f"{c}_n").over(w), F.lit(0))).alias(f"_{c}") for c in columns])
    out = [F.sum("n_rows").alias("n_rows")]
    for c in columns:
        n = F.col(f"{c}_n")
        off = F.col(f"{c}_sum") / F.nullif(n, F.lit(0)) - F.col(f"_{c}")
        out += [F.sum(n).alias(f"{c}_n"), F.sum(f"{c}_sum").alias(f"{c}_sum"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max")]
        out.append(F.sum(F.col(f"{c}_m2") + n * off * off).alias(f"{c}_m2"))
    return rows.groupBy(*series, "ts").agg(*out)


def statistics(states: DataFrame, series: Sequence[str] = ("site",)) -> DataFrame:
    """Mean, sum, deviation (sample) and range of each bin's columns."""
    out = []
    for c in columns_of(states):
        n = F.col(f"{c}_n")
        out += [
            n.alias(f"{c}_n"), (F.col(f"{c}_sum") / F.nullif(n, F.lit(0))).alias(f"{c}_mean"), F.col(f"{c}_sum"),
            F.sqrt(F.col(f"{c}_m2") / F.nullif(n - 1, F.lit(0))).alias(f"{c}_std"), F.col(f"{c}_min"), F.col(f"{c}_max"),
        ]
    return states.select(*series, "ts", "n_rows", *out)


def resampled(states: DataFrame, rule: str, agg: str = "avg", series: Sequence[str] = ("site",), complete: bool = True, max_series: int = MAX_SERIES_ROWS) -> DataFrame:
    """What ``resample`` gives for ``rule``, from the states of a finer rule: mean or sum on the complete grid."""
    columns = columns_of(states)
    coarse = states.withColumn("ts", bin_start(F.col("ts"), rule)).groupBy(*series, "ts").agg(
        *[F.sum(f"{c}_{part}").alias(f"{c}_{part}") for c in columns for part in ("n", "sum")]
    )
    value = lambda c: F.col(f"{c}_sum") / F.nullif(F.col(f"{c}_n"), F.lit(0)) if agg == "avg" else F.coalesce(F.col(f"{c}_sum"), F.lit(0.0))
    bins = coarse.select(*series, "ts", *[value(c).alias(c) for c in columns])
    if not complete:
        return bins
    bins = stage(bins, "bins")
    longest = bins.groupBy(*series).agg(grid_rows(rule).alias("n")).agg(F.max("n")).first()[0] or 0
    bounded = longest <= max_series
    grid = complete_grid(bins if bounded else index_rows(bins, series), rule, columns, series, bounded)
    return grid.fillna(0.0, subset=columns) if agg == "sum" else grid


def best_day(states: DataFrame, column: str = "irr_horiz", rule: str = RESAMPLE_RULE) -> DataFrame:
    """Grid rows of each site's day with the largest sum of bin means; the earliest wins a tie."""
    known = F.col(f"{column}_sum") / F.nullif(F.col(f"{column}_n"), F.lit(0))
    bins = states.select("site", "ts", F.to_date("ts").alias("day"), known.alias(column))
    daily = bins.groupBy("site", "day").agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))
    best = small_side(daily.groupBy("site").agg(F.max_by("day", F.struct(F.col("total"), -F.unix_date("day"))).alias("day")))
    spans = states.groupBy("site").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    step = F.expr(f"interval {rule}")
    midnight = F.col("day").cast("timestamp_ntz")
    # The grid begins with the site's first bin and ends with its last: the day may be cut short there.
    slots = best.join(small_side(spans), "site").select("site", "day", F.explode(F.sequence(midnight, midnight + F.expr("interval 1 day") - step, step)).alias("ts"), "_first", "_last")
    slots = slots.where("ts between _first and _last").drop("_first", "_last")
    return slots.join(bins.drop("day"), ["site", "ts"], "left").select("site", "ts", "day", column)


def yearly_total(states: DataFrame, column: str = "irr_horiz", series: Sequence[str] = ("site",)) -> DataFrame:
    """Sum per calendar year, years without data count 0 (C14)."""
    years = resampled(states, "year", "sum", series)
    return years.select(*series, F.year("ts").alias("year"), F.col(column).alias("total"))
