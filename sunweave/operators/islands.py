"""Islands between gaps: lags, rolling values, fills and windows that stop at a break in time (Q6 for D02-D07, P04).

A gap of more than ``max_gap`` between neighbouring rows begins a new island. Once rows carry their island and
their position in it, every ordered operator works on (series, island) as it does on a series: nothing reads
across a break. Islands are numbered by a prefix sum over halo blocks, so a series of any length is no
single task, and neither is an island.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.operators.cleaning import fill_gaps
from sunweave.operators.features import LAGS, WINDOWS, add_clearness_index, add_time_features, lag_columns, rolling_columns
from sunweave.operators.ordered import BLOCK_ROWS, SERIES, look_back
from sunweave.operators.sequences import build_sequences
from sunweave.schema import LOOKBACK, TARGET
from sunweave.session import small_side, stage

ISLAND, SPOT = "island", "spot"


def mark_islands(
    df: DataFrame,
    max_gap: str,
    series: Sequence[str] = SERIES,
    idx: str = "idx",
    ts: str = "ts",
    bounded: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``island`` (breaks before the row, from 0) and ``spot`` (rows since its island began).

    ``max_gap`` is an interval such as "30 minutes"; a step of just that length is no break. ``idx`` has to be
    dense within ``series``. A row without ``ts`` breaks nothing and is measured against by nobody.
    """
    far = F.col(ts) > F.col("_before") + F.expr(f"interval {max_gap}")

    def before(w):
        return {"_before": F.last(ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))}

    if bounded:
        w = Window.partitionBy(*series).orderBy(idx)
        flagged = df.withColumns(before(w)).withColumn("_new", F.coalesce(far, F.lit(False)))
        begin = F.max(F.when(F.col("_new"), F.col(idx))).over(w)
        out = flagged.withColumns({ISLAND: F.sum(F.col("_new").cast("long")).over(w), "_begin": F.coalesce(begin, F.lit(0))})
        return out.withColumn(SPOT, F.col(idx) - F.col("_begin")).select(*df.columns, ISLAND, SPOT)
    # A NULL time is passed over within its block; the block before hands on its last known time.
    block = F.floor(F.col(idx) / block_rows)
    rows = df.withColumn("_block", block)
    ends = rows.groupBy(*series, "_block").agg(F.max_by(ts, F.when(F.col(ts).isNotNull(), F.col(idx))).alias("_end"))
    earlier = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = small_side(ends.select(*series, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_end")))
    w = Window.partitionBy(*series, "_block").orderBy(idx)
    flagged = rows.join(ends, [*series, "_block"]).withColumns(before(w))
    flagged = flagged.withColumn("_before", F.coalesce("_before", "_end")).withColumn("_new", F.coalesce(far, F.lit(False)))
    flagged = stage(flagged.select(*df.columns, "_block", "_new"), "gaps")
    starts = F.when(F.col("_new"), F.col(idx))
    per = flagged.groupBy(*series, "_block").agg(F.count_if("_new").alias("_n"), F.max(starts).alias("_at"))
    carried = small_side(per.select(
        *series, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_islands"), F.coalesce(F.max("_at").over(earlier), F.lit(0)).alias("_from")
    ))
    out = flagged.join(carried, [*series, "_block"]).withColumns({
        ISLAND: F.col("_islands") + F.sum(F.col("_new").cast("long")).over(w),
        SPOT: F.col(idx) - F.coalesce(F.max(starts).over(w), F.col("_from")),
    })
    return out.select(*df.columns, ISLAND, SPOT)


def within(series: Sequence[str] = SERIES, bounded: bool = False) -> dict:
    """Layout arguments that make an ordered operator work island by island."""
    return {"series": (*series, ISLAND), "idx": SPOT, "order": (SPOT,), "bounded": bounded}


def island_features(
    df: DataFrame,
    latitude,
    target: str = TARGET,
    irr_col: str = "irr_horiz",
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    series: Sequence[str] = SERIES,
    bounded: bool = False,
) -> DataFrame:
    """All features of rows with islands; the first ``max(lags)`` rows of every island go."""
    out = add_clearness_index(add_time_features(df), latitude, irr_col)
    lagged = [c for c in (irr_col, target) if c in df.columns]
    rolled = [c for c in (irr_col,) if c in df.columns]

    def build(w):
        return {**lag_columns(lagged, lags)(w), **rolling_columns(rolled, windows)(w)}

    reach = max([*lags, *(n - 1 for n in windows)], default=0)
    return look_back(out, reach, build, **within(series, bounded)).where(F.col(SPOT) >= max(lags, default=0))


def fill_within_islands(df: DataFrame, max_rows: int = 4, target: str = TARGET, columns: Sequence[str] | None = None, bounded: bool = False) -> DataFrame:
    """NULL takes the last value at most ``max_rows`` rows back in its island; then NULL targets go.

    Positions have holes afterwards where rows went.
    """
    return fill_gaps(df, max_rows, target, columns, **within(bounded=bounded))


def island_sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    lookback: int = LOOKBACK,
    series: Sequence[str] = SERIES,
    horizon: int = 1,
    keep: Sequence[str] = ("ts",),
    bounded: bool = False,
) -> DataFrame:
    """Windows that lie in one island with the row they predict."""
    layout = within(series, bounded)
    return build_sequences(df, features, target, lookback, layout.pop("series"), horizon, layout.pop("idx"), keep, **layout)
