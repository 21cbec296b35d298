"""Row positions and bounded look-backs over very long series.

Two layouts share every ordered operator:

* ``bounded=True`` - the frame lies on a regular time grid, so a series has at most
  (time span / step) rows whatever the raw volume (20 years at 15 minutes: 700,000). One window
  per series is then safe, and consecutive operators share a single shuffle and sort.
* ``bounded=False`` - a series may hold any share of the data. Rows carry a dense position
  ``idx``; a window runs over blocks of ``block_rows`` consecutive positions, and the last
  ``reach`` rows of a block are copied into the next one so that look-backs see across the edge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sunweave.session import small_side, stage

BLOCK_ROWS = 50_000
# Longest series handled by one window: 57 years at 15 minutes.
MAX_SERIES_ROWS = 2_000_000
SERIES = ("site",)
ORDER = ("ts", "row_id")

Build = Callable[[WindowSpec], dict[str, Column]]


def order_columns(df: DataFrame, order: Sequence[str] = ORDER) -> list[str]:
    """The sort keys the frame has; resampled frames have no ``row_id``."""
    return [c for c in order if c in df.columns]


def index_rows(
    df: DataFrame,
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    bounded: bool = False,
    name: str = "idx",
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series.

    Unbounded series are range-partitioned on (series, order), so one hot series or one hot day
    spreads over as many tasks as its size asks for. The sorted rows are written once; the
    positions follow from the row counts of the written partitions, a table with at most
    (partitions + series) rows. ``partitions`` defaults to ``spark.sql.shuffle.partitions``, which
    should put some 100 MB in each.
    """
    order = order_columns(df, order)
    if bounded:
        w = Window.partitionBy(*series).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    keys = [*series, *order]
    ranged = df.repartitionByRange(*keys) if partitions is None else df.repartitionByRange(partitions, *keys)
    rows = stage(
        ranged
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        "ordered",
    )
    parts = rows.groupBy(*series, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    shifts = small_side(parts.select(*series, "_part", shift.alias("_shift")))
    return (
        rows.join(shifts, [*series, "_part"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .select(*df.columns, name)
    )


def laid_out(
    df: DataFrame, series: Sequence[str] = SERIES, order: Sequence[str] = ORDER, name: str = "idx", limit: int = MAX_SERIES_ROWS
) -> tuple[DataFrame, bool]:
    """Rows with a dense position, and whether the longest counted series is short enough for one window."""
    rows = stage(df, "rows")
    longest = series_lengths(rows, series).agg(F.max("n_rows")).first()[0] or 0
    bounded = longest <= limit
    return index_rows(rows, series, order, bounded, name), bounded


def reindex_rows(
    df: DataFrame,
    series: Sequence[str] = SERIES,
    idx: str = "idx",
    order: Sequence[str] = ORDER,
    bounded: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Make ``idx`` dense again after rows were dropped.

    The old positions already give ordered blocks of at most ``block_rows`` rows, so ranking
    happens inside blocks and only block counts are summed along the series.
    """
    if bounded:
        return index_rows(df.drop(idx), series, order, True, idx)
    block = F.floor(F.col(idx) / block_rows).alias("_block")
    rows = df.withColumn("_block", block)
    counts = df.groupBy(*series, block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(
        counts.select(*series, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*series, "_block").orderBy(idx)) - 1
    return (
        rows.withColumn("_inside", inside)
        .join(offsets, [*series, "_block"])
        .withColumn(idx, F.col("_offset") + F.col("_inside"))
        .select(*df.columns)
    )


def look_back(
    df: DataFrame,
    reach: int,
    build: Build,
    series: Sequence[str] = SERIES,
    idx: str = "idx",
    order: Sequence[str] = ORDER,
    bounded: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add or replace the columns of ``build(window)``, none reading further back than ``reach``.

    ``build`` gets the ordered window and must use at most ``reach`` preceding rows and no
    following ones. Without ``bounded`` the frame needs a dense ``idx``.
    """
    if bounded:
        w = Window.partitionBy(*series).orderBy(*order_columns(df, order))
        return df.withColumns(build(w))
    if idx not in df.columns:
        raise ValueError(f"unbounded look-back needs {idx!r}: call index_rows first")
    if reach > block_rows:
        raise ValueError(f"reach {reach} exceeds the block of {block_rows} rows")
    home = F.floor(F.col(idx) / block_rows)
    tail = F.col(idx) % block_rows >= block_rows - reach
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    w = Window.partitionBy(*series, "_block").orderBy(idx)
    return (
        df.withColumn("_block", F.explode(copies))
        .withColumns(build(w))
        .where(F.col("_block") == home)
        .drop("_block")
    )


def series_lengths(df: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*series).agg(F.count("*").alias("n_rows"))


def position_slice(df: DataFrame, first: int, last: int, idx: str = "idx") -> DataFrame:
    """Rows at positions first..last-1 of every series (D09): a filter, not a sort and limit."""
    return df.where((F.col(idx) >= first) & (F.col(idx) < last))
