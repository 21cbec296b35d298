"""Scalar expressions for cleaning and binning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunweave.schema import KEY_COLUMNS, SENTINELS


def numeric_columns(df: DataFrame, skip: Iterable[str] = KEY_COLUMNS) -> list[str]:
    """Names of the measurement columns: numeric, keys left out."""
    skip = set(skip)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def null_if_sentinel(name: str, dtype: T.DataType, sentinels=SENTINELS) -> Column:
    """Fill codes and NaN become NULL, so no NaN reaches an aggregate or a comparison."""
    c = F.col(name)
    bad = c.isin(*[F.lit(s) for s in sentinels])
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        bad = bad | F.isnan(c)
    return F.when(~bad, c).alias(name)


def clamp_non_negative(c: Column) -> Column:
    """Power cannot be negative; NULL stays NULL."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def power_level(c: Column, low: float = 3000.0, high: float = 10000.0) -> Column:
    """Low [0, low], Medium (low, high], High (high, inf); negative is NULL."""
    return (
        F.when(c < 0, F.lit(None).cast("string"))
        .when(c <= low, "Low")
        .when(c <= high, "Medium")
        .when(c > high, "High")
    )


def equal_width_bin(c: Column, lo, hi, bins: int) -> Column:
    """1-based equal-width bin over [lo, hi]; the last bin is closed on the right (C11)."""
    lo, hi = F.lit(lo), F.lit(hi)
    return F.when(
        hi > lo, F.least(F.width_bucket(c, lo, hi, F.lit(bins)), F.lit(bins))
    ).when(c.isNotNull(), F.lit(1).cast("bigint"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are known; NULL when either side is constant.

    ``corr`` itself divides by zero on a constant, which is an error under ANSI mode.
    """
    a, b = a.cast("double"), b.cast("double")
    both_a, both_b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(both_a) * F.stddev_pop(both_b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))
