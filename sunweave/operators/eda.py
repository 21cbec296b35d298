"""Exploratory statistics: the tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.functions import correlation, equal_width_bin
from sunweave.operators.cleaning import null_fractions
from sunweave.operators.ordered import index_rows, look_back
from sunweave.operators.quantiles import SMALL_GROUP, exact_quantiles
from sunweave.operators.resample import resample
from sunweave.schema import RESAMPLE_RULE, SENTINELS, TARGET
from sunweave.session import small_side, stage


def hour_profile(df: DataFrame, column: str, by: Sequence[str] = ("site",)) -> DataFrame:
    """Mean and sample deviation by hour of day with the one-deviation band."""
    stats = df.groupBy(*by, F.hour("ts").alias("hour")).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )
    return stats.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std")})


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent NULL per column, only columns that have any, worst first."""
    pct = null_fractions(df, columns).select("column", (F.col("null_fraction") * 100).alias("null_pct"))
    return pct.where("null_pct > 0").orderBy(F.desc("null_pct"), "column")


def sentinel_counts(df: DataFrame, columns: Sequence[str], sentinels=SENTINELS) -> DataFrame:
    """Occurrences of each fill code over all columns."""
    def hits(s):
        return sum((F.count_if(F.col(c) == s) for c in columns[1:]), F.count_if(F.col(columns[0]) == s))

    wide = df.agg(*[hits(s).alias(str(s)) for s in sentinels])
    long = wide.unpivot([], [F.col(f"`{s}`") for s in sentinels], "sentinel", "n")
    return long.select(F.col("sentinel").cast("double").alias("sentinel"), "n")


def describe(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Count, mean, deviation, min, quartiles, max per column."""
    wide = df.agg(*[
        F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c)
        for c in columns
    ])
    moments = wide.unpivot([], list(columns), "column", "s").select("column", "s.*")
    quantiles = (
        exact_quantiles(df, columns, probs, small_group=small_group)
        .groupBy("column").agg(*[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in probs
        ])
    )
    return moments.join(quantiles, "column", "left")


def target_report(df: DataFrame, target: str = TARGET, by: Sequence[str] = ("site",)) -> DataFrame:
    """Zero, negative and missing targets, mean and max."""
    t = F.col(target)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(t == 0).alias("n_zero"),
        F.count_if(t < 0).alias("n_negative"),
        F.count_if(t.isNull()).alias("n_null"),
        F.avg(t).alias("mean"),
        F.max(t).alias("max"),
        (F.avg(t.isNull().cast("int")) * 100).alias("missing_pct"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle of the pairwise-complete correlation matrix.

    Each row gives one cell per pair, combined before the shuffle to one row per pair and task.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    cells = F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs
    ])
    long = df.select(F.inline(cells))
    return long.groupBy("col_a", "col_b").agg(correlation(F.col("x"), F.col("y")).alias("r"))


def correlations_listwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same over rows complete in all columns."""
    return correlations(df.dropna("any", subset=list(columns)), columns)


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    others = [c for c in columns if c != target]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), correlation(F.col(c), F.col(target)).alias("r")) for c in others])
    return df.agg(cells.alias("_cells")).select(F.inline("_cells")).orderBy(F.desc("r"), "column")


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over [min, max] including empty bins (C11).

    The range comes from one aggregate; groups then carry their range by a checked broadcast.
    """
    by = list(by)
    known = df.where(F.col(column).isNotNull())
    span = known.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    if by:
        span = small_side(span)
        ranged, lo, hi = known.join(span, by), F.col("_lo"), F.col("_hi")
    else:
        edge = span.first()
        ranged, lo, hi = known, F.lit(edge["_lo"]), F.lit(edge["_hi"])
        span = df.sparkSession.createDataFrame([edge], span.schema)
    counted = ranged.groupBy(*by, equal_width_bin(F.col(column), lo, hi, bins).alias("bin")).agg(
        F.count("*").alias("n")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    # Bins of every group: (groups x bins) rows made from the range table.
    edges = span.select(
        *by, "_lo", "_hi", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin")
    ).select(
        *by, "bin",
        (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_from"),
        (F.col("_lo") + width * F.col("bin")).alias("bin_to"),
    )
    return edges.join(counted, [*by, "bin"], "left").fillna(0, subset=["n"])


def monthly_box(df: DataFrame, column: str = "irr_horiz", small_group: int = SMALL_GROUP) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and outlier counts by calendar month."""
    months = df.where(F.col(column).isNotNull()).select(
        F.month("ts").alias("month"), F.col(column).alias("_v")
    )
    q = exact_quantiles(months, ["_v"], [0.25, 0.5, 0.75], ["month"], small_group)
    box = q.groupBy("month").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # Twelve rows at most.
    rows = months.join(F.broadcast(box), "month")
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy("month").agg(
        F.count("*").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def best_day(df: DataFrame, column: str = "irr_horiz", rule: str = RESAMPLE_RULE) -> DataFrame:
    """The grid rows of each site's day with the largest sum; the earliest wins a tie."""
    grid = stage(resample(df, rule, "avg", [column]), "grid")
    day = F.to_date("ts")
    daily = grid.groupBy("site", day.alias("day")).agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))
    best = small_side(
        daily.groupBy("site").agg(
            F.max_by("day", F.struct(F.col("total"), -F.unix_date("day"))).alias("day")
        )
    )
    return grid.withColumn("day", day).join(best, ["site", "day"], "left_semi").select("site", "ts", "day", column)


def yearly_total(df: DataFrame, column: str = "irr_horiz", series: Sequence[str] = ("site",)) -> DataFrame:
    """Sum per calendar year, years without data count 0 (C14)."""
    years = resample(df, "year", "sum", [column], series)
    return years.select(*series, F.year("ts").alias("year"), F.col(column).alias("total"))


def series_check(df: DataFrame, bounded: bool = False) -> DataFrame:
    """Backward steps, largest gap in seconds and range of each series."""
    if not bounded and "idx" not in df.columns:
        df = index_rows(df.select("site", "ts", *[c for c in ("row_id",) if c in df.columns]))
    gaps = look_back(df, 1, lambda w: {"_prev": F.lag("ts").over(w)}, bounded=bounded)
    step = F.expr("cast(cast(ts - _prev as interval second) as decimal(18, 6))").cast("double")
    return gaps.groupBy("site").agg(
        F.count_if(step < 0).alias("n_backward"),
        F.max(step).alias("max_gap_s"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def plot_series(df: DataFrame, columns: Sequence[str], rule: str = "1 hour") -> DataFrame:
    """Down-sampled columns in long form, one panel per column."""
    have = [c for c in columns if c in df.columns]
    return resample(df, rule, "avg", have).unpivot(["site", "ts"], have, "column", "value")


def scatter_pairs(df: DataFrame, x: str, y: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Complete (x, y) pairs, optionally a seeded sample for drawing."""
    pairs = df.select("site", F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    return pairs if fraction >= 1.0 else pairs.sample(fraction, seed)


def scaled_sanity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Grand mean and mean sample deviation of scaled columns: about 0 and 1 (C17)."""
    n = float(len(columns))
    mean = sum((F.avg(c) for c in columns[1:]), F.avg(columns[0])) / n
    std = sum((F.stddev_samp(c) for c in columns[1:]), F.stddev_samp(columns[0])) / n
    return df.agg(mean.alias("grand_mean"), std.alias("grand_std"))


def preprocessing_summary(raw: DataFrame, split: DataFrame, n_features: int) -> DataFrame:
    """Rows before and after, split sizes and feature count."""
    before = raw.agg(F.count("*").alias("n")).select(F.lit("raw_rows").alias("item"), "n")
    after = split.agg(
        F.count("*").alias("clean_rows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
        F.lit(n_features).cast("bigint").alias("n_features"),
    )
    names = ["clean_rows", "train_rows", "val_rows", "test_rows", "n_features"]
    return before.unionByName(after.unpivot([], names, "item", "n"))


