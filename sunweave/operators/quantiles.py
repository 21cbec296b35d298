"""Exact interpolated quantiles without gathering a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.session import small_side

SMALL_GROUP = 1_000_000
ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    small_group: int = SMALL_GROUP,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Rows (by..., column, prob, value) with linear interpolation, NULLs ignored.

    ``percentile`` keeps every distinct value of a group in one buffer, so it is used only when
    the counted groups have at most ``small_group`` values. Beyond that a sketch brackets each
    quantile within a few ranks per ``accuracy``, and only values inside the brackets are
    counted exactly: two narrow scans with tiny shuffles instead of sorting all values.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    counts = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])
    sizes = counts.unpivot(by, columns, "column", "n")
    high = sizes.agg(F.max("n")).first()[0]
    if not high or high <= small_group:
        return _direct(df, columns, probs, by)
    return _bracketed(df, columns, probs, by, sizes, accuracy)


def _direct(df, columns, probs, by):
    wide = df.groupBy(*by).agg(*[
        F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in columns
    ])
    long = wide.unpivot(by, columns, "column", "_values").where(F.col("_values").isNotNull())
    pairs = F.arrays_zip(F.array(*map(F.lit, probs)).alias("prob"), F.col("_values").alias("value"))
    return long.select(*by, "column", F.inline(pairs).alias("prob", "value"))


def _bracketed(df, columns, probs, by, sizes, accuracy):
    """Brackets ``2 / accuracy`` wide on either side; of a group and column with too few values for that
    to span three ranks, all values count. So a small group does not widen the brackets of a large one.
    """
    margin, few = 2.0 / accuracy, 1.5 * accuracy
    edges = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    k = len(probs)
    sketch = df.groupBy(*by).agg(
        *[F.percentile_approx(F.col(c).cast("double"), edges, accuracy).alias(c) for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    # One row per group: brackets[c] is an array over probs, joined to the rows by group only.
    tight = lambda c, i, end: F.when(F.col(f"_n_{c}") < few, F.lit(end)).otherwise(F.col(c)[i])
    wide = small_side(sketch.select(*by, *[
        F.array(*[
            F.struct(tight(c, i, float("-inf")).alias("lo"), tight(c, i + k, float("inf")).alias("hi")) for i in range(k)
        ]).alias(f"_b_{c}")
        for c in columns
    ]))
    if by:
        rows = df.join(wide, by)
    else:
        only = wide.first()
        rows = df.withColumns({
            f"_b_{c}": F.array(*[
                F.struct(F.lit(b["lo"]).cast("double").alias("lo"), F.lit(b["hi"]).cast("double").alias("hi"))
                for b in only[f"_b_{c}"]
            ])
            for c in columns
        })
    cells = rows.select(*by, *columns, *[f"_b_{c}" for c in columns])
    below = cells.groupBy(*by).agg(*[
        F.array(*[F.count_if(F.col(c) < F.col(f"_b_{c}")[i]["lo"]) for i in range(k)]).alias(c)
        for c in columns
    ]).unpivot(by, columns, "column", "_below")
    hits = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("i"), F.col(c).cast("double").alias("v"),
                 F.col(f"_b_{c}")[i].alias("b"))
        for c in columns for i in range(k)
    ])
    inside = F.filter(hits, lambda h: h["v"].between(h["b"]["lo"], h["b"]["hi"]))
    counted = (
        cells.select(*by, F.explode(inside).alias("h"))
        .groupBy(*by, "h.column", "h.i", "h.v").agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*by, "column", "i").orderBy("v")
    ranked = (
        counted.withColumn("_upto", F.sum("_c").over(upto))
        .join(below.join(sizes, [*by, "column"]), [*by, "column"])
    )
    prob = F.array(*map(F.lit, probs))[F.col("i")]
    at = prob * (F.col("n") - 1)
    reached = F.col("_below")[F.col("i")] + F.col("_upto")
    picked = ranked.groupBy(*by, "column", "i").agg(
        F.min(F.when(reached >= F.floor(at) + 1, F.col("v"))).alias("_lo"),
        F.min(F.when(reached >= F.ceil(at) + 1, F.col("v"))).alias("_hi"),
        F.first(at - F.floor(at)).alias("_frac"),
    )
    return picked.select(
        *by, "column", prob.alias("prob"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("value"),
    )


#: Size of a sketch; its quantiles are off by less than RANK_BOUND of the ranks but once in many thousand times.
SKETCH_SIZE, RANK_BOUND = 2000, 0.01


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable quantile sketch of each column per group, to be written once (by site and day, say). Opt-in: inexact."""
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(size)).alias(c) for c in columns])


def sketched_quantiles(sketches: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Rows (by..., column, prob, value) of groups of sketches merged on read, within ``RANK_BOUND`` of the exact rank.

    The raw rows are not read; coarser groups cost as little as finer ones.
    """
    merged = sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c, F.lit(size)).alias(c) for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))).alias("value"))
        for c in columns for p in probs
    ])
    return merged.select(*by, F.inline(cells))
