"""Forecast errors as mergeable moments: one scan of the predictions, every table from its cells.

A cell holds counts, error sums, and means with centred squares of the rows of one model, season, hour, slice and pair
of power levels: at most 4 x 24 x (slices + 1) x 16 cells a model, whatever the number of rows. Cells are
merged by the pairwise rule for centred squares, so nothing is lost to large means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunweave.functions import power_level, season
from sunweave.operators.evaluate import LEVELS, METRICS, Z_95, from_start, report_from_confusion

DIMENSIONS = ("model", "season", "hour", "slice_no", "true_level", "predicted_level")
SLICES = {"day": 96, "week": 672}
_SUMS = ("n_rows", "n", "sse", "sae", "spe")


def error_cells(predictions: DataFrame, slices: dict[str, int] | None = None, eps: float = 1e-6) -> DataFrame:
    """One row per combination of ``DIMENSIONS`` that occurs, with its moments; write it before use.

    ``slice_no`` counts the slices (shortest first) that a row lies behind. Rows without truth or prediction
    only count as ``n_rows``.
    """
    lengths = sorted((SLICES if slices is None else slices).values())
    known = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    y, p = (F.when(known, F.col(c).cast("double")) for c in ("actual", "predicted"))
    rows = from_start(predictions) if lengths else predictions.withColumn("step", F.lit(0))
    rows = rows.select(
        "model", season(F.col("ts")).alias("season"), F.hour("ts").alias("hour"),
        sum(((F.col("step") >= n).cast("int") for n in lengths), F.lit(0)).alias("slice_no"), y.alias("y"), p.alias("p"),
        power_level(y).alias("true_level"), power_level(p).alias("predicted_level"),
    )
    y, p, miss = F.col("y"), F.col("p"), F.col("y") - F.col("p")
    n = F.count("y")
    return rows.groupBy(*DIMENSIONS).agg(
        F.count("*").alias("n_rows"), n.alias("n"), F.sum(miss * miss).alias("sse"), F.sum(F.abs(miss)).alias("sae"),
        F.sum(F.abs(miss / (F.abs(y) + eps))).alias("spe"),
        F.avg(y).alias("mean_y"), F.avg(p).alias("mean_p"), F.avg(miss).alias("mean_r"),
        (F.var_pop(y) * n).alias("m2_y"), (F.var_pop(p) * n).alias("m2_p"), (F.var_pop(miss) * n).alias("m2_r"), (F.covar_pop(y, p) * n).alias("c_yp"),
        F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.min(p).alias("min_p"), F.max(p).alias("max_p"),
    )


def merged(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of the coarser grouping ``by``, with the same moments."""
    w = Window.partitionBy(*by)
    n = F.col("n")
    whole = F.nullif(F.sum("n").over(w), F.lit(0))
    means = {c: F.sum(n * F.col(f"mean_{c}")).over(w) / whole for c in "ypr"}
    rows = cells.select("*", *[m.alias(f"_m{c}") for c, m in means.items()])
    off = {c: F.col(f"mean_{c}") - F.col(f"_m{c}") for c in "ypr"}
    return rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[F.first(f"_m{c}").alias(f"mean_{c}") for c in "ypr"],
        *[F.sum(F.col(f"m2_{c}") + n * off[c] * off[c]).alias(f"m2_{c}") for c in "ypr"],
        F.sum(F.col("c_yp") + n * off["y"] * off["p"]).alias("c_yp"),
        *[f(c).alias(c) for f, c in ((F.min, "min_y"), (F.max, "max_y"), (F.min, "min_p"), (F.max, "max_p"))],
    )


def metric_columns(names: Sequence[str] = METRICS, digits: int | None = 4) -> list[Column]:
    """The metrics of ``evaluate.metrics`` from moments."""
    n = F.nullif(F.col("n"), F.lit(0))
    varies = F.col("max_y") > F.col("min_y")
    rmse = F.sqrt(F.col("sse") / n)
    span = F.col("max_y") - F.col("min_y")
    spread = F.when(varies & (F.col("max_p") > F.col("min_p")), F.sqrt(F.col("m2_y")) * F.sqrt(F.col("m2_p")))
    found = {
        "rmse": rmse, "mae": F.col("sae") / n, "mape": F.col("spe") / n * 100,
        "r2": F.when(varies, 1 - F.col("sse") / F.nullif(F.col("m2_y"), F.lit(0.0))).when(F.col("sse") == 0, 1.0).when(n.isNotNull(), 0.0),
        "pearson_r": F.col("c_yp") / F.nullif(spread, F.lit(0.0)),
        "nrmse_pct": F.when(span >= 1e-6, rmse / F.nullif(span, F.lit(0.0)) * 100),
    }
    return [(found[c] if digits is None else F.round(found[c], digits)).alias(c) for c in names]


def scores(cells: DataFrame, by: Sequence[str] = ("model",), names: Sequence[str] = METRICS, digits: int | None = 4, counts: bool = False) -> DataFrame:
    """Metrics per group; groups without a scored row are left out unless ``counts`` are asked for."""
    out = merged(cells, by)
    more = ["n_rows", (F.col("n_rows") - F.col("n")).alias("n_unscored")] if counts else []
    return (out if counts else out.where("n > 0")).select(*by, *metric_columns(names, digits), *more)


def slice_scores(cells: DataFrame, slices: dict[str, int] | None = None) -> DataFrame:
    """Metrics over the first rows of each forecast (E18): a slice is the sum of the cells up to it."""
    order = sorted((SLICES if slices is None else slices).items(), key=lambda x: x[1])
    names = F.array(*[F.when(F.col("slice_no") <= i, F.lit(name)) for i, (name, _) in enumerate(order)])
    long = cells.withColumn("slice", F.explode(F.filter(names, lambda s: s.isNotNull())))
    return scores(long, ["model", "slice"])


def confusion(cells: DataFrame) -> DataFrame:
    """Counts for every pair of levels, zeros included."""
    both = cells.where("true_level is not null and predicted_level is not null")
    pairs = F.array(*[
        F.struct(
            F.lit(t).alias("true_level"), F.lit(p).alias("predicted_level"),
            F.sum(F.when((F.col("true_level") == t) & (F.col("predicted_level") == p), F.col("n")).otherwise(0)).alias("n"),
        )
        for t in LEVELS for p in LEVELS
    ])
    return both.groupBy("model").agg(pairs.alias("_cells")).select("model", F.inline("_cells"))


def accuracy(cells: DataFrame) -> DataFrame:
    """Share of rows whose level was met."""
    both = cells.where("true_level is not null and predicted_level is not null")
    hit = F.sum(F.when(F.col("true_level") == F.col("predicted_level"), F.col("n")).otherwise(0))
    return both.groupBy("model").agg((hit / F.sum("n")).alias("accuracy"), F.sum("n").alias("support"))


def classification(cells: DataFrame, digits: int = 4) -> DataFrame:
    return report_from_confusion(confusion(cells), digits)


def half_widths(cells: DataFrame, z: float = Z_95) -> DataFrame:
    """Half width of the band per model."""
    return merged(cells, ["model"]).where("n > 0").select("model", (F.sqrt(F.col("m2_r") / F.col("n")) * z).alias("half_width"))


def coverage(predictions: DataFrame, cells: DataFrame, z: float = Z_95) -> DataFrame:
    """Share of rows within the band: the one table that reads the predictions again, since the width comes first."""
    widths = F.broadcast(half_widths(cells, z))  # one row per model
    lower = F.greatest(F.col("predicted") - F.col("half_width"), F.lit(0.0))
    inside = F.col("actual").between(lower, F.col("predicted") + F.col("half_width"))
    return predictions.join(widths, "model").groupBy("model").agg(F.avg(inside.cast("int")).alias("coverage"), F.count("*").alias("n_rows"))
