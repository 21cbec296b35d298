"""Forecast evaluation over long predictions: (model, site, idx, ts, actual, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunweave.functions import correlation, power_level, season
from sunweave.operators.eda import histogram
from sunweave.operators.ordered import look_back, position_slice
from sunweave.session import small_side

METRICS = ("rmse", "mae", "mape", "r2", "pearson_r", "nrmse_pct")
LEVELS = ("Low", "Medium", "High")
Z_95 = 1.96


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column, eps: float = 1e-6) -> Column:
    """Percent of |truth| + eps: very large where the truth is near zero, by definition."""
    return F.avg(F.abs((y - p) / (F.abs(y) + eps))) * 100


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; a constant truth scores 1 if matched exactly, else 0."""
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst != 0, 1 - sse / F.nullif(sst, F.lit(0.0))).when(sse == 0, 1.0).otherwise(0.0)


def pearson_r(y: Column, p: Column) -> Column:
    """NULL when either side is constant."""
    return correlation(y, p)


def nrmse_pct(y: Column, p: Column) -> Column:
    """RMSE as percent of the truth's range; NULL below a range of 1e-6."""
    span = F.max(y) - F.min(y)
    return F.when(span >= 1e-6, rmse(y, p) / F.nullif(span, F.lit(0.0)) * 100)


FORMULAS = {
    "rmse": rmse, "mae": mae, "mape": mape, "r2": r2, "pearson_r": pearson_r, "nrmse_pct": nrmse_pct,
}


def metric_columns(names: Sequence[str] = METRICS, digits: int | None = 4) -> list[Column]:
    y, p = F.col("actual"), F.col("predicted")
    out = [FORMULAS[n](y, p).alias(n) for n in names]
    return out if digits is None else [F.round(FORMULAS[n](y, p), digits).alias(n) for n in names]


def metrics(
    predictions: DataFrame,
    by: Sequence[str | Column] = ("model",),
    names: Sequence[str] = METRICS,
    digits: int | None = 4,
    counts: bool = False,
) -> DataFrame:
    """All metrics per group in one aggregate (E07); rows without truth or prediction do not count.

    With ``counts``, ``n_rows`` and ``n_unscored`` tell how many rows there were and how many of them
    did not count; a group without any scored row then appears with NULL metrics.
    """
    known = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    if not counts:
        return predictions.where(known).groupBy(*by).agg(*metric_columns(names, digits))
    blank = {c: F.when(known, F.col(c)) for c in ("actual", "predicted")}
    return predictions.withColumns(blank).groupBy(*by).agg(
        *metric_columns(names, digits), F.count("*").alias("n_rows"), F.count_if(F.col("actual").isNull()).alias("n_unscored")
    )


def persistence(
    df: DataFrame, steps: Sequence[int] = (1,), target: str = "target", **layout
) -> DataFrame:
    """Forecast "the value n rows ago" for each n, as long predictions without NULLs."""
    back = look_back(df, max(steps), lambda w: {f"_p{n}": F.lag(target, n).over(w) for n in steps}, **layout)
    cells = F.array(*[
        F.struct(F.lit(f"persistence_{n}").alias("model"), F.col(f"_p{n}").alias("predicted")) for n in steps
    ])
    return back.select("site", "idx", "ts", F.col(target).alias("actual"), F.inline(cells)).where(
        F.col("predicted").isNotNull()
    )


def comparison_table(metric_rows: DataFrame) -> DataFrame:
    """Best RMSE first; ties by label."""
    return metric_rows.withColumnRenamed("model", "label").orderBy("rmse", "label")


def ranked_comparison(metric_rows: DataFrame) -> DataFrame:
    """Comparison with a 1-based place; one row per model."""
    table = metric_rows.withColumnRenamed("model", "label")
    return table.withColumn("place", F.row_number().over(Window.orderBy("rmse", "label")))


def formatted(metric_rows: DataFrame) -> DataFrame:
    """Metrics as text with their usual digits and units."""
    shape = {"rmse": "%.2f W", "mae": "%.2f W", "mape": "%.2f %%", "r2": "%.4f", "pearson_r": "%.4f", "nrmse_pct": "%.2f %%"}
    return metric_rows.select("model", *[
        F.format_string(fmt, F.col(name)).alias(name) for name, fmt in shape.items()
    ])


def residuals(predictions: DataFrame) -> DataFrame:
    """Truth minus prediction at each position."""
    return predictions.select(
        "model", "site", "idx", "ts", (F.col("actual") - F.col("predicted")).alias("residual")
    )


def residual_histogram(predictions: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(residuals(predictions), "residual", bins, ["model"])


def from_start(predictions: DataFrame) -> DataFrame:
    """Adds ``step``: rows since the first forecast of the model for the series, which may start late."""
    starts = predictions.groupBy("model", "site").agg(F.min("idx").alias("_start"))
    return predictions.join(small_side(starts), ["model", "site"]).withColumn("step", F.col("idx") - F.col("_start")).drop("_start")


def actual_vs_predicted(predictions: DataFrame, first_rows: int = 500) -> DataFrame:
    """The first forecasts of each model and series, ready to draw."""
    return from_start(predictions).where(F.col("step") < first_rows).select(
        "model", "site", "idx", "ts", "actual", "predicted"
    )


def scatter_limits(predictions: DataFrame) -> DataFrame:
    """Axis limits of the y = x line per model."""
    return predictions.groupBy("model").agg(
        F.min(F.least("actual", "predicted")).alias("axis_min"),
        F.max(F.greatest("actual", "predicted")).alias("axis_max"),
        F.count("*").alias("n_points"),
    )


def metric_ranking(metric_rows: DataFrame, names: Sequence[str] = ("rmse", "mae", "mape", "r2")) -> DataFrame:
    """Place of each model per metric: errors ascending, R2 descending."""
    long = metric_rows.unpivot(["model"], list(names), "metric", "value")
    key = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(key, "model")))


def hourly_mae(predictions: DataFrame) -> DataFrame:
    """MAE by hour of day."""
    return metrics(predictions, ["model", F.hour("ts").alias("hour")], ["mae"])


def seasonal_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE and R2 by season."""
    return metrics(predictions, ["model", season(F.col("ts")).alias("season")], ["rmse", "mae", "r2"])


def band_widths(predictions: DataFrame, z: float = Z_95) -> DataFrame:
    """Half width of the band per model: z x population deviation of the residuals."""
    return predictions.groupBy("model").agg(
        (F.stddev_pop(F.col("actual") - F.col("predicted")) * z).alias("half_width")
    )


def prediction_band(predictions: DataFrame, z: float = Z_95) -> DataFrame:
    """Band around each prediction, lower edge not below 0, and whether it holds the truth."""
    banded = predictions.join(small_side(band_widths(predictions, z)), "model")
    lower = F.greatest(F.col("predicted") - F.col("half_width"), F.lit(0.0))
    upper = F.col("predicted") + F.col("half_width")
    return banded.select(
        "model", "site", "idx", "ts", "actual", "predicted", lower.alias("lower"), upper.alias("upper"),
        F.col("actual").between(lower, upper).alias("covered"),
    )


def band_coverage(banded: DataFrame) -> DataFrame:
    return banded.groupBy("model").agg(
        F.avg(F.col("covered").cast("int")).alias("coverage"), F.count("*").alias("n_rows")
    )


def slice_metrics(predictions: DataFrame, slices: dict[str, int] | None = None) -> DataFrame:
    """Metrics over the first day and week of the forecast (E18), in one pass."""
    slices = {"day": 96, "week": 672} if slices is None else slices
    name = F.explode(F.filter(
        F.array(*[F.when(F.col("step") < n, F.lit(s)) for s, n in slices.items()]), lambda s: s.isNotNull()
    ))
    longest = max(slices.values())
    early = from_start(predictions).where(F.col("step") < longest)
    return metrics(early.withColumn("slice", name), ["model", "slice"])


def with_levels(predictions: DataFrame) -> DataFrame:
    """Power levels of truth and prediction; rows without both levels go."""
    return predictions.select(
        "model", power_level(F.col("actual")).alias("true_level"),
        power_level(F.col("predicted")).alias("predicted_level"),
    ).dropna()


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts for every pair of levels, zeros included (E19): one aggregate, no join."""
    rank = {level: i for i, level in enumerate(LEVELS)}
    cells = F.array(*[
        F.struct(
            F.lit(t).alias("true_level"), F.lit(p).alias("predicted_level"),
            F.count_if((F.col("true_level") == t) & (F.col("predicted_level") == p)).alias("n"),
        )
        for t in rank for p in rank
    ])
    return with_levels(predictions).groupBy("model").agg(cells.alias("_cells")).select(
        "model", F.inline("_cells")
    )


def level_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows whose level was met."""
    hit = (F.col("true_level") == F.col("predicted_level")).cast("int")
    return with_levels(predictions).groupBy("model").agg(
        F.avg(hit).alias("accuracy"), F.count("*").alias("support")
    )


def classification_report(predictions: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per level, then accuracy and the averages."""
    return report_from_confusion(confusion_matrix(predictions), digits)


def report_from_confusion(cm: DataFrame, digits: int = 4) -> DataFrame:
    """The report from the 9 cells per model of the confusion matrix.

    A level absent from both truth and prediction has no row; a level never predicted has precision 0.
    """
    both = F.explode(F.array(
        F.struct(F.col("true_level").alias("label"), F.col("n").alias("support"), F.lit(0).alias("said")),
        F.struct(F.col("predicted_level").alias("label"), F.lit(0).alias("support"), F.col("n").alias("said")),
    ))
    hit = F.when(F.col("true_level") == F.col("predicted_level"), F.col("n")).otherwise(0)
    per = (
        cm.select("model", both.alias("s"), hit.alias("hit"), "true_level")
        .groupBy("model", F.col("s.label").alias("label"))
        .agg(
            F.sum("s.support").cast("double").alias("support"), F.sum("s.said").cast("double").alias("said"),
            (F.sum("hit") / 2).alias("hits"),
        )
        .where("support + said > 0")
    )
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)
    scored = per.withColumns({
        "precision": ratio(F.col("hits"), F.col("said")), "recall": ratio(F.col("hits"), F.col("support")),
    }).withColumn(
        "f1-score",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    names = ["precision", "recall", "f1-score"]
    total = F.sum("support")
    accuracy = F.sum("hits") / total
    summary = scored.groupBy("model").agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(n) for n in names], accuracy.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(f"`{n}`").alias(n) for n in names], total.alias("support")),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[(F.sum(F.col(f"`{n}`") * F.col("support")) / total).alias(n) for n in names],
            total.alias("support"),
        ),
    ).alias("_rows")).select("model", F.inline("_rows"))
    report = scored.select("model", "label", *[f"`{n}`" for n in names], "support").unionByName(summary)
    return report.select("model", "label", *[F.round(F.col(f"`{n}`"), digits).alias(n) for n in [*names, "support"]])


def top_models(metric_rows: DataFrame, n: int = 3) -> DataFrame:
    """The n best models by RMSE."""
    return metric_rows.orderBy("rmse", "model").limit(n)


def prediction_errors(predictions: DataFrame) -> DataFrame:
    """One row per test position with each model's prediction and absolute error."""
    models = [r[0] for r in predictions.select("model").distinct().orderBy("model").collect()]
    at = lambda m, c: F.max(F.when(F.col("model") == m, c))
    miss = F.abs(F.col("actual") - F.col("predicted"))
    return predictions.groupBy("site", "idx").agg(
        F.max("actual").alias("actual"),
        *[at(m, F.col("predicted")).alias(f"{m}_pred") for m in models],
        *[at(m, miss).alias(f"{m}_err") for m in models],
    )
