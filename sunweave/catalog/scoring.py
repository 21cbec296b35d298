"""Evaluation over persistence forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunweave.catalog.base import SQL_METRICS, SQL_PREDICTIONS, SQL_SCORES, clean_layout, predictions, query, r, rs, table, with_
from sunweave.catalog.cleaning import SQL_LEVEL
from sunweave.catalog.statistics import sql_histogram
from sunweave.catalog.timing import SQL_SEASON
from sunweave.operators import evaluate as ops
from sunweave.operators.ordered import laid_out
from sunweave.operators.resample import resample
from sunweave.plans.studies import persistence_horizons

SCORES = "rmse, mae, mape, r2, pearson_r, nrmse_pct"


def _one(name: str, metric: str):
    @query(name, with_(SQL_SCORES, f"SELECT model, {metric} FROM scores"), digits=4)
    def run(spark, sf_dir):
        return ops.metrics(predictions(spark, sf_dir), names=[metric])

    return run


for _name, _metric in (
    ("e01_rmse", "rmse"), ("e02_mae", "mae"), ("e03_mape", "mape"),
    ("e04_r2", "r2"), ("e05_pearson_r", "pearson_r"), ("e06_nrmse", "nrmse_pct"),
):
    _one(_name, _metric)


@query("e07_metrics", with_(SQL_PREDICTIONS, f"SELECT model, site, {SQL_METRICS} FROM pred GROUP BY model, site"), digits=4)
def metrics_by_site(spark, sf_dir):
    return ops.metrics(predictions(spark, sf_dir), ["model", "site"])


@query("e08_comparison", with_(SQL_SCORES, f"SELECT model AS label, {SCORES} FROM scores"), digits=4)
def comparison(spark, sf_dir):
    return ops.comparison_table(ops.metrics(predictions(spark, sf_dir)))


@query("e09_formatted", with_(SQL_SCORES, """
SELECT model, printf('%.2f W', rmse) AS rmse, printf('%.2f W', mae) AS mae, printf('%.2f', mape) || ' %' AS mape,
  printf('%.4f', r2) AS r2, printf('%.4f', pearson_r) AS pearson_r, printf('%.2f', nrmse_pct) || ' %' AS nrmse_pct
FROM scores"""))
def formatted(spark, sf_dir):
    return ops.formatted(ops.metrics(predictions(spark, sf_dir)))


@query("e10_residuals", with_(SQL_PREDICTIONS, f"""
SELECT model, site, idx, ts, {r('actual - predicted', 'residual')} FROM pred"""))
def residuals(spark, sf_dir):
    return ops.residuals(predictions(spark, sf_dir))


@query("e10_residual_histogram", with_(
    SQL_PREDICTIONS + ", res AS (SELECT model, actual - predicted AS residual FROM pred),",
    sql_histogram("res", "residual", 50, "model")), digits=4)
def residual_histogram(spark, sf_dir):
    return ops.residual_histogram(predictions(spark, sf_dir))


@query("e11_actual_vs_predicted", with_(SQL_PREDICTIONS, f"""
SELECT model, site, idx, ts, {rs(['actual', 'predicted'])} FROM pred
QUALIFY idx - min(idx) OVER (PARTITION BY model, site) < 500"""))
def actual_vs_predicted(spark, sf_dir):
    return ops.actual_vs_predicted(predictions(spark, sf_dir))


@query("e11_scatter_limits", with_(SQL_PREDICTIONS, f"""
SELECT model, {r('min(least(actual, predicted))', 'axis_min')}, {r('max(greatest(actual, predicted))', 'axis_max')},
  count(*) AS n_points FROM pred GROUP BY model"""))
def scatter_limits(spark, sf_dir):
    return ops.scatter_limits(predictions(spark, sf_dir))


@query("e12_metric_ranking", with_(SQL_SCORES + """,
long AS (SELECT model, 'rmse' AS metric, rmse AS value FROM scores UNION ALL SELECT model, 'mae', mae FROM scores
  UNION ALL SELECT model, 'mape', mape FROM scores UNION ALL SELECT model, 'r2', r2 FROM scores)""", """
SELECT model, metric, value, row_number() OVER (
  PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END, model) AS place FROM long"""), digits=4)
def metric_ranking(spark, sf_dir):
    return ops.metric_ranking(ops.metrics(predictions(spark, sf_dir)))


@query("e13_hourly_mae", with_(SQL_PREDICTIONS, """
SELECT model, hour(ts) AS hour, round(avg(abs(actual - predicted)), 4) AS mae FROM pred GROUP BY model, hour(ts)"""), digits=4)
def hourly_mae(spark, sf_dir):
    return ops.hourly_mae(predictions(spark, sf_dir))


def daily_predictions(spark, sf_dir):
    """Yesterday's mean order price as today's forecast, per priority: seven years of seasons."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("site"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("target"),
    )
    days = resample(orders, "day", complete=False)
    rows, bounded = laid_out(days)
    return ops.persistence(rows, (1, 7), bounded=bounded)


SQL_DAILY = """days AS (SELECT o_orderpriority AS site, o_orderdate AS ts, avg(o_totalprice) AS target FROM orders GROUP BY 1, 2),
back AS (SELECT site, ts, target AS actual, lag(target, 1) OVER w AS p1, lag(target, 7) OVER w AS p7
  FROM days WINDOW w AS (PARTITION BY site ORDER BY ts)),
pred AS (SELECT 'persistence_1' AS model, site, ts, actual, p1 AS predicted FROM back WHERE p1 IS NOT NULL
  UNION ALL SELECT 'persistence_7', site, ts, actual, p7 FROM back WHERE p7 IS NOT NULL)"""


@query("e14_seasonal_metrics", with_(SQL_DAILY, f"""
SELECT model, {SQL_SEASON.format('ts')} AS season, round(sqrt(avg((actual - predicted) ** 2)), 4) AS rmse,
  round(avg(abs(actual - predicted)), 4) AS mae,
  round(1 - sum((actual - predicted) ** 2) / (count(*) * var_pop(actual)), 4) AS r2
FROM pred GROUP BY 1, 2"""), digits=4)
def seasonal_metrics(spark, sf_dir):
    return ops.seasonal_metrics(daily_predictions(spark, sf_dir))


@query("e15_horizon_persistence", with_(SQL_PREDICTIONS.replace("[1, 4, 8]", "[1, 2, 4, 8]")
       .replace("[lag(target, 1) OVER w,", "[lag(target, 1) OVER w, lag(target, 2) OVER w,")
       .replace("WHEN 4 THEN 2 ELSE 3", "WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 4"), f"""
SELECT 'persistence' AS model, CAST(split_part(model, '_', 2) AS BIGINT) AS horizon, {SQL_METRICS}
FROM pred GROUP BY ALL"""), digits=4)
def horizon_persistence(spark, sf_dir):
    rows, bounded = clean_layout(spark, sf_dir)
    return persistence_horizons(rows, bounded=bounded)


@query("e17_prediction_band", with_(SQL_PREDICTIONS + """,
w AS (SELECT model, 1.96 * stddev_pop(actual - predicted) AS half FROM pred GROUP BY model)""", f"""
SELECT model, site, idx, ts, {rs(['actual', 'predicted'])}, {r('greatest(predicted - half, 0)', 'lower')},
  {r('predicted + half', 'upper')}, actual BETWEEN greatest(predicted - half, 0) AND predicted + half AS covered
FROM pred JOIN w USING (model)"""))
def prediction_band(spark, sf_dir):
    return ops.prediction_band(predictions(spark, sf_dir))


@query("e17_band_coverage", with_(SQL_PREDICTIONS + """,
w AS (SELECT model, 1.96 * stddev_pop(actual - predicted) AS half FROM pred GROUP BY model)""", f"""
SELECT model, {r('avg(CAST(actual BETWEEN greatest(predicted - half, 0) AND predicted + half AS INT))', 'coverage')},
  count(*) AS n_rows FROM pred JOIN w USING (model) GROUP BY model"""))
def band_coverage(spark, sf_dir):
    return ops.band_coverage(ops.prediction_band(predictions(spark, sf_dir)))


@query("e18_slice_metrics", with_(SQL_PREDICTIONS + """,
early AS (SELECT *, idx - min(idx) OVER (PARTITION BY model, site) AS step FROM pred)""", f"""
SELECT model, 'day' AS slice, {SQL_METRICS} FROM early WHERE step < 96 GROUP BY model UNION ALL
SELECT model, 'week', {SQL_METRICS} FROM early WHERE step < 672 GROUP BY model"""), digits=4)
def slice_metrics(spark, sf_dir):
    return ops.slice_metrics(predictions(spark, sf_dir))


SQL_LEVELS = SQL_PREDICTIONS + f""",
lev AS (SELECT * FROM (SELECT model, {SQL_LEVEL.format('actual')} AS t, {SQL_LEVEL.format('predicted')} AS p FROM pred)
  WHERE t IS NOT NULL AND p IS NOT NULL),
cells AS (SELECT DISTINCT model, unnest(['Low', 'Medium', 'High']) AS t FROM lev),
cells9 AS (SELECT model, t, unnest(['Low', 'Medium', 'High']) AS p FROM cells),
counted AS (SELECT model, t, p, count(*) AS k FROM lev GROUP BY ALL),
cm AS (SELECT model, t, p, coalesce(k, 0) AS n FROM cells9 LEFT JOIN counted USING (model, t, p))"""


@query("e19_confusion_matrix", with_(SQL_LEVELS, "SELECT model, t AS true_level, p AS predicted_level, n FROM cm"))
def confusion_matrix(spark, sf_dir):
    return ops.confusion_matrix(predictions(spark, sf_dir))


@query("e20_level_accuracy", with_(SQL_LEVELS, f"""
SELECT model, {r('avg(CAST(t = p AS INT))', 'accuracy')}, count(*) AS support FROM lev GROUP BY model"""))
def level_accuracy(spark, sf_dir):
    return ops.level_accuracy(predictions(spark, sf_dir))


@query("e21_classification_report", with_(SQL_LEVELS + """,
one AS (SELECT model, t AS label, CAST(sum(n) AS DOUBLE) AS support,
    CAST(sum(CASE WHEN t = p THEN n ELSE 0 END) AS DOUBLE) AS hits FROM cm GROUP BY 1, 2),
two AS (SELECT model, p AS label, CAST(sum(n) AS DOUBLE) AS said FROM cm GROUP BY 1, 2),
per AS (SELECT model, label, support, said, hits,
    CASE WHEN said > 0 THEN hits / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re
  FROM one JOIN two USING (model, label) WHERE support + said > 0),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM per)""", """
SELECT model, label, round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS "f1-score", round(support, 4) AS support FROM f
UNION ALL SELECT model, 'accuracy', round(sum(hits) / sum(support), 4), round(sum(hits) / sum(support), 4),
  round(sum(hits) / sum(support), 4), round(sum(hits) / sum(support), 4) FROM f GROUP BY model
UNION ALL SELECT model, 'macro avg', round(avg(pr), 4), round(avg(re), 4), round(avg(f1), 4), sum(support) FROM f GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(pr * support) / sum(support), 4), round(sum(re * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support) FROM f GROUP BY model"""), digits=4)
def classification_report(spark, sf_dir):
    return ops.classification_report(predictions(spark, sf_dir))
