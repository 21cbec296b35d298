"""Whole jobs: the three ways to prepare the series, reload and score, all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.catalog.base import (
    CYCLES,
    KEPT,
    LAGGED,
    LATITUDE,
    MODEL_FEATURES,
    ROLLED,
    SQL_PREDICTIONS,
    SQL_STD,
    SQL_TIME,
    VALUES,
    predictions,
    query,
    r,
    sql_clearness,
    sql_fill,
    sql_lags,
    sql_rolls,
    std,
    with_,
)
from sunweave.catalog.learning import bundle, skilled_rows, sql_skilled_rows
from sunweave.catalog.order import RAW_ORDER, SQL_INDEXED
from sunweave.catalog.scaling import SQL_ROWS
from sunweave.models import load_forecaster
from sunweave.models.registry import model_label
from sunweave.operators import error_cube
from sunweave.operators.evaluate import comparison_table, metrics
from sunweave.plans.prepare import prepare, split_features
from sunweave.plans.report import analysis_tables, dataset_dictionary
from sunweave.plans.train import fit_tabular, reload_and_score, score_tabular, sequences_of, train_all
from sunweave.schema import FEATURES_13, FEATURES_18
from sunweave.session import stage, staging_path

SQL_RAW_FEATURES = SQL_INDEXED + f""",
f AS (SELECT *, {SQL_TIME}, {sql_clearness()} AS clearness_index,
  {sql_lags(['irr_horiz', 'target'], order=RAW_ORDER)}, {sql_rolls('irr_horiz', order=RAW_ORDER)} FROM pos),
warm AS (SELECT * FROM f WHERE idx >= 8 AND target >= 0)"""
# At raw cadence the clearness index is unknown at night and so above half NULL, like the humidity.
_SPARSE = ("rh", "clearness_index")
_ALL = [*(c for c in VALUES if c != "rh"), *CYCLES, "month", *LAGGED, *ROLLED]
_CUT = """, sized AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {order}) - 1 AS spot,
    count(*) OVER (PARTITION BY site) AS n FROM filled WHERE target IS NOT NULL),
parts AS (SELECT *, CASE WHEN spot < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN spot < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM sized),
usable AS (SELECT * FROM parts WHERE {known})"""


def _known(names) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in names if c not in _SPARSE)


_SUMMARY = f"""
SELECT site, split, count(*) AS n_rows, {r('avg(target)', 'target_mean')}, {r('avg(irr_horiz)', 'irr_mean')},
  {r('avg(hour_sin)', 'hour_sin_mean')}, {r('avg(month)', 'month_mean')}, {r('avg(target_lag4)', 'lag4_mean')},
  min(ts) AS first_ts, max(ts) AS last_ts FROM usable GROUP BY site, split"""


def _summary(rows):
    return rows.groupBy("site", "split").agg(
        F.count("*").alias("n_rows"), F.avg("target").alias("target_mean"), F.avg("irr_horiz").alias("irr_mean"),
        F.avg("hour_sin").alias("hour_sin_mean"), F.avg("month").alias("month_mean"),
        F.avg("target_lag4").alias("lag4_mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("j01_prepare_cli13", with_(SQL_RAW_FEATURES + f""",
filled AS (SELECT site, ts, row_id, {', '.join(sql_fill(c, RAW_ORDER) for c in _ALL)}
  FROM warm WHERE irr_horiz > 5)""" + _CUT.format(order=RAW_ORDER, known=_known([*FEATURES_13, "target"])), _SUMMARY))
def prepare_cli13(spark, sf_dir):
    """Features at raw cadence, no resampling, 13 features."""
    rows, _ = split_features(std(spark, sf_dir), preset="cli13", latitude=LATITUDE)
    return _summary(rows)


@query("j01_prepare_notebook", with_(SQL_RAW_FEATURES + f""",
binned AS (SELECT site, time_bucket(INTERVAL '15 minutes', ts) AS ts, {', '.join(f'avg({c}) AS {c}' for c in _ALL)}
  FROM warm GROUP BY 1, 2),
filled AS (SELECT site, ts, {', '.join(sql_fill(c) for c in _ALL)} FROM binned WHERE irr_horiz > 5)"""
    + _CUT.format(order="ts", known=_known([*FEATURES_18, "target"])), _SUMMARY))
def prepare_notebook(spark, sf_dir):
    """Features at raw cadence, then averaged into 15-minute bins, 18 features."""
    rows, _ = split_features(std(spark, sf_dir), preset="notebook", latitude=LATITUDE)
    return _summary(rows)


_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in KEPT)


@query("j01_audit", with_(SQL_ROWS, f"""
SELECT 'read' AS stage, count(*) AS n_rows, 0 AS n_null, 'rh' AS dropped FROM std
UNION ALL SELECT 'target known', count(*), 0, 'rh' FROM std WHERE target >= 0
UNION ALL SELECT 'gridded', count(*), {_NULLS}, 'rh' FROM bins WHERE irr_horiz > 5
UNION ALL SELECT 'filled', count(*), {_NULLS}, 'rh' FROM indexed
UNION ALL SELECT 'usable', count(*), 0, 'rh' FROM usable"""))
def prepare_audit(spark, sf_dir):
    """Rows and NULL cells after each stage of the documented preset, counted while it ran, and the sensors it dropped."""
    audit = bundle(spark, sf_dir).audit
    table = spark.createDataFrame(audit.rows(), "stage string, n_rows long, n_null long")
    return table.withColumn("dropped", F.lit(",".join(audit.dropped)))


@query("j02_train_tabular", sql_skilled_rows(SQL_RAW_FEATURES + f""",
filled AS (SELECT site, ts, row_id, {', '.join(sql_fill(c, RAW_ORDER) for c in _ALL)}
  FROM warm WHERE irr_horiz > 5)""" + _CUT.format(order=RAW_ORDER, known=_known([*FEATURES_13, "target"])), "lr", order=RAW_ORDER))
def train_tabular_rows(spark, sf_dir):
    """Every test row at raw cadence scored by ridge, within a widened range of the training target, and ridge against the training mean."""
    data = prepare(std(spark, sf_dir), preset="cli13", latitude=LATITUDE)
    return skilled_rows(score_tabular(fit_tabular("lr", data), data.test), data, 1.0)


@query("j03_sequence_inputs", with_(SQL_ROWS, """
SELECT site, split, count(*) - 16 AS n_windows, 16 AS min_steps, count(*) - 1 AS last_pos
FROM usable GROUP BY site, split HAVING count(*) > 16"""))
def sequence_inputs(spark, sf_dir):
    """Windows per site and split: rows minus the look-back."""
    data = bundle(spark, sf_dir)
    counts = [
        sequences_of(data, part).groupBy("site", "split").agg(
            F.count("*").alias("n_windows"), F.min(F.size("seq")).alias("min_steps"), F.max("pos").alias("last_pos")
        )
        for part in ("train", "val", "test")
    ]
    return reduce(DataFrame.unionByName, counts)


_SAVED = {"lr": 0, "rf": 0, "gbt": 0, "seq_flat": 16, "seq_recurrent": 16}


@query("j05_reload_and_score", with_(SQL_ROWS + """,
lengths AS (SELECT site, count(*) AS n FROM usable WHERE split = 'test' GROUP BY site)""", " UNION ALL ".join(f"""
SELECT '{model_label(m)}' AS model, CAST(sum(greatest(n - {late}, 0)) AS BIGINT) AS n_rows, CAST(sum(greatest(n - {late}, 0)) AS BIGINT) AS n_same,
  true AS same_metrics FROM lengths""" for m, late in _SAVED.items())))
def reload_score(spark, sf_dir):
    """Saved models of every kind, reloaded and scored: rows that say what the fitted model says, and equal comparison tables."""
    data = bundle(spark, sf_dir)
    fitted, scored = train_all(data, tuple(_SAVED), {"rf": {"trees": 20, "depth": 8}, "gbt": {"rounds": 20, "depth": 4}})
    paths = {key: staging_path(spark, key) for key in fitted}
    for key, model in fitted.items():
        model.save(paths[key])
    first = stage(scored, "fitted")
    again = stage(reload_and_score({key: load_forecaster(spark, key, path) for key, path in paths.items()}, data), "reloaded")
    both = again.join(first.withColumnRenamed("predicted", "first").drop("ts", "actual"), ["model", "site", "idx"])
    rows = both.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("predicted") - F.col("first")) <= 1e-6).alias("n_same"))
    tables = [comparison_table(metrics(x)).withColumnRenamed("rmse", n).select(F.col("label").alias("model"), n) for x, n in ((first, "one"), (again, "two"))]
    return rows.join(tables[0], "model").join(tables[1], "model").select("model", "n_rows", "n_same", (F.col("one") == F.col("two")).alias("same_metrics"))


_SENSORS = {
    "irr_horiz": ("Solar Irradiance", "FPHIRR", "W/m²"),
    "amb_temp": ("Ambient Temperature", "FAMBTM", "°C"),
    "rh": ("Relative Humidity", "FPV_RH", "%"),
    "wind_speed": ("Wind Speed", "FWINDS", "m/s"),
    "pressure": ("Atmospheric Pressure", "FVPRES", "hPa"),
    "target": ("PV Power Output (Target)", "INVPWR", "W"),
}


@query("e22_dataset_dictionary", with_(SQL_STD, " UNION ALL ".join(f"""
SELECT '{title}' AS feature_name, '{raw}' AS raw_column, '{name}' AS standard_name, '{unit}' AS unit, count({name}) AS n_known
FROM std WHERE site = 'site_b'""" for name, (title, raw, unit) in _SENSORS.items())))
def dictionary(spark, sf_dir):
    """The documented sensors of a site with the number of readings each has."""
    rows = std(spark, sf_dir).where("site = 'site_b'")
    known = rows.agg(*[F.count(c).alias(c) for c in VALUES]).unpivot([], VALUES, "standard_name", "n_known")
    table = dataset_dictionary(spark, "site_b").drop("description")
    return known.join(F.broadcast(table), "standard_name")


_PER_MODEL = {"comparison": 1, "report": 1, "ranking": 4, "confusion": 9, "accuracy": 1, "classification": 6, "coverage": 1, "slices": 2}
_SMALL = {"lr": {}, "rf": {"trees": 20, "depth": 8}}


@query("j06_analysis_tables", with_(SQL_PREDICTIONS, " UNION ALL ".join([
    *(f"SELECT '{t}' AS table_name, {n} AS n_rows" for t, n in (
        ("dictionary", len(_SENSORS)), ("summary", len(VALUES)), ("correlation", len(VALUES) * (len(VALUES) - 1) // 2),
        ("complexity", 2), ("importance", len(MODEL_FEATURES)), ("horizons", 4), ("training_length", 10))),
    *(f"SELECT '{t}', {n} * count(DISTINCT model) FROM pred" for t, n in _PER_MODEL.items()),
    "SELECT 'seasonal', count(DISTINCT (model, month(ts) % 12 // 3)) FROM pred",
    "SELECT 'hourly', count(DISTINCT (model, hour(ts))) FROM pred",
    "SELECT 'monthly_box', count(DISTINCT month(ts)) FROM std WHERE irr_horiz IS NOT NULL",
    "SELECT 'best_day', 96 * count(DISTINCT site) FROM std",
    "SELECT 'yearly', count(DISTINCT (site, year(ts))) FROM std",
]).replace("SELECT", "\nSELECT")))
def all_tables(spark, sf_dir):
    """Every analysis table is computed; the result lists each with its row count (the number of settings is Spark's)."""
    rows = stage(predictions(spark, sf_dir), "predictions")
    data = bundle(spark, sf_dir)
    models = {key: fit_tabular(key, data, **params) for key, params in _SMALL.items()}
    tables = analysis_tables(stage(std(spark, sf_dir), "std"), "site_b", rows, data, models)
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).where("table_name <> 'hyperparameters'")


_CELLS = SQL_PREDICTIONS + """,
begun AS (SELECT *, idx - min(idx) OVER (PARTITION BY model, site) AS step FROM pred),
long AS (
  SELECT 'model' AS grouping, '' AS part, * FROM begun
  UNION ALL SELECT 'season', CASE month(ts) % 12 // 3 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Autumn' END, * FROM begun
  UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), * FROM begun
  UNION ALL SELECT 'slice', 'day', * FROM begun WHERE step < 96
  UNION ALL SELECT 'slice', 'week', * FROM begun WHERE step < 672)"""


@query("j06_error_cube", with_(_CELLS, f"""
SELECT grouping, part, model, count(*) AS n, {r('sqrt(avg((actual - predicted) ** 2))', 'rmse', 3)}, {r('avg(abs(actual - predicted))', 'mae', 3)},
  {r('avg(abs((actual - predicted) / (abs(actual) + 1e-6))) * 100', 'mape', 1)},
  {r('CASE WHEN max(actual) > min(actual) THEN 1 - sum((actual - predicted) ** 2) / (count(*) * var_pop(actual)) WHEN sum((actual - predicted) ** 2) = 0 THEN 1 ELSE 0 END', 'r2', 3)}
FROM long GROUP BY grouping, part, model"""), digits=3)
def error_cube_tables(spark, sf_dir):
    """Metrics by model, season, hour and slice, all from the cells of one scan of the predictions."""
    cells = stage(error_cube.error_cells(stage(predictions(spark, sf_dir), "predictions")), "error-cells")
    names = ["rmse", "mae", "mape", "r2"]

    def table(name, rows, part):
        kept = [F.round(c, 1).alias(c) if c == "mape" else F.col(c) for c in names]
        return rows.select(F.lit(name).alias("grouping"), part.cast("string").alias("part"), "model", "n", *kept)

    def by(*keys):
        return error_cube.merged(cells, ["model", *keys]).where("n > 0").select("model", *keys, "n", *error_cube.metric_columns(names, None))

    slices = [("day", 0), ("week", 1)]
    early = [error_cube.merged(cells.where(F.col("slice_no") <= i), ["model"]).where("n > 0").select("model", F.lit(s).alias("slice"), "n", *error_cube.metric_columns(names, None)) for s, i in slices]
    parts = [table("model", by(), F.lit("")), table("season", by("season"), F.col("season")), table("hour", by("hour"), F.col("hour"))]
    return reduce(DataFrame.unionByName, [*parts, *(table("slice", x, F.col("slice")) for x in early)])
