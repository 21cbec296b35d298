"""Projection, filter and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunweave.catalog.base import (
    KEPT,
    MODEL_FEATURES,
    SQL_BINS,
    SQL_CLEAN,
    SQL_PREDICTIONS,
    SQL_SPLIT,
    SQL_STD,
    VALUES,
    clean,
    features,
    parts,
    predictions,
    query,
    rs,
    sql_fill,
    std,
    with_,
)
from sunweave.functions import clamp_non_negative, power_level
from sunweave.operators import cleaning as ops
from sunweave.operators.ordered import index_rows
from sunweave.operators.resample import resample_mean

NO_RH = [c for c in VALUES if c != "rh"]


@query("p01_drop_bad_target", with_(SQL_STD, f"""
SELECT site, ts, row_id, {rs(VALUES)} FROM std WHERE target >= 0"""))
def drop_bad_target(spark, sf_dir):
    return ops.drop_bad_target(std(spark, sf_dir))


@query("p02_drop_sparse_columns", with_(SQL_STD, f"SELECT site, ts, row_id, {rs(NO_RH)} FROM std"))
def drop_sparse_columns(spark, sf_dir):
    return ops.drop_sparse_columns(std(spark, sf_dir))


@query("p03_daytime", with_(SQL_STD, f"""
SELECT site, ts, row_id, {rs(VALUES)} FROM std WHERE irr_horiz > 5"""))
def daytime(spark, sf_dir):
    return ops.filter_daytime(std(spark, sf_dir))


@query("p03_daytime_fallback", with_(SQL_STD, """
SELECT row_id, irr_horiz AS irr_plane FROM std WHERE irr_horiz > 5"""))
def daytime_fallback(spark, sf_dir):
    return ops.filter_daytime(std(spark, sf_dir).select("row_id", F.col("irr_horiz").alias("irr_plane")))


def _filled(source: str) -> str:
    return f"SELECT site, ts, row_id, {', '.join(sql_fill(c, 'ts, row_id') for c in VALUES)} FROM {source}"


@query("p04_fill_gaps", with_(SQL_STD, f"""
SELECT site, ts, row_id, {rs(VALUES)} FROM ({_filled('std')}) WHERE target IS NOT NULL"""))
def fill_gaps(spark, sf_dir):
    return ops.fill_gaps(index_rows(std(spark, sf_dir))).drop("idx")


@query("p05_keep_numeric", with_(SQL_STD, f"SELECT site, row_id, {rs(VALUES)} FROM std"))
def keep_numeric(spark, sf_dir):
    rows = std(spark, sf_dir).withColumn("note", F.col("ts").cast("string"))
    return ops.keep_numeric(rows).drop("ts")


@query("p06_clean", with_(SQL_CLEAN, f"SELECT site, ts, {rs(KEPT)} FROM clean WHERE target IS NOT NULL"))
def clean_day(spark, sf_dir):
    return clean(spark, sf_dir)


SQL_GRID = SQL_BINS + """,
spans AS (SELECT site, min(ts) AS lo, max(ts) AS hi FROM bins GROUP BY site),
grid AS (SELECT site, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) AS ts FROM spans),
full_bins AS (SELECT grid.site, grid.ts, irr_horiz, amb_temp, wind_speed, pressure, target
  FROM grid LEFT JOIN bins USING (site, ts))"""


@query("p06_clean_with_nights", with_(SQL_GRID, f"""
SELECT site, ts, {rs(KEPT)} FROM (SELECT site, ts, {', '.join(sql_fill(c) for c in KEPT)} FROM full_bins)
WHERE target IS NOT NULL"""))
def clean_nights(spark, sf_dir):
    return ops.clean_grid(std(spark, sf_dir), filter_night=False)


_CLEAN_RAW = f"""good AS (SELECT * FROM std WHERE target >= 0 AND irr_horiz > 5)
SELECT site, ts, row_id, {rs(NO_RH)} FROM ({_filled('good')}) WHERE target IS NOT NULL"""


@query("p06_clean_raw_cadence", with_(SQL_STD + ",", _CLEAN_RAW))
def clean_raw(spark, sf_dir):
    from sunweave.plans.prepare import clean_indexed

    return clean_indexed(index_rows(std(spark, sf_dir)))[0].drop("idx")


@query("p07_feature_rows", with_(SQL_SPLIT, f"""
SELECT site, ts, idx, split, {rs([*MODEL_FEATURES, 'target'])} FROM parts
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*MODEL_FEATURES, 'target'])}""".replace(
    "round(CAST(month AS DOUBLE), 6) + 0.0 AS month", "month")))
def feature_rows(spark, sf_dir):
    return ops.feature_rows(parts(spark, sf_dir), MODEL_FEATURES)


_WANTED = ["irr_horiz", "rh", "irr_horiz", "irr_lag1", "target", "month", "target_lag4", "hour_sin"]


@query("p08_candidate_features", with_(SQL_SPLIT, """
SELECT 'irr_horiz' AS feature, count(irr_horiz) AS n FROM parts UNION ALL
SELECT 'month', count(month) FROM parts UNION ALL
SELECT 'target_lag4', count(target_lag4) FROM parts UNION ALL
SELECT 'hour_sin', count(hour_sin) FROM parts"""))
def candidate_features(spark, sf_dir):
    """Names that exist, with their number of known values."""
    rows = features(spark, sf_dir)
    names = ops.candidate_features(rows, _WANTED)
    return rows.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n")


@query("p09_date_slice", with_(SQL_STD, f"""
SELECT site, ts, row_id, {rs(VALUES)} FROM std
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'"""))
def date_slice(spark, sf_dir):
    return ops.date_slice(std(spark, sf_dir), "2024-01-08", "2024-01-21")


@query("p10_drop_null_subset", with_(SQL_STD, f"""
SELECT site, ts, row_id, {rs(VALUES)} FROM std WHERE irr_horiz IS NOT NULL AND target IS NOT NULL"""))
def drop_null_subset(spark, sf_dir):
    return std(spark, sf_dir).dropna("any", subset=["irr_horiz", "target"])


@query("p11_clamp", with_(SQL_PREDICTIONS, f"""
SELECT model, site, idx, round(CASE WHEN predicted - 3000 < 0 THEN 0 ELSE predicted - 3000 END, 6) + 0.0 AS predicted
FROM pred"""))
def clamp(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "model", "site", "idx", clamp_non_negative(F.col("predicted") - 3000).alias("predicted")
    )


SQL_LEVEL = """CASE WHEN {0} < 0 THEN NULL WHEN {0} <= 3000 THEN 'Low' WHEN {0} <= 10000 THEN 'Medium'
  WHEN {0} > 10000 THEN 'High' END"""


@query("p12_power_level", with_(SQL_STD, f"SELECT row_id, {SQL_LEVEL.format('target')} AS level FROM std"))
def levels(spark, sf_dir):
    return std(spark, sf_dir).select("row_id", power_level(F.col("target")).alias("level"))


@query("p13_stage_audit", with_(SQL_BINS, """
SELECT 'raw' AS stage, count(*) AS n_rows, count(*) FILTER (WHERE target IS NULL) AS null_target FROM std UNION ALL
SELECT 'good_target', count(*), count(*) FILTER (WHERE target IS NULL) FROM std WHERE target >= 0 UNION ALL
SELECT 'bins', count(*), count(*) FILTER (WHERE target IS NULL) FROM bins UNION ALL
SELECT 'day', count(*), count(*) FILTER (WHERE target IS NULL) FROM bins WHERE irr_horiz > 5"""))
def stage_audit(spark, sf_dir):
    """Four stages counted while one job runs through them."""
    rows, seen = std(spark, sf_dir), []

    def watch(df, name):
        df, obs = ops.observed(df, name, ["target"])
        seen.append((name, obs))
        return df

    rows = ops.drop_bad_target(watch(rows, "raw"))
    rows = resample_mean(watch(rows, "good_target"), complete=False)
    rows = watch(ops.filter_daytime(watch(rows, "bins")), "day")
    rows.write.format("noop").mode("overwrite").save()
    audit = [(n, o.get["n_rows"], o.get["null_target"]) for n, o in seen]
    return spark.createDataFrame(audit, "stage string, n_rows long, null_target long")


