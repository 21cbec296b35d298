"""Scalers and the full preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunweave.catalog.base import LATITUDE, MODEL_FEATURES, SQL_SPLIT, parts, query, r, rs, std, table, with_
from sunweave.operators import scaling as ops
from sunweave.operators.cleaning import feature_rows
from sunweave.plans.prepare import prepare
from sunweave.session import stage, staging_path

MONEY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in [*MODEL_FEATURES, "target"])

SQL_ROWS = SQL_SPLIT + f""",
usable AS (SELECT * REPLACE (CAST(month AS DOUBLE) AS month) FROM parts WHERE {_KNOWN})"""


def _stats(names) -> str:
    return ", ".join(
        f"avg({c}) FILTER (WHERE split = 'train') AS {c}_m, "
        f"coalesce(nullif(stddev_pop({c}) FILTER (WHERE split = 'train'), 0), 1) AS {c}_s"
        for c in names
    )


SQL_SCALED = SQL_ROWS + f""",
stat AS (SELECT {_stats(MODEL_FEATURES)}, min(target) FILTER (WHERE split = 'train') AS y_lo,
  max(target) FILTER (WHERE split = 'train') AS y_hi FROM usable),
scaled AS (SELECT site, ts, idx, split, target, (target - y_lo) / (y_hi - y_lo) AS target_scaled,
  {', '.join(f'({c} - {c}_m) / {c}_s AS {c}' for c in MODEL_FEATURES)} FROM usable JOIN stat ON true)"""


def usable_rows(spark, sf_dir):
    return feature_rows(parts(spark, sf_dir), MODEL_FEATURES)


def scaled_rows(spark, sf_dir):
    """Split rows with features scaled by the training part; the split is written once."""
    rows = stage(usable_rows(spark, sf_dir), "split")
    scaler = ops.fit_scaler(rows.where("split = 'train'"), MODEL_FEATURES)
    return ops.apply_scaler(rows, scaler), rows


def _param_sql(source: str, names, digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r(f'avg({c})', 'mean', digits)},
  {r(f'coalesce(nullif(stddev_pop({c}), 0), 1)', 'scale', digits)}, {r(f'min({c})', 'min', digits)}, {r(f'max({c})', 'max', digits)} FROM {source}"""
        for c in names
    )


@query("f01_fit_scaler", with_(SQL_ROWS + ", train AS (SELECT * FROM usable WHERE split = 'train')",
                               _param_sql("train", MODEL_FEATURES, 6)))
def fit_scaler(spark, sf_dir):
    return ops.scaler_statistics(usable_rows(spark, sf_dir).where("split = 'train'"), MODEL_FEATURES)


@query("f01_fit_scaler_lineitem", _param_sql("lineitem", MONEY, 4), digits=4)
def fit_scaler_lineitem(spark, sf_dir):
    return ops.scaler_statistics(table(spark, sf_dir, "lineitem"), MONEY)


@query("f02_apply_scaler", with_(SQL_SCALED, f"SELECT site, ts, idx, split, {rs(MODEL_FEATURES)} FROM scaled"))
def apply_scaler(spark, sf_dir):
    rows, _ = scaled_rows(spark, sf_dir)
    return rows.select("site", "ts", "idx", "split", *MODEL_FEATURES)


@query("f02_apply_minmax", f"""
WITH stat AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in MONEY)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(r(f'({c} - {c}_lo) / ({c}_hi - {c}_lo)', c) for c in MONEY)}
FROM lineitem JOIN stat ON true""")
def apply_minmax(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return ops.apply_scaler(rows, ops.fit_scaler(rows, MONEY, "minmax")).select("l_orderkey", "l_linenumber", *MONEY)


@query("f03_fit_target_scaler", with_(SQL_ROWS, f"""
SELECT {r('min(target)', 'target_min')}, {r('max(target)', 'target_max')} FROM usable WHERE split = 'train'"""))
def fit_target_scaler(spark, sf_dir):
    rows = usable_rows(spark, sf_dir).where("split = 'train'")
    return ops.scaler_statistics(rows, ["target"]).select(
        F.col("min").alias("target_min"), F.col("max").alias("target_max")
    )


@query("f04_scale_target", with_(SQL_SCALED, f"""
SELECT site, ts, split, {r('target_scaled', 'target_scaled')}, {r('target', 'restored')} FROM scaled"""))
def scale_target(spark, sf_dir):
    """Scaled target and the watts it converts back to."""
    rows = stage(usable_rows(spark, sf_dir), "split")
    scaler = ops.fit_target_scaler(rows.where("split = 'train'"))
    out = ops.scale_target(rows, scaler).withColumn("restored", F.col("target_scaled"))
    return ops.inverse_scale(out, scaler, "restored").select("site", "ts", "split", "target_scaled", "restored")


@query("f05_scaler_roundtrip", with_(SQL_SCALED, f"SELECT site, ts, {rs(MODEL_FEATURES)} FROM scaled WHERE split = 'test'"))
def scaler_roundtrip(spark, sf_dir):
    """Test rows scaled by a scaler that was saved and loaded."""
    rows = stage(usable_rows(spark, sf_dir), "split")
    path = staging_path(spark, "scaler")
    ops.fit_scaler(rows.where("split = 'train'"), MODEL_FEATURES).save(spark, path)
    loaded = ops.load_scaler(spark, path, MODEL_FEATURES)
    return ops.apply_scaler(rows.where("split = 'test'"), loaded).select("site", "ts", *MODEL_FEATURES)


@query("f06_full_preprocessing", with_(SQL_SCALED, f"""
SELECT site, split, count(*) AS n_rows, {r('avg(target)', 'target_mean')}, {r('avg(target_scaled)', 'target_scaled_mean')},
  {r('avg(irr_horiz)', 'irr_scaled_mean')}, {r('avg(target_lag1)', 'lag_scaled_mean')}, min(ts) AS first_ts, max(ts) AS last_ts
FROM scaled GROUP BY site, split"""))
def full_preprocessing(spark, sf_dir):
    """The prepared bundle of the resample-first preset, summarised per split."""
    bundle = prepare(std(spark, sf_dir), latitude=LATITUDE)
    return bundle.rows.groupBy("site", "split").agg(
        F.count("*").alias("n_rows"), F.avg("target").alias("target_mean"),
        F.avg("target_scaled").alias("target_scaled_mean"), F.avg("irr_horiz").alias("irr_scaled_mean"),
        F.avg("target_lag1").alias("lag_scaled_mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
