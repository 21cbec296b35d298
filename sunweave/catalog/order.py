"""Positions, look-backs, splits, joins by position and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.catalog.base import (
    CYCLES,
    FEATURE_VALUES,
    LAGGED,
    LATITUDE,
    ROLLED,
    SQL_FEATURES,
    SQL_METRICS,
    SQL_PREDICTIONS,
    SQL_SCORES,
    SQL_SPLIT,
    SQL_STD,
    SQL_TIME,
    VALUES,
    features,
    parts,
    predictions,
    query,
    rs,
    sql_clearness,
    sql_lags,
    sql_rolls,
    std,
    with_,
)
from sunweave.catalog.scaling import SQL_ROWS, usable_rows
from sunweave.operators import evaluate
from sunweave.operators import features as feats
from sunweave.operators.ordered import index_rows, laid_out, position_slice, reindex_rows
from sunweave.operators.sequences import build_sequences

RAW_ORDER = "ts, row_id"


def indexed(spark, sf_dir):
    return index_rows(std(spark, sf_dir))


SQL_INDEXED = SQL_STD + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, row_id) - 1 AS idx FROM std)"""


@query("d01_row_index", with_(SQL_INDEXED, "SELECT site, ts, row_id, idx FROM pos"))
def row_index(spark, sf_dir):
    return indexed(spark, sf_dir).select("site", "ts", "row_id", "idx")


@query("d01_row_index_after_drop", with_(SQL_STD, """
SELECT site, row_id, row_number() OVER (PARTITION BY site ORDER BY ts, row_id) - 1 AS idx FROM std WHERE target >= 0"""))
def row_index_after_drop(spark, sf_dir):
    return reindex_rows(indexed(spark, sf_dir).where("target >= 0")).select("site", "row_id", "idx")


@query("d02_lags", with_(SQL_STD, f"""
SELECT row_id, {rs(LAGGED)} FROM (SELECT row_id, {sql_lags(['irr_horiz', 'target'], order=RAW_ORDER)} FROM std)"""))
def lags(spark, sf_dir):
    rows = indexed(spark, sf_dir).select("site", "idx", "row_id", "irr_horiz", "target")
    return feats.add_lag_features(rows, ["irr_horiz", "target", "absent"]).select("row_id", *LAGGED)


@query("d03_rolling", with_(SQL_STD, f"""
SELECT row_id, {rs(ROLLED)} FROM (SELECT row_id, {sql_rolls('irr_horiz', order=RAW_ORDER)} FROM std)"""))
def rolling(spark, sf_dir):
    """Rolling mean (D03) and deviation (D04) at raw cadence."""
    rows = indexed(spark, sf_dir).select("site", "idx", "row_id", "irr_horiz")
    return feats.add_rolling_features(rows, ["irr_horiz"]).select("row_id", *ROLLED)


@query("d04_rolling_grid", with_(SQL_FEATURES, f"SELECT site, ts, {rs(ROLLED)} FROM feats"))
def rolling_grid(spark, sf_dir):
    return features(spark, sf_dir).select("site", "ts", *ROLLED)


@query("d05_drop_warm_up", with_(SQL_INDEXED, "SELECT site, row_id, idx - 8 AS idx FROM pos WHERE idx >= 8"))
def drop_warm_up(spark, sf_dir):
    return feats.drop_warm_up(indexed(spark, sf_dir), 8).select("site", "row_id", "idx")


@query("d06_features", with_(SQL_FEATURES, f"SELECT site, ts, idx, month, {rs(FEATURE_VALUES)} FROM feats"))
def feature_engineering(spark, sf_dir):
    return features(spark, sf_dir).select("site", "ts", "idx", "month", *FEATURE_VALUES)


@query("d06_features_raw_cadence", with_(SQL_INDEXED + f""",
f AS (SELECT *, {SQL_TIME}, {sql_clearness()} AS clearness_index,
  {sql_lags(['irr_horiz', 'target'], order=RAW_ORDER)}, {sql_rolls('irr_horiz', order=RAW_ORDER)} FROM pos)""", f"""
SELECT site, ts, row_id, idx - 8 AS idx, month, {rs([*VALUES, *CYCLES, 'clearness_index', *LAGGED, *ROLLED])}
FROM f WHERE idx >= 8"""))
def feature_engineering_raw(spark, sf_dir):
    return feats.engineer_features(indexed(spark, sf_dir), LATITUDE)


_SEQ = ["irr_horiz", "amb_temp", "wind_speed", "pressure", "target_lag1"]
SQL_SEQUENCES = SQL_ROWS + f""",
placed AS (SELECT site, split, ts, target, {', '.join(_SEQ)},
    row_number() OVER (PARTITION BY site, split ORDER BY ts) - 1 AS pos FROM usable),
seqs AS (SELECT site, split, pos, ts, target AS y, count(*) OVER h AS n_steps,
    first_value(irr_horiz) OVER h AS oldest_irr, last_value(irr_horiz) OVER h AS newest_irr,
    last_value(target_lag1) OVER h AS newest_lag
  FROM placed WINDOW h AS (PARTITION BY site, split ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))"""


@query("d07_sequences", with_(SQL_SEQUENCES, f"""
SELECT site, split, pos, ts, n_steps, 5 AS n_features, {rs(['y', 'oldest_irr', 'newest_irr', 'newest_lag'])}
FROM seqs WHERE pos >= 16"""))
def sequences(spark, sf_dir):
    rows, bounded = laid_out(usable_rows(spark, sf_dir), ("site", "split"), name="pos")
    seqs = build_sequences(rows, _SEQ, "target", bounded=bounded)
    last = F.element_at("seq", -1)
    return seqs.select(
        "site", "split", "pos", "ts", F.size("seq").alias("n_steps"), F.size(last).alias("n_features"), "y",
        F.col("seq")[0][0].alias("oldest_irr"), last[0].alias("newest_irr"), last[4].alias("newest_lag"),
    )


@query("d07_sequences_raw_cadence", with_(SQL_INDEXED + """,
s AS (SELECT site, idx, ts, wind_speed AS y, count(*) OVER h AS n_steps, first_value(pressure) OVER h AS oldest,
    last_value(wind_speed) OVER h AS newest
  FROM pos WINDOW h AS (PARTITION BY site ORDER BY ts, row_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))""", f"""
SELECT site, idx, ts, n_steps, {rs(['y', 'oldest', 'newest'])} FROM s WHERE idx >= 16"""))
def sequences_raw(spark, sf_dir):
    rows = indexed(spark, sf_dir).select("site", "ts", "idx", "pressure", "wind_speed")
    seqs = build_sequences(rows, ["pressure", "wind_speed"], "wind_speed", series=("site",), idx="idx")
    return seqs.select(
        "site", "idx", "ts", F.size("seq").alias("n_steps"), "y", F.col("seq")[0][0].alias("oldest"),
        F.element_at("seq", -1)[1].alias("newest"),
    )


@query("d08_split", with_(SQL_SPLIT, "SELECT site, ts, idx, split FROM parts"))
def split(spark, sf_dir):
    return parts(spark, sf_dir).select("site", "ts", "idx", "split")


@query("d08_split_raw_cadence", with_(SQL_INDEXED + """,
z AS (SELECT site, row_id, idx, count(*) OVER (PARTITION BY site) AS n FROM pos)""", """
SELECT site, row_id, CASE WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM z"""))
def split_raw(spark, sf_dir):
    from sunweave.operators.split import split_chronological

    return split_chronological(indexed(spark, sf_dir)).select("site", "row_id", "split")


@query("d09_position_slice", with_(SQL_PREDICTIONS, f"""
SELECT model, site, idx, {rs(['actual', 'predicted'])} FROM pred WHERE idx >= 100 AND idx < 200"""))
def prefix(spark, sf_dir):
    return position_slice(predictions(spark, sf_dir), 100, 200).select("model", "site", "idx", "actual", "predicted")


@query("d10_tail_alignment", with_(SQL_SEQUENCES, f"""
SELECT site, pos, {rs(['y'])} FROM seqs WHERE split = 'test' AND pos >= 16"""))
def tail_alignment(spark, sf_dir):
    """Truth of every test window: the last (n - 16) rows, carried along instead of re-aligned."""
    rows, bounded = laid_out(usable_rows(spark, sf_dir), ("site", "split"), name="pos")
    seqs = build_sequences(rows.where("split = 'test'"), ["target"], "target", bounded=bounded)
    return seqs.select("site", "pos", "y")


_M = ["persistence_1", "persistence_4", "persistence_8"]


@query("d11_attach_predictions", with_(SQL_PREDICTIONS, f"""
SELECT site, idx, {rs(['actual'])}, {', '.join(
    f"round(max(predicted) FILTER (WHERE model = '{m}'), 6) + 0.0 AS {m}_pred, "
    f"round(max(abs(actual - predicted)) FILTER (WHERE model = '{m}'), 6) + 0.0 AS {m}_err" for m in _M)}
FROM pred GROUP BY site, idx, actual"""))
def attach_predictions(spark, sf_dir):
    return evaluate.prediction_errors(predictions(spark, sf_dir))


@query("d12_top_models", with_(SQL_SCORES, "SELECT model, rmse FROM scores ORDER BY rmse, model LIMIT 2"), digits=4)
def top_models(spark, sf_dir):
    return evaluate.top_models(evaluate.metrics(predictions(spark, sf_dir)), 2).select("model", "rmse")


@query("d13_rank", with_(SQL_SCORES, """
SELECT model AS label, rmse, row_number() OVER (ORDER BY rmse, model) AS place FROM scores"""), digits=4)
def rank(spark, sf_dir):
    return evaluate.ranked_comparison(evaluate.metrics(predictions(spark, sf_dir))).select("label", "rmse", "place")


@query("d14_concat_results", with_(SQL_PREDICTIONS + f""",
own AS (SELECT model || '@' || site AS label, {SQL_METRICS} FROM pred GROUP BY model, site),
pooled AS (SELECT model AS label, {SQL_METRICS} FROM pred GROUP BY model)""", """
SELECT * FROM own UNION ALL SELECT * FROM pooled"""), digits=4)
def concat_results(spark, sf_dir):
    """Per-site and pooled results stacked and sorted by RMSE."""
    rows = predictions(spark, sf_dir)
    own: DataFrame = evaluate.metrics(rows, [F.concat_ws("@", "model", "site").alias("label")])
    pooled = evaluate.metrics(rows, [F.col("model").alias("label")])
    return own.unionByName(pooled).orderBy("rmse", "label")


