"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunweave.catalog.base import (
    FEATURE_VALUES,
    KEPT,
    LATITUDE,
    RAW_VALUES,
    SITE_RAW,
    SQL_CLEAN,
    SQL_FEATURES,
    SQL_PREDICTIONS,
    SQL_RAW,
    SQL_SCORES,
    SQL_STD,
    SQL_TS,
    VALUES,
    _ok,
    clean,
    predictions,
    query,
    r,
    raw,
    rs,
    site_raw,
    std,
    with_,
    table,
)
from sunweave.functions import parse_day_hour
from sunweave.operators.cleaning import clean_bins
from sunweave.operators.evaluate import comparison_table, metrics
from sunweave.operators.features import engineer_features
from sunweave.session import staging_path
from sunweave.sources import (
    final_report,
    light_load,
    load_and_standardise,
    load_report,
    load_site_csv,
    parquet_or_build,
    refreshed,
    raw_head,
    raw_peek,
    read_result,
    report_lines,
    rename_to_standard,
    replace_sentinels,
    union_sites,
    write_csv_result,
    write_site_parquet,
)
from sunweave.sources.site_csv import prepare_raw

SITES = ("site_a", "site_b")


def _csv(spark, sf_dir, site):
    """The site's telemetry written as a raw logger file, row index first."""
    path = staging_path(spark, f"raw-{site}")
    rows = site_raw(spark, sf_dir, site)
    rows.withColumnRenamed("row_id", "_c0").write.option("header", True).csv(path)
    return path


_A = dict(zip(RAW_VALUES, SITE_RAW["site_a"]))


@query("s01_csv_site_scan", with_(SQL_RAW, f"""
SELECT 'site_a' AS site, {SQL_TS} AS ts, row_id,
  {', '.join(r(_ok(v), n) for v, n in _A.items())}
FROM raw WHERE site = 'site_a'"""))
def csv_site_scan(spark, sf_dir):
    rows = load_site_csv(spark, "site_a", _csv(spark, sf_dir, "site_a"))
    return rows.select("site", "ts", "row_id", *SITE_RAW["site_a"])


@query("s02_timestamp", with_(SQL_RAW, f"SELECT row_id, {SQL_TS} AS ts FROM raw"))
def timestamp(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "row_id", parse_day_hour(F.col("raw_day"), F.col("raw_hour")).alias("ts")
    )


@query("s03_sentinels", with_(SQL_RAW, f"""
SELECT row_id, {', '.join(r(_ok(v), v) for v in RAW_VALUES)} FROM raw"""))
def sentinels(spark, sf_dir):
    return raw(spark, sf_dir).select("row_id", *RAW_VALUES).transform(replace_sentinels)


# Every 11th day code is spoilt so that there are unparseable rows to drop.
@query("s04_drop_null_time", with_(SQL_RAW, f"""
SELECT site, {SQL_TS} AS ts, row_id FROM raw WHERE row_id % 11 <> 0"""))
def drop_null_time(spark, sf_dir):
    day = F.when(F.col("row_id") % 11 == 0, 2023366).otherwise(F.col("raw_day"))
    rows = raw(spark, sf_dir).withColumn("ts", parse_day_hour(day, F.col("raw_hour")))
    return rows.where(F.col("ts").isNotNull()).select("site", "ts", "row_id")


@query("s05_site_label", with_(SQL_RAW, """
SELECT row_id, 'site_b' AS site FROM raw WHERE site = 'site_b'"""))
def site_label(spark, sf_dir):
    return prepare_raw(site_raw(spark, sf_dir, "site_b"), "site_b").select("row_id", "site")


def _both(spark, sf_dir):
    return union_sites([
        rename_to_standard(prepare_raw(site_raw(spark, sf_dir, s), s), s) for s in SITES
    ])


SQL_STD_ROWS = with_(SQL_STD, f"SELECT site, ts, row_id, {rs(VALUES)} FROM std")


@query("s06_union_sites", SQL_STD_ROWS)
def site_union(spark, sf_dir):
    return _both(spark, sf_dir)


@query("s07_time_order", with_(SQL_STD, """
SELECT site, row_id, ts, row_number() OVER (PARTITION BY site ORDER BY ts, row_id) - 1 AS idx FROM std"""))
def time_order(spark, sf_dir):
    from sunweave.operators.ordered import index_rows

    return index_rows(std(spark, sf_dir).select("site", "ts", "row_id")).orderBy("site", "idx")


@query("s08_load_report", with_(SQL_STD, """
SELECT site, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM std GROUP BY site"""))
def report_of_load(spark, sf_dir):
    return load_report(std(spark, sf_dir))


@query("s11_standard_names", with_(SQL_STD, f"""
SELECT site, ts, row_id, {rs(VALUES)} FROM std WHERE site = 'site_b'"""))
def standard_names(spark, sf_dir):
    return rename_to_standard(prepare_raw(site_raw(spark, sf_dir, "site_b"), "site_b"), "site_b")


@query("s12_load_and_standardise", SQL_STD_ROWS)
def load_both(spark, sf_dir):
    return union_sites([load_and_standardise(spark, s, _csv(spark, sf_dir, s)) for s in SITES])


_B = dict(zip(RAW_VALUES, SITE_RAW["site_b"]))


@query("s13_light_load", with_(SQL_RAW, f"""
SELECT {SQL_TS} AS ts, row_id, {', '.join(r(_ok(v), n) for v, n in _B.items())}
FROM raw WHERE site = 'site_b' AND {_ok('pwr_raw')} >= 0"""))
def eda_load(spark, sf_dir):
    return light_load(site_raw(spark, sf_dir, "site_b"))



@query("s14_raw_peek", with_(SQL_RAW, f"""
SELECT "column", CAST(n_null AS BIGINT) AS n_null FROM (
  UNPIVOT (SELECT {', '.join(f'count(*) FILTER (WHERE {v} IS NULL) AS {v}' for v in RAW_VALUES)}
           FROM (SELECT * FROM raw ORDER BY row_id LIMIT 200))
  ON {', '.join(RAW_VALUES)} INTO NAME "column" VALUE n_null)"""))
def peek(spark, sf_dir):
    return raw_peek(raw(spark, sf_dir).select("row_id", *RAW_VALUES))


@query("s14_raw_head", with_(SQL_RAW, f"""
SELECT row_id, {rs(RAW_VALUES)}, {len(RAW_VALUES) + 1} AS n_columns FROM raw ORDER BY row_id LIMIT 5"""))
def head(spark, sf_dir):
    return raw_head(raw(spark, sf_dir).select("row_id", *RAW_VALUES))


@query("s15_parquet_sink", with_(SQL_CLEAN, f"SELECT site, ts, {rs(KEPT)} FROM clean"))
def parquet_sink(spark, sf_dir):
    path = staging_path(spark, "clean")
    write_site_parquet(clean(spark, sf_dir), path)
    return spark.read.parquet(path).select("site", "ts", *KEPT)


@query("s16_parquet_fast_path", with_(SQL_FEATURES, f"""
SELECT site, ts, idx, month, {rs(FEATURE_VALUES)} FROM feats"""))
def parquet_fast_path(spark, sf_dir):
    """First call builds and writes, second call reads."""
    path = staging_path(spark, "fast")

    def build():
        rows, bounded = clean_bins(_both(spark, sf_dir))
        return engineer_features(rows, LATITUDE, bounded=bounded)

    write_site_parquet(parquet_or_build(spark, path, build), path)
    return parquet_or_build(spark, path, build).select("site", "ts", "idx", "month", *FEATURE_VALUES)


@query("s17_csv_sinks", with_(SQL_PREDICTIONS, f"""
SELECT model, site, idx, ts, {rs(['actual', 'predicted'])} FROM pred"""))
def csv_sinks(spark, sf_dir):
    path = staging_path(spark, "predictions")
    rows = predictions(spark, sf_dir)
    write_csv_result(rows, path)
    return read_result(spark, path, rows.schema)


SCORE_COLUMNS = "rmse, mae, mape, r2, pearson_r, nrmse_pct"


@query("s18_reload_metrics", with_(SQL_SCORES, f"SELECT model AS label, {SCORE_COLUMNS} FROM scores"), digits=4)
def reload_metrics(spark, sf_dir):
    path = staging_path(spark, "metrics")
    table = comparison_table(metrics(predictions(spark, sf_dir)))
    write_csv_result(table, path)
    return read_result(spark, path, table.schema)


@query("s19_final_report", with_(SQL_SCORES, """
SELECT row_number() OVER (ORDER BY rmse, model) AS place, model AS label,
  row_number() OVER (ORDER BY rmse, model) = 1 AS winner,
  printf('%.2f', rmse) AS rmse_w, printf('%.4f', r2) AS r2_text, printf('%.2f', mape) AS mape_pct
FROM scores"""))
def closing_report(spark, sf_dir):
    return final_report(comparison_table(metrics(predictions(spark, sf_dir))))


@query("s19_report_lines", with_(SQL_SCORES, """
SELECT printf('%d. %s%s: RMSE %.2f W, R2 %.4f, MAPE %.2f %%', row_number() OVER (ORDER BY rmse, model), model,
  CASE WHEN row_number() OVER (ORDER BY rmse, model) = 1 THEN ' (winner)' ELSE '' END, rmse, r2, mape) AS value
FROM scores"""))
def text_report(spark, sf_dir):
    """Written as text and read back."""
    path = staging_path(spark, "report")
    report_lines(comparison_table(metrics(predictions(spark, sf_dir)))).write.text(path)
    return spark.read.text(path)


@query("s16_refresh_changed", """
SELECT 3 AS read_first, 1 AS read_second, 0 AS read_third, count(*) AS n_rows, sum(CASE WHEN event_id % 3 = 1 THEN -user_id ELSE user_id END)::BIGINT AS total
FROM events WHERE NOT (event_id % 3 = 1 AND event_id % 2 = 0)""")
def refresh_changed(spark, sf_dir):
    """Three files of events, one of them written anew with other rows: only that one is read again."""
    source, kept = staging_path(spark, "feed"), staging_path(spark, "table")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).coalesce(1).write.option("header", True).csv(f"{source}/part{part}")
    build = lambda files: spark.read.option("header", True).schema("event_id long, user_id long").csv(files)
    first = refreshed(spark, source, kept, build)[1]
    rows.where("event_id % 3 = 1 and event_id % 2 <> 0").withColumn("user_id", -F.col("user_id")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{source}/part1")
    second = refreshed(spark, source, kept, build)[1]
    out, third = refreshed(spark, source, kept, build)
    sizes = [F.lit(len(x)).alias(n) for n, x in (("read_first", first), ("read_second", second), ("read_third", third))]
    return out.agg(F.count("*").alias("n_rows"), F.sum("user_id").alias("total")).select(*sizes, "n_rows", "total")
