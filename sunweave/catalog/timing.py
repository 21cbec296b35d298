"""Time and solar-geometry features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunweave.catalog.base import (
    CYCLES,
    LATITUDE,
    SQL_STD,
    SQL_TIME,
    query,
    r,
    rs,
    sql_clear_sky,
    sql_clearness,
    std,
    table,
    with_,
)
from sunweave.functions import clear_sky_irradiance, season
from sunweave.operators.features import add_clearness_index, add_time_features

TIMED = with_(SQL_STD + f", timed AS (SELECT row_id, {SQL_TIME} FROM std)", "{}")


def _timed(spark, sf_dir):
    return add_time_features(std(spark, sf_dir))


@query("t01_hour_cycle", TIMED.format(f"SELECT row_id, {rs(CYCLES[:2])} FROM timed"))
def hour_cycle(spark, sf_dir):
    return _timed(spark, sf_dir).select("row_id", *CYCLES[:2])


@query("t02_year_cycle", f"""
SELECT o_orderkey, {r('sin(dayofyear(o_orderdate) * 2 * pi() / 365.0)', 'doy_sin')},
  {r('cos(dayofyear(o_orderdate) * 2 * pi() / 365.0)', 'doy_cos')} FROM orders""")
def year_cycle(spark, sf_dir):
    """Over seven years of order dates, leap days included."""
    rows = table(spark, sf_dir, "orders")
    return add_time_features(rows, "o_orderdate").select("o_orderkey", "doy_sin", "doy_cos")


@query("t03_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month FROM orders")
def month(spark, sf_dir):
    return add_time_features(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "month")


@query("t04_time_features", TIMED.format(f"SELECT row_id, month, {rs(CYCLES)} FROM timed"))
def time_features(spark, sf_dir):
    return _timed(spark, sf_dir).select("row_id", "month", *CYCLES)


@query("t05_clear_sky", with_(SQL_STD, f"SELECT row_id, {r(sql_clear_sky(), 'clear_sky')} FROM std"))
def clear_sky(spark, sf_dir):
    return std(spark, sf_dir).select("row_id", clear_sky_irradiance(F.col("ts"), LATITUDE).alias("clear_sky"))


@query("t06_clearness_index", with_(SQL_STD, f"SELECT row_id, {r(sql_clearness(), 'clearness_index')} FROM std"))
def clearness(spark, sf_dir):
    return add_clearness_index(std(spark, sf_dir), LATITUDE).select("row_id", "clearness_index")


@query("t06_clearness_supplied", with_(SQL_STD, f"""
SELECT row_id, {r(sql_clearness(sky='(pressure - 500)'), 'clearness_index')} FROM std"""))
def clearness_supplied(spark, sf_dir):
    rows = std(spark, sf_dir).withColumn("sky", F.col("pressure") - 500)
    return add_clearness_index(rows, clearsky_col="sky").select("row_id", "clearness_index")


@query("t07_calendar_labels", """
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, strftime(o_orderdate, '%b') AS month_abbr,
  strftime(o_orderdate, '%B') AS month_name, count(*) AS n
FROM orders GROUP BY ALL""")
def calendar_labels(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(
        F.year(at).alias("year"), F.month(at).alias("month"), F.date_format(at, "MMM").alias("month_abbr"),
        F.date_format(at, "MMMM").alias("month_name"),
    ).agg(F.count("*").alias("n")).orderBy("year", "month")


SQL_SEASON = """CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) IN (3, 4, 5) THEN 'Spring'
  WHEN month({0}) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"""


@query("t08_season", f"""
SELECT {SQL_SEASON.format('o_orderdate')} AS season, count(*) AS n, {r('sum(o_totalprice)', 'total', 2)}
FROM orders GROUP BY 1""", digits=2)
def seasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(season(F.col("o_orderdate")).alias("season")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    )
