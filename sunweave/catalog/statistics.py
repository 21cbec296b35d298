"""Resampling and exploratory statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.catalog.base import (
    KEPT,
    MODEL_FEATURES,
    ORACLES,
    RAW_VALUES,
    SQL_CLEAN,
    SQL_RAW,
    SQL_SPLIT,
    SQL_STD,
    VALUES,
    clean,
    parts,
    query,
    r,
    raw,
    rs,
    std,
    table,
    with_,
)
from sunweave.catalog.cleaning import SQL_GRID
from sunweave.catalog.scaling import SQL_SCALED, scaled_rows
from sunweave.operators import eda, rollup
from sunweave.operators.cleaning import drop_bad_target, drop_sparse_columns
from sunweave.operators.quantiles import RANK_BOUND, quantile_sketches, sketched_quantiles
from sunweave.operators.resample import resample
from sunweave.plans.report import statistical_summary
from sunweave.session import small_side, stage

MONEY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("c01_resample_15min", with_(SQL_GRID, f"SELECT site, ts, {rs(KEPT)} FROM full_bins"))
def resample_15min(spark, sf_dir):
    rows = std(spark, sf_dir).transform(drop_bad_target).transform(drop_sparse_columns)
    return resample(rows)


def _rule(unit: str, step: str, agg: str, source: str, time: str, value: str, series: str) -> str:
    digits = 3 if agg == "sum" else 6
    fill = "coalesce(v, 0)" if agg == "sum" else "v"
    return f"""WITH b AS (SELECT {series} AS series, CAST(date_trunc('{unit}', {time}) AS TIMESTAMP) AS ts, {agg}({value}) AS v
  FROM {source} GROUP BY 1, 2),
g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL '{step}')) AS ts FROM b GROUP BY series)
SELECT series, ts, round({fill}, {digits}) + 0.0 AS v FROM g LEFT JOIN b USING (series, ts)"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("v"),
    )


@query("c02_hourly_mean", with_(SQL_STD + """,
b AS (SELECT site, date_trunc('hour', ts) AS ts, avg(irr_horiz) AS irr_horiz, avg(target) AS target FROM std GROUP BY 1, 2),
g AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM b GROUP BY site)""",
    f"SELECT site, ts, {rs(['irr_horiz', 'target'])} FROM g LEFT JOIN b USING (site, ts)"))
def hourly_mean(spark, sf_dir):
    return resample(std(spark, sf_dir), "1 hour", "avg", ["irr_horiz", "target"])


@query("c02_daily_mean", _rule("day", "1 day", "avg", "orders", "o_orderdate", "o_totalprice", "o_orderpriority"))
def daily_mean(spark, sf_dir):
    return resample(_orders(spark, sf_dir), "day", "avg", ["v"], ["series"])


@query("c02_daily_sum", _rule("day", "1 day", "sum", "orders", "o_orderdate", "o_totalprice", "o_orderpriority"), digits=3)
def daily_sum(spark, sf_dir):
    return resample(_orders(spark, sf_dir), "day", "sum", ["v"], ["series"])


@query("c02_yearly_sum", _rule("year", "1 year", "sum", "orders", "o_orderdate", "o_totalprice", "o_orderpriority"), digits=3)
def yearly_sum(spark, sf_dir):
    return resample(_orders(spark, sf_dir), "year", "sum", ["v"], ["series"])


@query("c03_hour_profile", with_(SQL_STD, f"""
SELECT site, hour(ts) AS hour, {r('avg(target)', 'mean')}, {r('stddev_samp(target)', 'std')},
  {r('avg(target) - stddev_samp(target)', 'lower')}, {r('avg(target) + stddev_samp(target)', 'upper')}
FROM std GROUP BY site, hour(ts)"""))
def hour_profile(spark, sf_dir):
    return eda.hour_profile(std(spark, sf_dir), "target")


DAY_PROFILE_SQL = with_(SQL_CLEAN, f"""
SELECT hour(ts) AS hour, count(*) AS n_bins, {r('avg(target)', 'mean')}, {r('stddev_samp(target)', 'std')},
  {r('avg(irr_horiz)', 'irr_mean')}
FROM clean GROUP BY hour(ts)""")


@query("daytime_power_profile", DAY_PROFILE_SQL)
def daytime_power_profile(spark, sf_dir):
    """15-minute daytime power by hour of day: the flagship chain end to end."""
    return clean(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n_bins"), F.avg("target").alias("mean"), F.stddev_samp("target").alias("std"),
        F.avg("irr_horiz").alias("irr_mean"),
    )


@query("c04_null_report", with_(SQL_STD, f"""
SELECT "column", round(null_pct, 6) AS null_pct FROM (
  UNPIVOT (SELECT {', '.join(f'avg(CAST({c} IS NULL AS INT)) * 100 AS {c}' for c in VALUES)} FROM std)
  ON {', '.join(VALUES)} INTO NAME "column" VALUE null_pct) WHERE null_pct > 0"""))
def null_report(spark, sf_dir):
    return eda.null_report(std(spark, sf_dir), VALUES)


_HITS = " UNION ALL ".join(
    f"SELECT CAST({s} AS DOUBLE) AS sentinel, CAST({' + '.join(f'count(*) FILTER (WHERE {v} = {s})' for v in RAW_VALUES)} AS BIGINT) AS n FROM raw"
    for s in ("32767.0", "32766.0", "-99.0")
)


@query("c05_sentinel_counts", with_(SQL_RAW, _HITS))
def sentinel_counts(spark, sf_dir):
    return eda.sentinel_counts(raw(spark, sf_dir), RAW_VALUES)


def _describe_sql(source: str, columns, digits: int = 4) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 'mean', digits)},
  {r(f'stddev_samp({c})', 'std', digits)}, {r(f'min({c})', 'min', digits)}, {r(f'quantile_cont({c}, 0.25)', 'p25', digits)},
  {r(f'quantile_cont({c}, 0.5)', 'p50', digits)}, {r(f'quantile_cont({c}, 0.75)', 'p75', digits)}, {r(f'max({c})', 'max', digits)}
  FROM {source}"""
        for c in columns
    )


@query("c06_describe_telemetry", with_(SQL_STD, _describe_sql("std", VALUES)), digits=4)
def describe_telemetry(spark, sf_dir):
    return eda.describe(std(spark, sf_dir), VALUES)


@query("c06_describe_lineitem", _describe_sql("lineitem", MONEY), digits=4)
def describe_lineitem(spark, sf_dir):
    return eda.describe(table(spark, sf_dir, "lineitem"), MONEY)


@query("c06_statistical_summary", with_(SQL_STD, " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min,
  round(max({c}), 3) AS max, round(quantile_cont({c}, 0.5), 3) AS median FROM std WHERE target >= 0""" for c in VALUES)), digits=3)
def summary_table(spark, sf_dir):
    return statistical_summary(drop_bad_target(std(spark, sf_dir)), VALUES)


@query("c07_target_report", with_(SQL_STD, f"""
SELECT site, count(*) AS n_rows, count(*) FILTER (WHERE target = 0) AS n_zero,
  count(*) FILTER (WHERE target < 0) AS n_negative, count(*) FILTER (WHERE target IS NULL) AS n_null,
  {r('avg(target)', 'mean')}, {r('max(target)', 'max')}, {r('avg(CAST(target IS NULL AS INT)) * 100', 'missing_pct')}
FROM std GROUP BY site"""))
def target_report(spark, sf_dir):
    return eda.target_report(std(spark, sf_dir))


def _corr_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})', 'r')} FROM {source}"
        for i, a in enumerate(columns) for b in columns[:i]
    )


@query("c08_correlations", with_(SQL_STD, _corr_sql("std", VALUES)))
def correlations(spark, sf_dir):
    return eda.correlations(std(spark, sf_dir), VALUES)


@query("c08_correlations_lineitem", _corr_sql("lineitem", MONEY))
def correlations_lineitem(spark, sf_dir):
    return eda.correlations(table(spark, sf_dir, "lineitem"), MONEY)


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in VALUES)


@query("c09_correlations_listwise", with_(
    SQL_STD + f", complete AS (SELECT * FROM std WHERE {_COMPLETE})", _corr_sql("complete", VALUES)))
def correlations_listwise(spark, sf_dir):
    return eda.correlations_listwise(std(spark, sf_dir), VALUES)


@query("c10_target_correlations", with_(SQL_STD, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r(f'corr({c}, target)', 'r')} FROM std""" for c in VALUES if c != "target")))
def target_correlations(spark, sf_dir):
    return eda.target_correlations(std(spark, sf_dir), VALUES)


def sql_histogram(source: str, column: str, bins: int, by: str = "") -> str:
    """Equal-width bins over [min, max], empty bins kept; ``by`` is an optional group column."""
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    match = f"e.{by} = c.{by} AND " if by else ""
    lead = f"e.{by}, " if by else ""
    return f"""edge AS (SELECT {head}min({column}) AS lo, max({column}) AS hi FROM {source} {group}),
e AS (SELECT {head}lo, hi, unnest(range(1, {bins} + 1)) AS bin FROM edge),
c AS (SELECT {'s.' + by + ', ' if by else ''}least(CAST(floor({bins}.0::DOUBLE * (s.{column} - lo) / (hi - lo)) AS BIGINT) + 1, {bins}) AS bin,
    count(*) AS n
  FROM {source} s JOIN edge ON {f's.{by} = edge.{by}' if by else 'true'} WHERE s.{column} IS NOT NULL GROUP BY ALL)
SELECT {lead}e.bin, {r(f'lo + (hi - lo) / {bins} * (e.bin - 1)', 'bin_from', 4)},
  {r(f'lo + (hi - lo) / {bins} * e.bin', 'bin_to', 4)}, coalesce(n, 0) AS n
FROM e LEFT JOIN c ON {match}e.bin = c.bin"""


@query("c11_histogram_price", "WITH " + sql_histogram("lineitem", "l_extendedprice", 60), digits=4)
def histogram_price(spark, sf_dir):
    return eda.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 60)


@query("c11_histogram_target", with_(SQL_STD + ",", sql_histogram("std", "target", 60, "site")), digits=4)
def histogram_target(spark, sf_dir):
    return eda.histogram(std(spark, sf_dir), "target", 60, ["site"])


@query("c12_monthly_box", f"""
WITH q AS (SELECT month(o_orderdate) AS month, quantile_cont(o_totalprice, 0.25) AS q1,
    quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
  FROM orders GROUP BY 1),
s AS (SELECT q.*, o_totalprice AS v, o_totalprice BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
  FROM orders JOIN q ON q.month = month(o_orderdate))
SELECT month, count(*) AS n, {r('any_value(q1)', 'q1', 4)}, {r('any_value(median)', 'median', 4)}, {r('any_value(q3)', 'q3', 4)},
  {r('min(v) FILTER (WHERE inside)', 'whisker_low', 4)}, {r('max(v) FILTER (WHERE inside)', 'whisker_high', 4)},
  count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM s GROUP BY month""", digits=4)
def monthly_box(spark, sf_dir):
    return eda.monthly_box(_orders(spark, sf_dir), "v")


@query("c12_monthly_box_irradiance", with_(SQL_STD + """,
q AS (SELECT month(ts) AS month, quantile_cont(irr_horiz, 0.25) AS q1,
    quantile_cont(irr_horiz, 0.5) AS median, quantile_cont(irr_horiz, 0.75) AS q3
  FROM std WHERE irr_horiz > 5 GROUP BY 1),
s AS (SELECT q.*, irr_horiz AS v, irr_horiz BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
  FROM std JOIN q ON q.month = month(ts) WHERE irr_horiz > 5)""", f"""
SELECT month, count(*) AS n, {r('any_value(q1)', 'q1', 4)}, {r('any_value(median)', 'median', 4)}, {r('any_value(q3)', 'q3', 4)},
  {r('min(v) FILTER (WHERE inside)', 'whisker_low', 4)}, {r('max(v) FILTER (WHERE inside)', 'whisker_high', 4)},
  count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM s GROUP BY month"""), digits=4)
def monthly_box_irradiance(spark, sf_dir):
    return eda.monthly_box(std(spark, sf_dir).where("irr_horiz > 5"))


@query("c13_best_day", with_(SQL_STD + """,
b AS (SELECT site, time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(irr_horiz) AS irr_horiz FROM std GROUP BY 1, 2),
g AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM b GROUP BY site),
full_b AS (SELECT site, ts, CAST(ts AS DATE) AS day, irr_horiz FROM g LEFT JOIN b USING (site, ts)),
d AS (SELECT site, day, coalesce(sum(irr_horiz), 0) AS total FROM full_b GROUP BY 1, 2),
best AS (SELECT site, day FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY total DESC, day) = 1)""", f"""
SELECT site, ts, CAST(day AS TIMESTAMP) AS day, {r('irr_horiz', 'irr_horiz')} FROM full_b SEMI JOIN best USING (site, day)"""))
def best_day(spark, sf_dir):
    return eda.best_day(std(spark, sf_dir))


@query("c14_yearly_total", f"""
SELECT o_orderpriority AS series, year(o_orderdate) AS year, {r('sum(o_totalprice)', 'total', 2)}
FROM orders GROUP BY 1, 2""", digits=2)
def yearly_total(spark, sf_dir):
    return eda.yearly_total(_orders(spark, sf_dir), "v", ["series"])


@query("c15_series_check", with_(SQL_STD + """,
steps AS (SELECT site, ts, date_diff('second', lag(ts) OVER (PARTITION BY site ORDER BY ts, row_id), ts) AS step FROM std)""",
    f"""SELECT site, count(*) FILTER (WHERE step < 0) AS n_backward, {r('max(step)', 'max_gap_s')},
  min(ts) AS first_ts, max(ts) AS last_ts FROM steps GROUP BY site"""))
def series_check(spark, sf_dir):
    return eda.series_check(std(spark, sf_dir))


@query("c16_plot_series", with_(SQL_STD + """,
b AS (SELECT site, date_trunc('hour', ts) AS ts, avg(target) AS target, avg(irr_horiz) AS irr_horiz,
  avg(amb_temp) AS amb_temp FROM std GROUP BY 1, 2),
g AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM b GROUP BY site),
f AS (SELECT site, ts, target, irr_horiz, amb_temp FROM g LEFT JOIN b USING (site, ts))""", " UNION ALL ".join(
    f"""SELECT site, ts, '{c}' AS "column", {r(c, 'value')} FROM f""" for c in ("target", "irr_horiz", "amb_temp"))))
def plot_series(spark, sf_dir):
    return eda.plot_series(std(spark, sf_dir), ["target", "irr_horiz", "amb_temp"])


@query("c16_scatter_pairs", with_(SQL_STD, f"""
SELECT site, {r('irr_horiz', 'x')}, {r('target', 'y')} FROM std WHERE irr_horiz IS NOT NULL AND target IS NOT NULL"""))
def scatter_pairs(spark, sf_dir):
    return eda.scatter_pairs(std(spark, sf_dir), "irr_horiz", "target")


_N = len(MODEL_FEATURES)


@query("c17_scaled_sanity", with_(SQL_SCALED, f"""
SELECT round(({' + '.join(f'avg({c})' for c in MODEL_FEATURES)}) / {_N}, 6) + 0.0 AS grand_mean,
  {r('(' + ' + '.join(f'stddev_samp({c})' for c in MODEL_FEATURES) + f') / {_N}', 'grand_std')}
FROM scaled WHERE split = 'train'"""))
def scaled_sanity(spark, sf_dir):
    rows, _ = scaled_rows(spark, sf_dir)
    return eda.scaled_sanity(rows.where("split = 'train'"), MODEL_FEATURES)


@query("c18_preprocessing_summary", with_(SQL_SPLIT, f"""
SELECT 'raw_rows' AS item, count(*) AS n FROM std UNION ALL
SELECT 'clean_rows', count(*) FROM parts UNION ALL
SELECT 'train_rows', count(*) FROM parts WHERE split = 'train' UNION ALL
SELECT 'val_rows', count(*) FROM parts WHERE split = 'val' UNION ALL
SELECT 'test_rows', count(*) FROM parts WHERE split = 'test' UNION ALL
SELECT 'n_features', {_N}"""))
def preprocessing_summary(spark, sf_dir):
    return eda.preprocessing_summary(std(spark, sf_dir), parts(spark, sf_dir), _N)


# ---- coarser bins from one written table of fine ones ---------------------------------------

_STATES = ["irr_horiz", "target"]


def _stats_sql(rule: str, start: str) -> str:
    columns = ", ".join(
        f"count({c}) AS {c}_n, {r(f'avg({c})', f'{c}_mean', 4)}, {r(f'stddev_samp({c})', f'{c}_std', 4)}, {r(f'min({c})', f'{c}_min', 4)}, {r(f'max({c})', f'{c}_max', 4)}"
        for c in _STATES
    )
    return f"SELECT '{rule}' AS rule, site, {start} AS ts, count(*) AS n_rows, {columns} FROM std GROUP BY site, {start}"


@query("c02_rollups", with_(SQL_STD, " UNION ALL ".join((
    _stats_sql("1 hour", "date_trunc('hour', ts)"), _stats_sql("day", "CAST(date_trunc('day', ts) AS TIMESTAMP)"),
    _stats_sql("month", "CAST(date_trunc('month', ts) AS TIMESTAMP)"), _stats_sql("year", "CAST(date_trunc('year', ts) AS TIMESTAMP)")))), digits=4)
def rollups(spark, sf_dir):
    """Hours, days, months and years, each rolled up from the next finer table; the raw rows are read once."""
    states, parts = rollup.bin_states(std(spark, sf_dir), _STATES), []
    for rule in ("1 hour", "day", "month", "year"):
        states = stage(rollup.roll_up(states, rule), "rolled")
        parts.append(rollup.statistics(states).drop(*(f"{c}_sum" for c in _STATES)).withColumn("rule", F.lit(rule)))
    return reduce(DataFrame.unionByName, parts)


@query("c02_hourly_mean_rollup", ORACLES["c02_hourly_mean"])
def hourly_mean_rollup(spark, sf_dir):
    return rollup.resampled(rollup.bin_states(std(spark, sf_dir), _STATES), "1 hour")


@query("c13_best_day_rollup", ORACLES["c13_best_day"])
def best_day_rollup(spark, sf_dir):
    return rollup.best_day(rollup.bin_states(std(spark, sf_dir), ["irr_horiz"]))


@query("c14_yearly_total_rollup", ORACLES["c14_yearly_total"], digits=2)
def yearly_total_rollup(spark, sf_dir):
    return rollup.yearly_total(rollup.bin_states(_orders(spark, sf_dir), ["v"], "day", ["series"]), "v", ["series"])


_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("c06_sketched_quantiles", " UNION ALL ".join(f"""
SELECT l_returnflag, CAST({p} AS DOUBLE) AS prob, count(*) AS n, true AS within FROM lineitem GROUP BY l_returnflag""" for p in _PROBS))
def sketched_price_quantiles(spark, sf_dir):
    """Quantiles of merged daily sketches, each with whether its true rank is within the stated bound."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice")
    daily = stage(quantile_sketches(rows, ["l_extendedprice"], ["l_returnflag", "l_shipdate"]), "sketches")
    found = small_side(sketched_quantiles(daily, ["l_extendedprice"], _PROBS, ["l_returnflag"]))
    below = F.avg((F.col("l_extendedprice") <= F.col("value")).cast("int"))
    ranks = rows.join(found, "l_returnflag").groupBy("l_returnflag", "prob").agg(F.count("*").alias("n"), below.alias("rank"))
    return ranks.select("l_returnflag", "prob", "n", (F.abs(F.col("rank") - F.col("prob")) <= RANK_BOUND + 1 / F.col("n")).alias("within"))
