"""Shared frames of the queries, and the same frames as SQL text.

``events`` plays the telemetry feed: two sites, fill codes, negative targets, one sparse sensor,
duplicate seconds and gaps. Sites are even and odd users.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunweave.functions import parse_day_hour
from sunweave.operators.cleaning import clean_bins
from sunweave.operators.evaluate import persistence
from sunweave.operators.features import engineer_features
from sunweave.operators.split import split_chronological
from sunweave.sources.site_csv import replace_sentinels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LATITUDE = 43.45
VALUES = ["irr_horiz", "amb_temp", "rh", "wind_speed", "pressure", "target"]
KEPT = ["irr_horiz", "amb_temp", "wind_speed", "pressure", "target"]


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its result gets plain types and rounded doubles."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT, doubles rounded, dates as timestamps: types both engines share."""
    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL text of a rounded double; adding 0.0 turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def rs(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- raw telemetry ------------------------------------------------------------------------

def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as a logger writes it: fill codes, day-of-year dates."""
    value, uid, eid = F.col("value"), F.col("user_id"), F.col("event_id")
    day = F.hour("ts").between(6, 17)
    irr = F.least(value * 4, F.lit(1300.0))
    return table(spark, sf_dir, "events").select(
        eid.alias("row_id"),
        F.when(uid % 2 == 0, "site_a").otherwise("site_b").alias("site"),
        (F.year("ts") * 1000 + F.dayofyear("ts")).cast("int").alias("raw_day"),
        F.date_format("ts", "HH:mm:ss").alias("raw_hour"),
        F.when(F.col("event_type") == "error", 32767.0).when(day, irr).otherwise(0.0).alias("irr_raw"),
        F.when(eid % 97 == 0, 32766.0).otherwise((10 + uid % 25).cast("double")).alias("temp_raw"),
        F.when(eid % 3 != 0, -99.0).otherwise((40 + uid % 60).cast("double")).alias("rh_raw"),
        ((eid % 50) / 10.0).alias("wind_raw"),
        (1000 + uid % 30).cast("double").alias("pres_raw"),
        F.when(eid % 53 == 0, -1.0).when(eid % 89 == 0, 32767.0)
        .when(day, irr * 12 + eid % 100).otherwise(0.0).alias("pwr_raw"),
    )


RAW_VALUES = ["irr_raw", "temp_raw", "rh_raw", "wind_raw", "pres_raw", "pwr_raw"]

SQL_RAW = """raw AS (
  SELECT event_id AS row_id,
    CASE WHEN user_id % 2 = 0 THEN 'site_a' ELSE 'site_b' END AS site,
    CAST(year(ts) * 1000 + dayofyear(ts) AS INT) AS raw_day,
    strftime(ts, '%H:%M:%S') AS raw_hour,
    CAST(CASE WHEN event_type = 'error' THEN 32767
         WHEN hour(ts) BETWEEN 6 AND 17 THEN least(value * 4, 1300) ELSE 0 END AS DOUBLE) AS irr_raw,
    CAST(CASE WHEN event_id % 97 = 0 THEN 32766 ELSE 10 + user_id % 25 END AS DOUBLE) AS temp_raw,
    CAST(CASE WHEN event_id % 3 <> 0 THEN -99 ELSE 40 + user_id % 60 END AS DOUBLE) AS rh_raw,
    CAST(event_id % 50 AS DOUBLE) / 10.0 AS wind_raw,
    CAST(1000 + user_id % 30 AS DOUBLE) AS pres_raw,
    CAST(CASE WHEN event_id % 53 = 0 THEN -1 WHEN event_id % 89 = 0 THEN 32767
         WHEN hour(ts) BETWEEN 6 AND 17 THEN least(value * 4, 1300) * 12 + event_id % 100
         ELSE 0 END AS DOUBLE) AS pwr_raw
  FROM events)"""

# Raw column of each site that carries each logger value.
SITE_RAW = {
    "site_a": ["FHZIRR", "FPVDBT", "FPV_RH", "FWINDA", "FRAIRP", "INVPWR"],
    "site_b": ["FPHIRR", "FAMBTM", "FPV_RH", "FWINDS", "FVPRES", "INVPWR"],
}


def site_raw(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """One site's rows under its own raw column names."""
    rows = raw(spark, sf_dir).where(F.col("site") == site)
    return rows.select(
        "row_id", F.col("raw_day").alias("DAY"), F.col("raw_hour").alias("HOUR"),
        *[F.col(v).alias(n) for v, n in zip(RAW_VALUES, SITE_RAW[site])],
    )


# ---- standardised telemetry ---------------------------------------------------------------

def std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sites under standard names, fill codes removed, time parsed; one scan."""
    rows = raw(spark, sf_dir).transform(replace_sentinels)
    return rows.select(
        "site", parse_day_hour(F.col("raw_day"), F.col("raw_hour")).alias("ts"), "row_id",
        *[F.col(v).alias(n) for v, n in zip(RAW_VALUES, VALUES)],
    ).where(F.col("ts").isNotNull())


def _ok(c: str) -> str:
    return f"CASE WHEN {c} IN (32767, 32766, -99) THEN NULL ELSE {c} END"


SQL_TS = "make_date(raw_day // 1000, 1, 1) + CAST(raw_day % 1000 - 1 AS INT) + CAST(raw_hour AS TIME)"

SQL_STD = SQL_RAW + f""",
std AS (
  SELECT site, {SQL_TS} AS ts, row_id,
    {_ok('irr_raw')} AS irr_horiz, {_ok('temp_raw')} AS amb_temp, {_ok('rh_raw')} AS rh,
    {_ok('wind_raw')} AS wind_speed, {_ok('pres_raw')} AS pressure, {_ok('pwr_raw')} AS target
  FROM raw)"""

# ---- cleaned 15-minute grid, resample first -----------------------------------------------


def clean_layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Cleaned rows with ``idx``, and whether every series is short enough for one window."""
    return clean_bins(std(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_layout(spark, sf_dir)[0].drop("idx")


SQL_BINS = SQL_STD + """,
bins AS (
  SELECT site, time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(irr_horiz) AS irr_horiz,
    avg(amb_temp) AS amb_temp, avg(wind_speed) AS wind_speed, avg(pressure) AS pressure,
    avg(target) AS target
  FROM std WHERE target >= 0 GROUP BY 1, 2)"""


def sql_fill(c: str, order: str = "ts", gap: int = 4) -> str:
    return (
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY site ORDER BY {order} "
        f"ROWS BETWEEN {gap} PRECEDING AND CURRENT ROW) AS {c}"
    )


SQL_CLEAN = SQL_BINS + f""",
clean AS (
  SELECT site, ts, {', '.join(sql_fill(c) for c in KEPT)}
  FROM bins WHERE irr_horiz > 5),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) - 1 AS idx
  FROM clean WHERE target IS NOT NULL)"""

# ---- features -----------------------------------------------------------------------------


def feature_layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    rows, bounded = clean_layout(spark, sf_dir)
    return engineer_features(rows, LATITUDE, bounded=bounded), bounded


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_layout(spark, sf_dir)[0]


SQL_TIME = """sin(hour(ts) * 2 * pi() / 24.0) AS hour_sin, cos(hour(ts) * 2 * pi() / 24.0) AS hour_cos,
    sin(dayofyear(ts) * 2 * pi() / 365.0) AS doy_sin, cos(dayofyear(ts) * 2 * pi() / 365.0) AS doy_cos,
    CAST(month(ts) AS BIGINT) AS month"""


def sql_clear_sky(ts: str = "ts", latitude: float = LATITUDE) -> str:
    decl = f"radians(23.45 * sin(radians(360.0 * (284 + dayofyear({ts})) / 365.0)))"
    angle = f"radians(15.0 * (hour({ts}) + minute({ts}) / 60.0 - 12.0))"
    lat = f"radians({latitude})"
    return (
        f"greatest(sin({lat}) * sin({decl}) + cos({lat}) * cos({decl}) * cos({angle}), 0.0) * 1367.0 * 0.75"
    )


def sql_clearness(irr: str = "irr_horiz", sky: str | None = None) -> str:
    ratio = f"({irr} / nullif({sky or sql_clear_sky()}, 0))"
    return f"CASE WHEN {ratio} IS NULL THEN NULL ELSE least(greatest({ratio}, 0.0), 1.5) END"


def sql_lags(columns, lags=(1, 4, 8), order: str = "ts") -> str:
    return ", ".join(
        f"lag({c}, {n}) OVER (PARTITION BY site ORDER BY {order}) AS {c}_lag{n}" for c in columns for n in lags
    )


def sql_rolls(column: str, windows=(4, 8), order: str = "ts") -> str:
    out = []
    for n in windows:
        over = f"OVER (PARTITION BY site ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out.append(f"avg({column}) {over} AS {column}_roll{n}_mean")
        out.append(f"coalesce(stddev_samp({column}) {over}, 0.0) AS {column}_roll{n}_std")
    return ", ".join(out)


SQL_FEATURES = SQL_CLEAN + f""",
featured AS (
  SELECT *, {SQL_TIME}, {sql_clearness()} AS clearness_index,
    {sql_lags(['irr_horiz', 'target'])}, {sql_rolls('irr_horiz')}
  FROM indexed),
feats AS (SELECT * REPLACE (idx - 8 AS idx) FROM featured WHERE idx >= 8)"""

LAGGED = [f"{c}_lag{n}" for c in ("irr_horiz", "target") for n in (1, 4, 8)]
ROLLED = [f"irr_horiz_roll{n}_{s}" for n in (4, 8) for s in ("mean", "std")]
CYCLES = ["hour_sin", "hour_cos", "doy_sin", "doy_cos"]
FEATURE_VALUES = KEPT + CYCLES + ["clearness_index"] + LAGGED + ROLLED
# The 20-feature list without the sensor dropped as too sparse.
MODEL_FEATURES = [c for c in KEPT if c != "target"] + CYCLES + [
    "month", "clearness_index", "irr_horiz_lag1", "irr_horiz_lag4", "irr_horiz_lag8",
    "target_lag1", "target_lag4", *ROLLED,
]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, bounded = feature_layout(spark, sf_dir)
    return split_chronological(rows, bounded=bounded)


SQL_SPLIT = SQL_FEATURES + """,
sized AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM feats),
parts AS (
  SELECT * EXCLUDE (n), CASE WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val'
    ELSE 'test' END AS split
  FROM sized)"""

# ---- persistence forecasts ----------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values 1, 4 and 8 rows ago as three forecasts of the cleaned target."""
    rows, bounded = clean_layout(spark, sf_dir)
    return persistence(rows, (1, 4, 8), bounded=bounded)


SQL_PREDICTIONS = SQL_CLEAN + """,
lagged AS (
  SELECT site, idx, ts, target AS actual, unnest([1, 4, 8]) AS s,
    [lag(target, 1) OVER w, lag(target, 4) OVER w, lag(target, 8) OVER w] AS earlier
  FROM indexed WINDOW w AS (PARTITION BY site ORDER BY ts)),
pred AS (
  SELECT * FROM (
    SELECT 'persistence_' || s AS model, site, idx, ts, actual,
      earlier[CASE s WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END] AS predicted
    FROM lagged)
  WHERE predicted IS NOT NULL)"""

SQL_METRICS = """round(sqrt(avg((actual - predicted) ** 2)), 4) AS rmse,
    round(avg(abs(actual - predicted)), 4) AS mae,
    round(avg(abs((actual - predicted) / (abs(actual) + 1e-6))) * 100, 4) AS mape,
    round(1 - sum((actual - predicted) ** 2) / (count(*) * var_pop(actual)), 4) AS r2,
    round(corr(actual, predicted), 4) AS pearson_r,
    round(sqrt(avg((actual - predicted) ** 2)) / (max(actual) - min(actual)) * 100, 4) AS nrmse_pct"""

SQL_SCORES = SQL_PREDICTIONS + f""",
scores AS (SELECT model, {SQL_METRICS} FROM pred GROUP BY model)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
