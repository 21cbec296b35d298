import math
from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sunweave.functions import clear_sky_irradiance, clearness_index, season
from sunweave.operators.features import add_clearness_index, add_time_features
from sunweave.operators.resample import resample

T0 = datetime(2024, 2, 29, 10, 14, 59)


def feed(spark, minutes_values):
    rows = [("s", T0 + timedelta(minutes=m), v) for m, v in minutes_values]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double")


def test_bins_are_left_closed_and_complete(spark):
    got = resample(feed(spark, [(0, 1.0), (1, 3.0), (2, None), (61, 5.0)])).orderBy("ts").collect()
    assert [r["ts"].strftime("%H:%M") for r in got] == ["10:00", "10:15", "10:30", "10:45", "11:00", "11:15"]
    assert [r["v"] for r in got] == [1.0, 3.0, None, None, None, 5.0]


def test_empty_bin_sums_to_zero(spark):
    got = resample(feed(spark, [(0, 1.0), (2 * 1440, None)]), "day", "sum").orderBy("ts").collect()
    assert [r["v"] for r in got] == [1.0, 0.0, 0.0]
    got = resample(feed(spark, [(0, 1.0), (366 * 1440, 2.0)]), "year", "avg").collect()
    assert rows_of(spark.createDataFrame(got))[0][2] == 1.0


def test_each_series_has_its_own_span(spark):
    df = feed(spark, [(0, 1.0), (60, 1.0)]).union(
        feed(spark, [(600, 1.0)]).withColumn("site", F.lit("other"))
    )
    sizes = {r["site"]: r["count"] for r in resample(df).groupBy("site").count().collect()}
    assert sizes == {"s": 5, "other": 1}


def test_grid_reads_the_source_once(spark):
    plan = resample(feed(spark, [(0, 1.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and " Join" not in plan and "MergeJoin" not in plan


def test_cyclic_time(spark):
    df = spark.createDataFrame([(datetime(2024, 12, 31, 6, 59),)], "ts timestamp_ntz")
    row = add_time_features(df).first()
    assert row["hour_sin"] == pytest.approx(1.0) and row["hour_cos"] == pytest.approx(0.0, abs=1e-12)
    assert row["doy_sin"] == pytest.approx(math.sin(2 * math.pi * 366 / 365))
    assert row["month"] == 12


def expected_clear_sky(ts, latitude):
    angle = math.radians(15 * (ts.hour + ts.minute / 60 - 12))
    decl = math.radians(23.45 * math.sin(math.radians(360 * (284 + ts.timetuple().tm_yday) / 365)))
    lat = math.radians(latitude)
    z = math.sin(lat) * math.sin(decl) + math.cos(lat) * math.cos(decl) * math.cos(angle)
    return 1367 * max(z, 0) * 0.75


def test_clear_sky(spark):
    times = [datetime(2024, 6, 21, h, 30) for h in range(24)] + [datetime(2023, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = df.select("ts", clear_sky_irradiance(F.col("ts"), 28.5)).collect()
    for ts, value in got:
        assert value == pytest.approx(expected_clear_sky(ts, 28.5), abs=1e-9)


def test_clearness_guards(spark):
    df = spark.createDataFrame(
        [(500.0, 1000.0), (500.0, 0.0), (None, 1000.0), (2000.0, 1000.0), (-5.0, 1000.0), (1.0, None)],
        "irr double, sky double",
    )
    got = [r[0] for r in df.select(clearness_index(F.col("irr"), F.col("sky"))).collect()]
    assert got == [0.5, None, None, 1.5, 0.0, None]


def test_latitude_is_required_and_may_differ_by_site(spark):
    df = spark.createDataFrame(
        [("a", datetime(2024, 6, 1, 12), 500.0), ("b", datetime(2024, 6, 1, 12), 500.0)],
        "site string, ts timestamp_ntz, irr_horiz double",
    )
    with pytest.raises(ValueError, match="latitude"):
        add_clearness_index(df)
    got = {r["site"]: r["clearness_index"] for r in add_clearness_index(df, {"a": 0.0, "b": 60.0}).collect()}
    for site, lat in (("a", 0.0), ("b", 60.0)):
        assert got[site] == pytest.approx(500 / expected_clear_sky(datetime(2024, 6, 1, 12), lat))


def test_seasons(spark):
    df = spark.createDataFrame([(datetime(2024, m, 1),) for m in range(1, 13)], "ts timestamp_ntz")
    got = [r[0] for r in df.orderBy("ts").select(season(F.col("ts"))).collect()]
    assert got == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]
