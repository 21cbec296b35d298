from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sunweave.functions import clamp_non_negative, power_level
from sunweave.operators import cleaning as ops
from sunweave.operators.ordered import index_rows
from sunweave.operators.resample import resample

T0 = datetime(2024, 6, 1, 12)


def one_site(spark, targets, step=1, **extra):
    rows = [("s", T0 + timedelta(minutes=i * step), i, v) for i, v in enumerate(targets)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, row_id long, target double")


def test_bad_targets_go(spark):
    df = one_site(spark, [1.0, None, -0.1, 0.0])
    assert [r["target"] for r in ops.drop_bad_target(df).orderBy("row_id").collect()] == [1.0, 0.0]


def test_exactly_half_null_is_kept(spark):
    df = spark.createDataFrame(
        [("s", 1.0, None, None), ("s", 1.0, 2.0, None), ("s", 1.0, None, None), ("s", 1.0, 2.0, 3.0)],
        "site string, target double, half double, most double",
    )
    assert ops.drop_sparse_columns(df).columns == ["site", "target", "half"]


def test_daytime_threshold_and_fallback(spark):
    df = spark.createDataFrame([(5.0,), (5.01,), (None,)], "irr_plane double")
    assert [r[0] for r in ops.filter_daytime(df).collect()] == [5.01]
    other = spark.createDataFrame([(1.0,)], "x double")
    assert ops.filter_daytime(other).count() == 1


@pytest.mark.parametrize("bounded", [True, False])
def test_gap_of_four_filled_five_not(spark, bounded):
    df = one_site(spark, [1.0, None, None, None, None, 2.0, None, None, None, None, None, 3.0])
    df = df if bounded else index_rows(df)
    got = ops.fill_gaps(df, bounded=bounded).orderBy("row_id").collect()
    assert [r["target"] for r in got] == [1.0] * 5 + [2.0] * 5 + [3.0]


def test_night_filter_makes_the_grid_unnecessary(spark, series):
    """Skipping empty bins under the night filter gives the same rows as building them."""
    quick = ops.clean_grid(series)
    full = ops.filter_daytime(resample(ops.drop_sparse_columns(ops.drop_bad_target(series))))
    full = ops.keep_numeric(ops.fill_gaps(full, bounded=True))
    assert rows_of(quick) == rows_of(full.select(quick.columns))


def test_without_night_filter_targets_are_filled(spark):
    rows = [("s", T0, 0, 5.0), ("s", T0 + timedelta(minutes=75), 1, 7.0), ("s", T0 + timedelta(minutes=180), 2, 9.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, row_id long, target double")
    got = ops.clean_grid(df, filter_night=False).orderBy("ts").collect()
    # 5 grid gaps of 1..4 rows are filled; the longer gap keeps its first four only.
    assert [r["target"] for r in got] == [5.0] * 5 + [7.0] * 5 + [9.0]


def test_missing_feature_raises(spark):
    df = one_site(spark, [1.0])
    with pytest.raises(ValueError, match="irr_lag1"):
        ops.feature_rows(df, ["irr_lag1"])
    assert ops.feature_rows(df, ["irr_lag1"], allow_missing=True).columns == ["site", "ts", "row_id", "target"]


def test_the_grid_is_the_bound(spark):
    """Two bins far apart: without the night filter their grid is what has to fit."""
    rows = [("s", T0, 0, 5.0), ("s", T0 + timedelta(days=20), 1, 7.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, row_id long, target double")
    assert [ops.clean_bins(df, night, max_series=1000)[1] for night in (False,)] == [False]
    assert ops.clean_bins(df, False, max_series=2000)[1]


def test_only_dropped_columns_may_be_missing(spark):
    df = one_site(spark, [1.0])
    assert ops.feature_rows(df, ["rh", "rh_lag1"], allow_missing=["rh"]).columns == ["site", "ts", "row_id", "target"]
    with pytest.raises(ValueError, match="month"):
        ops.feature_rows(df, ["rh", "month"], allow_missing=["rh"])


def test_candidates_once_in_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, target double")
    assert ops.candidate_features(df, ["b", "x", "a", "b", "target"]) == ["b", "a"]


def test_date_slice_includes_last_day(spark):
    rows = [(datetime(2024, 1, d, 23, 59),) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert ops.date_slice(df, "2024-01-01", "2024-01-02").count() == 2


def test_levels_and_clamp(spark):
    values = [0.0, 3000.0, 3000.01, 10000.0, 10000.01, -1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = df.select(power_level(F.col("v")), clamp_non_negative(F.col("v"))).collect()
    assert [r[0] for r in got] == ["Low", "Low", "Medium", "Medium", "High", None, None]
    assert [r[1] for r in got] == [0.0, 3000.0, 3000.01, 10000.0, 10000.01, 0.0, None]


def test_observed_counts_without_extra_job(spark):
    df, obs = ops.observed(one_site(spark, [1.0, None, 2.0]), "all", ["target"])
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"n_rows": 3, "null_target": 1}


@pytest.mark.parametrize("night", [True, False])
def test_long_series_go_through_blocks(spark, series, night):
    """Beyond the checked length the same rows come out, with dense positions."""
    short, bounded = ops.clean_bins(series, night)
    long, still = ops.clean_bins(series, night, max_series=3)
    assert (bounded, still) == (True, False)
    assert long.columns == short.columns and rows_of(long) == rows_of(short)
    assert rows_of(ops.clean_grid(series, night, max_series=3)) == rows_of(ops.clean_grid(series, night))
    spans = long.groupBy("site").agg(F.min("idx"), F.max("idx"), F.count("*")).collect()
    assert all(r[1] == 0 and r[2] == r[3] - 1 for r in spans)
