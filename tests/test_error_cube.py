"""Tables from the error cube equal those from the predictions, and rollups equal resampling the raw rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from sunweave.catalog.base import std
from sunweave.operators import error_cube, evaluate, rollup
from sunweave.operators.resample import resample
from sunweave.operators.eda import best_day, yearly_total
from sunweave.plans.report import evaluation_tables
from sunweave.session import stage


@pytest.fixture(scope="module")
def predictions(spark):
    """Two sites, seasons and hours, NULLs on either side, a constant model, a perfect one, one without any score."""
    rng, rows, start = random.Random(4), [], datetime(2023, 1, 1)
    for model in ("noisy", "same", "exact", "none"):
        for site in ("a", "b"):
            for i in range(5, 1200):
                y = None if i % 50 == 0 else 10000 + 6000 * math.sin(i / 20) + rng.random()
                p = {"noisy": (y or 0) + rng.gauss(0, 900), "same": 5000.0, "exact": y, "none": None}[model]
                rows.append((model, site, i, start + timedelta(hours=7 * i), y, None if i % 41 == 0 else p))
    schema = "model string, site string, idx long, ts timestamp_ntz, actual double, predicted double"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def close(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, rel=1e-6, abs=2e-4) if isinstance(value, float) else value), (key, name)


def test_cube_tables_equal_direct_ones(predictions):
    cells = stage(error_cube.error_cells(predictions), "cells")
    assert cells.count() < predictions.count() / 4
    close(error_cube.scores(cells), evaluate.metrics(predictions), ["model"])
    close(error_cube.scores(cells, ["model", "season"], ["rmse", "mae", "r2"]), evaluate.seasonal_metrics(predictions), ["model", "season"])
    close(error_cube.scores(cells, ["model", "hour"], ["mae"]), evaluate.hourly_mae(predictions), ["model", "hour"])
    close(error_cube.slice_scores(cells), evaluate.slice_metrics(predictions), ["model", "slice"])
    close(error_cube.confusion(cells), evaluate.confusion_matrix(predictions), ["model", "true_level", "predicted_level"])
    close(error_cube.accuracy(cells), evaluate.level_accuracy(predictions), ["model"])
    close(error_cube.classification(cells), evaluate.classification_report(predictions), ["model", "label"])
    close(error_cube.half_widths(cells), evaluate.band_widths(predictions).where("half_width is not null"), ["model"])


def test_coverage_and_counts(predictions):
    cells = stage(error_cube.error_cells(predictions), "cells")
    got = {r.model: r for r in error_cube.coverage(predictions, cells).collect()}
    want = {r.model: r for r in evaluate.band_coverage(evaluate.prediction_band(predictions)).collect()}
    assert got["noisy"].coverage == pytest.approx(want["noisy"].coverage) and 0.9 < got["noisy"].coverage < 1
    counts = {r.model: r for r in error_cube.scores(cells, counts=True).collect()}
    assert counts["none"].n_unscored == counts["none"].n_rows == 2390 and counts["none"].rmse is None


def test_cells_of_parts_merge(predictions):
    """Cells of two halves, put together, are cells of the whole."""
    halves = [error_cube.error_cells(predictions.where(F.col("idx") % 2 == i), slices={}) for i in (0, 1)]
    close(error_cube.scores(halves[0].unionByName(halves[1])), evaluate.metrics(predictions), ["model"])


def test_tables_read_the_cube(predictions):
    tables = evaluation_tables(predictions)
    for name in ("seasonal", "hourly", "confusion", "accuracy", "classification", "slices"):
        files = tables[name].inputFiles()
        assert files and all("error-cells" in f for f in files)
    empty = error_cube.error_cells(predictions.where("false"))
    assert error_cube.scores(empty).count() == 0 and error_cube.confusion(empty).count() == 0


@pytest.mark.parametrize("rule,agg", [("1 hour", "avg"), ("day", "sum"), ("month", "avg"), ("year", "sum")])
def test_rollups_equal_resampling(spark, rule, agg):
    rows = std(spark, SMALL).select("site", "ts", "irr_horiz", "rh")
    states = rollup.bin_states(rows, ["irr_horiz", "rh"])
    tidy = lambda df: rows_of(df.select("site", "ts", *[F.round(c, 6) for c in ("irr_horiz", "rh")]))
    assert tidy(rollup.resampled(states, rule, agg)) == tidy(resample(rows, rule, agg, ["irr_horiz", "rh"]))


def test_states_of_states(spark):
    rows = std(spark, SMALL).select("site", "ts", (F.col("irr_horiz") + 1e6).alias("v"))
    fine = rollup.bin_states(rows, ["v"])
    day = rollup.statistics(rollup.roll_up(rollup.roll_up(fine, "1 hour"), "day"))
    close(day.select("site", "ts", "n_rows", "v_n", "v_mean", "v_std", "v_min", "v_max"), rows.groupBy("site", F.to_date("ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count("*").alias("n_rows"), F.count("v").alias("v_n"), F.avg("v").alias("v_mean"), F.stddev_samp("v").alias("v_std"), F.min("v").alias("v_min"), F.max("v").alias("v_max")), ["site", "ts"])


def test_days_and_years_from_states(spark):
    rows = std(spark, SMALL)
    states = rollup.bin_states(rows, ["irr_horiz"])
    assert all("bin-states" in f for f in rollup.roll_up(states, "day").inputFiles())
    tidy = lambda df, c: rows_of(df.withColumn(c, F.round(c, 6)))
    assert tidy(rollup.best_day(states), "irr_horiz") == tidy(best_day(rows), "irr_horiz")
    assert tidy(rollup.yearly_total(states), "total") == tidy(yearly_total(rows), "total")
