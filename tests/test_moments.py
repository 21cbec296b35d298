"""Gram blocks and window models from moments against explicit windows and refits."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sunweave import models
from sunweave.catalog.base import LATITUDE, std
from sunweave.models.sequence import fit_readout, sequence_features
from sunweave.operators import moments
from sunweave.operators.sequences import build_sequences
from sunweave.plans import studies
from sunweave.plans.prepare import prepare
from sunweave.session import staging_path

SERIES = ("site", "split")
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Series of many lengths: too short for any window, for some horizons, and across several blocks."""
    rng = np.random.default_rng(3)
    out = []
    for site, n in (("long", 700), ("mid", 61), ("one", 1), ("just", 9), ("short", 5), ("edge", 12)):
        x = rng.normal(size=(n, 3)).cumsum(0) * 0.3 + 1
        y = np.concatenate([np.zeros(2), x[:-2, 0] * 2 - x[1:-1, 1]])[:n] + rng.normal(size=n) * 0.1
        out += [(site, "train", i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(out, "site string, split string, pos long, a double, b double, c double, y double").repartition(5).cache()


def explicit(rows, lookback, horizon):
    seqs = build_sequences(rows, NAMES, "y", lookback, horizon=horizon, keep=(), bounded=False)
    return sequence_features(seqs, "seq_flat").select("site", "pos", "encoded", "y")


@pytest.mark.parametrize("block", [40, 50_000])
def test_lagged_moments_equal_explicit_windows(rows, block):
    horizons = (1, 2, 5)
    found = moments.lagged_grams(rows, NAMES, "y", 6, horizons, SERIES, "pos", block_rows=block)
    for h in horizons:
        got = explicit(rows, 6, h).collect()
        z = np.array([[1.0, *r["encoded"].toArray(), r["y"]] for r in got])
        assert found[h].cross == pytest.approx(z.T @ z, abs=1e-8)


def test_window_grams_equal_explicit_windows(rows):
    flat = lambda x: x.reshape(len(x), -1)
    found = moments.window_grams(rows, NAMES, "y", 6, 2, flat, SERIES, "pos", block_rows=64)
    z = np.array([[1.0, *r["encoded"].toArray(), r["y"]] for r in explicit(rows, 6, 2).collect()])
    assert found.cross == pytest.approx(z.T @ z, abs=1e-8)


def test_flat_model_equals_ridge_on_window_vectors(rows):
    for h, model in models.fit_windows("seq_flat", rows, NAMES, "y", 6, (1, 3)).items():
        windows = explicit(rows, 6, h).cache()
        ridge = fit_readout(windows, "seq_flat")
        assert model.weights == pytest.approx(ridge.learner.coefficients.toArray(), abs=1e-8)
        assert model.intercept == pytest.approx(ridge.learner.intercept, abs=1e-8)
        for bounded in (False, True):
            got = {(r.site, r.pos): r.predicted for r in model.predict(rows, (), bounded=bounded).collect()}
            want = {(r.site, r.pos): r.predicted for r in ridge.predict(windows).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_encoded_model_equals_ridge_on_encoded_windows(rows):
    for kind in ("seq_conv", "seq_recurrent", "seq_conv_recurrent"):
        model = models.fit_windows(kind, rows, NAMES, "y", 6, filters=3, units=4)[1]
        seqs = build_sequences(rows, NAMES, "y", 6, keep=(), bounded=False)
        encoded = sequence_features(seqs, kind, 6, filters=3, units=4).cache()
        ridge = fit_readout(encoded, kind)
        assert model.weights == pytest.approx(ridge.learner.coefficients.toArray(), abs=1e-6)
        got = {(r.site, r.pos): r.predicted for r in model.predict(rows, ("y",)).collect()}
        want = {(r.site, r.pos): r.predicted for r in ridge.predict(encoded).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        assert np.abs(models.imbalance(model, rows, "y")).max() < 1e-6


def test_imbalance_sees_a_wrong_readout(rows):
    model = models.fit_windows("seq_flat", rows, NAMES, "y", 6)[1]
    assert np.abs(models.imbalance(model, rows, "y")).max() < 1e-8
    model.weights = model.weights * 0
    assert np.abs(models.imbalance(model, rows, "y")).max() > 0.01


def test_no_windows_and_no_rows(spark, rows):
    for df in (rows.where("site in ('one', 'short')"), rows.where("false")):
        for kind in ("seq_flat", "seq_recurrent"):
            with pytest.raises(ValueError, match="no training rows"):
                models.fit_windows(kind, df, NAMES, "y", 6)
    with pytest.raises(ValueError, match="not a sequence model"):
        models.fit_windows("lr", rows, NAMES, "y")
    with pytest.raises(ValueError, match="unknown settings"):
        models.fit_windows("seq_conv", rows, NAMES, "y", depth=3)


def test_saved_window_models_score_alike(spark, rows):
    for kind, shape in (("seq_flat", {}), ("seq_conv", {"filters": 3})):
        model = models.fit_windows(kind, rows, NAMES, "y", 6, **shape)[1]
        path = staging_path(spark, kind)
        model.save(path)
        again = models.load_forecaster(spark, kind, path)
        assert again.label == model.label and again.weights.tolist() == model.weights.tolist()
        assert sorted(again.predict(rows, ()).collect()) == sorted(model.predict(rows, ()).collect())


def test_no_row_of_the_fit_holds_a_window(rows):
    blocks = moments.in_blocks(rows, [*NAMES, "y"], 6, SERIES, "pos")
    assert not any("array" in kind for _, kind in blocks.dtypes)


def test_grams_of_cells_add_up(rows):
    cells = moments.grams(rows, NAMES, "y", F.col("pos") % 3)
    whole = moments.grams(rows.withColumn("a", F.when(F.col("pos") != -1, F.col("a"))), NAMES, "y")[0]
    total = cells[0] + cells[1] + cells[2]
    assert total.cross == pytest.approx(whole.cross) and total.n == rows.count()
    for alpha in (0.1, 30.0):
        ridge = models.fit_ridge(rows, NAMES, "y", alpha)
        weights, intercept = total.ridge(alpha)
        assert weights == pytest.approx(ridge.learner.coefficients.toArray(), abs=1e-8)
        assert intercept == pytest.approx(ridge.learner.intercept, abs=1e-8)
    assert moments.grams(rows.where("false"), NAMES, "y") == {}


def test_training_length_equals_ten_fits(spark):
    bundle = prepare(std(spark, SMALL), latitude=LATITUDE)
    got = {(r.selection, r.fraction): r for r in studies.training_length(bundle).collect()}
    assert len(got) == 10
    test = np.array(bundle.test.select(*bundle.features, bundle.target).collect(), dtype=float)
    sizes = {r.site: r.n_rows for r in studies.series_lengths(bundle.train).collect()}
    for (selection, fraction), row in got.items():
        if selection == "ordered":
            limits = [(F.col("site") == s) & (F.col("pos") < int(n * fraction)) for s, n in sizes.items()]
            some = bundle.train.where(limits[0] | limits[1])
        else:
            some = studies.hash_sample(bundle.train, fraction)
        z = np.array(some.select(*bundle.features, bundle.target).collect(), dtype=float)
        x, y = z[:, :-1] - z[:, :-1].mean(0), z[:, -1]
        weights = np.linalg.solve(x.T @ x + 0.1 * np.eye(x.shape[1]), x.T @ (y - y.mean()))
        z_test = test[:, :-1] - z[:, :-1].mean(0)
        miss = test[:, -1] - np.maximum(z_test @ weights + y.mean(), 0)
        assert row.n_train == len(z) and row.n_rows == len(test) and row.n_unscored == 0
        assert row.rmse == pytest.approx(np.sqrt((miss**2).mean()), abs=2e-4) and row.mae == pytest.approx(np.abs(miss).mean(), abs=2e-4)
