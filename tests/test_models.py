from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunweave import models
from sunweave.models.registry import MODELS, SEQUENCE, TABULAR, model_key
from sunweave.models.sequence import conv_bank, reservoir, sequence_features
from sunweave.models.trees import first_trees, patient_best, round_losses
from sunweave.session import staging_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = 50 + x @ [3.0, -2.0, 0.5] + rng.normal(scale=0.3, size=400)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, target double").coalesce(2).cache()


def test_ridge_closed_form(spark, data):
    x, y, df = data
    for alpha in (0.1, 40.0):
        model = models.fit_ridge(df, ["a", "b", "c"], alpha=alpha)
        centred = x - x.mean(0)
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
        assert model.learner.coefficients.toArray() == pytest.approx(want, abs=1e-8)
        assert model.learner.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-8)
    names = {r["feature"] for r in models.coefficients(model).collect()}
    assert names == {"a", "b", "c", "(intercept)"}
    with pytest.raises(ValueError, match="no training rows"):
        models.fit_ridge(df.where("false"), ["a"])


def test_tabular_predictions_are_clamped(spark, data):
    df = data[2].withColumn("target", F.col("target") - 50)
    model = models.fit_ridge(df, ["a", "b", "c"])
    assert model.predict(df).where("predicted < 0").count() == 0
    assert model.predict(df).where("predicted = 0").count() > 0


@pytest.mark.parametrize("losses,patience,keep", [
    ([5, 4, 3, 3.5, 3.6, 2], 2, 3), ([5, 4, 3, 3.5, 3.6, 2], 5, 6), ([1, 2, 3], 20, 1), ([3, 2, 1], 1, 3),
])
def test_patience(losses, patience, keep):
    assert patient_best(losses, patience) == keep


def test_boosting_prefix_equals_refit(spark, data):
    df = data[2]
    features = ["a", "b", "c"]
    long = models.fit_boosted(df, features, rounds=8, depth=3)
    short = models.fit_boosted(df, features, rounds=3, depth=3)
    assert round_losses(long, df)[:3] == pytest.approx(round_losses(short, df))
    cut = first_trees(long, 3)
    said = lambda m: [r.predicted for r in m.predict(df).select("predicted").collect()]
    assert said(cut) == pytest.approx(said(short), abs=1e-9) and said(cut) != pytest.approx(said(long), abs=1e-9)
    assert cut.learner.getNumTrees == 3 and cut.learner.getOrDefault("maxIter") == 3 and cut.features == features
    path = staging_path(spark, "cut")
    cut.save(path)
    assert said(models.load_forecaster(spark, "gbt", path)) == pytest.approx(said(short), abs=1e-9)
    chosen = models.fit_boosted(df, features, validation=df.limit(50), rounds=6, depth=2, patience=1)
    assert chosen.learner.getNumTrees == chosen.notes["rounds"]


def test_forest_importance_and_seed(spark, data):
    df = data[2]
    first, second = (models.fit_forest(df, ["a", "b", "c"], trees=5, depth=4) for _ in range(2))
    table = models.feature_importance(first).collect()
    assert [r["rank"] for r in table] == [1, 2, 3] and table[0]["feature"] == "a"
    assert sum(r["importance"] for r in table) == pytest.approx(1)
    assert first.learner.toDebugString.split("\n")[1:] == second.learner.toDebugString.split("\n")[1:]
    assert models.feature_importance(first, 2).count() == 2


def test_save_and_load(spark, data):
    df = data[2]
    for key, model in (
        ("lr", models.fit_ridge(df, ["a", "b"])),
        ("rf", models.fit_forest(df, ["a", "b"], trees=3, depth=3)),
        ("gbt", models.fit_boosted(df, ["a", "b"], rounds=2, depth=2)),
    ):
        path = staging_path(spark, key)
        model.save(path)
        loaded = models.load_forecaster(spark, key, path)
        assert loaded.features == ["a", "b"] and loaded.label == MODELS[key]
        assert loaded.predict(df).select("predicted").collect() == model.predict(df).select("predicted").collect()


def test_registry(spark):
    assert model_key("  RF ") == "rf"
    with pytest.raises(ValueError, match="unknown model"):
        model_key("svr")
    assert set(TABULAR + SEQUENCE) == set(MODELS)
    assert not any(word in label.lower() for label in MODELS.values() for word in ("lstm", "cnn"))


def test_loss_history(spark, data):
    df = data[2]
    model = models.fit_boosted(df, ["a", "b", "c"], rounds=5, depth=2)
    rows = models.loss_history(model, df, df).orderBy("round").collect()
    assert [r["round"] for r in rows] == [1, 2, 3, 4, 5]
    losses = [r["train_loss"] for r in rows]
    assert losses == sorted(losses, reverse=True)


def test_conv_bank_by_hand():
    x = np.random.default_rng(0).normal(size=(3, 6, 2))
    got = conv_bank(x, filters=4, kernel=3, seed=9)
    rng = np.random.default_rng(9)
    w, b = rng.normal(0, 1 / np.sqrt(6), (3, 2, 4)), rng.uniform(-0.5, 0.5, 4)
    for n in range(3):
        steps = []
        for t in range(6):
            window = [x[n, t + k - 1] if 0 <= t + k - 1 < 6 else np.zeros(2) for k in range(3)]
            steps.append(np.maximum(b + sum(window[k] @ w[k] for k in range(3)), 0))
        want = [np.maximum(steps[2 * i], steps[2 * i + 1]) for i in range(3)]
        assert got[n] == pytest.approx(np.array(want))


def test_reservoir_depends_on_order_not_on_batch():
    x = np.random.default_rng(0).normal(size=(5, 8, 3))
    whole = reservoir(x, 10, 42)
    assert reservoir(x[2:3], 10, 42) == pytest.approx(whole[2:3])
    assert not np.allclose(reservoir(x[:, ::-1], 10, 42), whole)


def test_sequence_features(spark):
    df = spark.range(5).select("id", F.expr("transform(sequence(1, 16), i -> array(cast(i + id as double), 1D))").alias("seq"))
    sizes = {"seq_flat": 32, "seq_conv": 8 * 4, "seq_recurrent": 6, "seq_conv_recurrent": 6}
    for kind, size in sizes.items():
        shape = {} if kind == "seq_flat" else {"filters": 4, "units": 6}
        row = sequence_features(df, kind, **shape).orderBy("id").first()
        assert row["encoded"].size == size
    with pytest.raises(ValueError, match="not a sequence model"):
        sequence_features(df, "lr")
    assert sequence_features(df.where("false"), "seq_conv", filters=2).count() == 0


def test_skilled_rows_keep_every_row(spark, data):
    from types import SimpleNamespace

    from sunweave.catalog.learning import skilled_rows

    train = spark.createDataFrame([(0.0,), (10.0,)], "target double")
    said = [("M", "s", 0, 1.0, 2.0), ("M", "s", 1, 9.0, 11.0), ("M", None, 0, 4.0, None), ("M", None, 0, 4.0, float("nan"))]
    scored = spark.createDataFrame([(m, s, i, datetime(2024, 1, 1), a, p) for m, s, i, a, p in said], "model string, site string, idx long, ts timestamp_ntz, actual double, predicted double")
    bundle = SimpleNamespace(train=train, target="target")
    out = skilled_rows(scored, bundle).collect()
    assert sorted((r.site or "", r.idx, r.actual, r.in_range) for r in out) == [("", 0, 4.0, False), ("", 0, 4.0, False), ("s", 0, 1.0, True), ("s", 1, 9.0, False)]
    assert {(r.n_rows, r.n_unscored) for r in out} == {(4, 2)}
    assert all(r.in_range for r in skilled_rows(scored.where("site = 's'"), bundle, 0.25).collect())


@pytest.mark.parametrize("name", ["m03_forest", "m04_boosted", "j02_train_tabular"])
def test_learner_queries_list_test_rows(name):
    import duckdb
    import __spark_entry__ as entry
    from conftest import SMALL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'; CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    rows = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert len(rows) > 1 and len(rows) == rows["n_rows"][0] and {"site", "idx", "ts", "actual", "in_range"} <= set(rows.columns)
