import numpy as np
import pytest
from pyspark.sql import functions as F

from sunweave.operators import evaluate as ops


def table(spark, actual, predicted, model="m"):
    rows = [(model, "s", i, None if a is None else float(a), None if p is None else float(p)) for i, (a, p) in enumerate(zip(actual, predicted))]
    return spark.createDataFrame(rows, "model string, site string, idx long, actual double, predicted double").withColumn(
        "ts", (F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,cast(idx as int))")).cast("timestamp_ntz")
    )


def scores(spark, actual, predicted):
    return ops.metrics(table(spark, actual, predicted), digits=None).first()


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.uniform(0, 100, 200), rng.uniform(0, 100, 200)
    got = scores(spark, y, p)
    assert got["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert got["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert got["mape"] == pytest.approx(np.mean(np.abs((y - p) / (np.abs(y) + 1e-6))) * 100)
    assert got["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert got["pearson_r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert got["nrmse_pct"] == pytest.approx(got["rmse"] / (y.max() - y.min()) * 100)


def test_edge_metrics(spark):
    flat = scores(spark, [5, 5], [5, 5])
    assert (flat["r2"], flat["pearson_r"], flat["nrmse_pct"], flat["rmse"]) == (1.0, None, None, 0.0)
    assert scores(spark, [5, 5], [5, 6])["r2"] == 0.0
    assert scores(spark, [0, 1], [1, 1])["mape"] == pytest.approx(1e8 / 2)
    assert scores(spark, [1, 2, None, 3], [1, 2, 9, None])["rmse"] == 0.0


def test_band(spark):
    y, p = np.array([1.0, 5, 9, 2]), np.array([2.0, 4, 9, 0])
    got = ops.prediction_band(table(spark, y, p)).orderBy("idx").collect()
    half = 1.96 * np.std(y - p)
    assert [r["upper"] for r in got] == pytest.approx((p + half).tolist())
    assert [r["lower"] for r in got] == pytest.approx(np.maximum(p - half, 0).tolist())
    assert ops.band_coverage(ops.prediction_band(table(spark, y, p))).first()["coverage"] == 1.0


def brute_report(truth, said):
    names = [n for n in ops.LEVELS if n in truth or n in said]
    out, n = {}, len(truth)
    for name in names:
        hit = sum(t == p == name for t, p in zip(truth, said))
        support, claims = truth.count(name), said.count(name)
        pr = hit / claims if claims else 0.0
        re = hit / support if support else 0.0
        out[name] = (pr, re, 2 * pr * re / (pr + re) if pr + re else 0.0, support)
    acc = sum(t == p for t, p in zip(truth, said)) / n
    out["accuracy"] = (acc,) * 4
    out["macro avg"] = tuple(np.mean([out[k][i] for k in names]) for i in range(3)) + (n,)
    out["weighted avg"] = tuple(sum(out[k][i] * out[k][3] for k in names) / n for i in range(3)) + (n,)
    return out


@pytest.mark.parametrize("actual,predicted", [
    ([100, 4000, 20000, 12000, 3000, 9000], [200, 2000, 15000, 9000, 3000.5, 9500]),
    ([100, 200, 4000], [100, 200, 300]),
    ([100, 200, -5], [100, 200, 100]),
])
def test_classification_report(spark, actual, predicted):
    level = lambda v: None if v < 0 else "Low" if v <= 3000 else "Medium" if v <= 10000 else "High"
    pairs = [(level(a), level(p)) for a, p in zip(actual, predicted) if level(a) and level(p)]
    want = brute_report([t for t, _ in pairs], [p for _, p in pairs])
    df = table(spark, actual, predicted)
    got = {r["label"]: (r["precision"], r["recall"], r["f1-score"], r["support"]) for r in ops.classification_report(df).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-4), k
    cm = {(r["true_level"], r["predicted_level"]): r["n"] for r in ops.confusion_matrix(df).collect()}
    assert len(cm) == 9 and sum(cm.values()) == len(pairs)
    assert all(n == pairs.count(k) for k, n in cm.items())


def test_slices_and_ranking(spark):
    df = table(spark, range(700), [v + 1 for v in range(700)]).union(table(spark, range(700), [v + 2 for v in range(700)], "n"))
    got = {(r["model"], r["slice"]): r["mae"] for r in ops.slice_metrics(df).collect()}
    assert got == {("m", "day"): 1.0, ("m", "week"): 1.0, ("n", "day"): 2.0, ("n", "week"): 2.0}
    places = {(r["metric"], r["model"]): r["place"] for r in ops.metric_ranking(ops.metrics(df)).collect()}
    assert places[("rmse", "m")] == 1 and places[("r2", "m")] == 1 and places[("r2", "n")] == 2


def test_errors_by_position(spark):
    df = table(spark, [1, 2], [2, 2]).union(table(spark, [1, 2], [1, 5], "n"))
    got = ops.prediction_errors(df).orderBy("idx").collect()
    assert [(r["m_err"], r["n_err"]) for r in got] == [(1.0, 0.0), (0.0, 3.0)]
