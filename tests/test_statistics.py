import numpy as np
import pytest
from pyspark.sql import functions as F

from sunweave.operators import eda
from sunweave.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        # A third of all rows shares one value.
        v = 0.0 if i % 3 == 0 else float(rng.normal(100, 30))
        rows.append(("a" if i % 5 else "b", v, None if i % 9 == 0 else float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "g string, v double, w double")


@pytest.mark.parametrize("small_group", [10**6, 0])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_both_ways(spark, numbers, small_group, by):
    got = exact_quantiles(numbers, ["v", "w"], PROBS, by, small_group=small_group, accuracy=100).collect()
    data = numbers.toPandas()
    assert len(got) == len(PROBS) * 2 * (2 if by else 1)
    for r in got:
        part = data[data.g == r["g"]] if by else data
        want = np.quantile(part[r["column"]].dropna(), r["prob"])
        assert r["value"] == pytest.approx(want, abs=1e-9), (r["column"], r["prob"])


def test_quantiles_of_little_data(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "v double, w double")
    for small in (0, 10):
        got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["v", "w"], [0.5, 0.75], small_group=small).collect()}
        assert got == {("v", 0.5): 1.5, ("v", 0.75): 1.75}
    assert exact_quantiles(df.where("false"), ["v"], [0.5]).count() == 0


def test_describe_large_path(spark, numbers):
    a = {r["column"]: r for r in eda.describe(numbers, ["v", "w"]).collect()}
    b = {r["column"]: r for r in eda.describe(numbers, ["v", "w"], small_group=0).collect()}
    for c in ("v", "w"):
        assert a[c]["p50"] == pytest.approx(b[c]["p50"]) and a[c]["count"] == b[c]["count"]


def test_histogram_equals_numpy(spark, numbers):
    got = eda.histogram(numbers, "w", 7).orderBy("bin").collect()
    data = numbers.toPandas().w.dropna()
    counts, edges = np.histogram(data, 7)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["bin_from"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert [r["bin_to"] for r in got] == pytest.approx(edges[1:].tolist())
    by = eda.histogram(numbers, "w", 7, ["g"]).groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r["n"] for r in by) == len(data) and all(r["k"] == 7 for r in by)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    got = eda.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [4, 0, 0, 0, 0]


def test_correlations(spark, numbers):
    data = numbers.toPandas()[["v", "w"]]
    assert eda.correlations(numbers, ["v", "w"]).first()["r"] == pytest.approx(data.corr().iloc[0, 1])
    constant = numbers.withColumn("v", F.lit(1.0))
    assert eda.correlations(constant, ["v", "w"]).first()["r"] is None


def test_scatter_sample_is_seeded(spark, series):
    a = eda.scatter_pairs(series, "irr_horiz", "target", 0.3).collect()
    assert a == eda.scatter_pairs(series, "irr_horiz", "target", 0.3).collect()
    assert 0 < len(a) < series.count()


def test_series_check_on_skewed_sites(spark, series):
    got = {r["site"]: r["max_gap_s"] for r in eda.series_check(series).collect()}
    assert got == {"site_a": 180.0, "site_b": 360.0}
