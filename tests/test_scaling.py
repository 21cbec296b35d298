import numpy as np
import pytest
from pyspark.sql import functions as F

from sunweave.operators import scaling as ops
from sunweave.session import staging_path


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(float(i), 7.0, float(i * i)) for i in range(10)], "a double, flat double, target double")


def test_standard_scaler_uses_population_deviation(spark, table):
    s = ops.fit_scaler(table, ["a", "flat"])
    assert s.params["a"][1] == pytest.approx(np.std(range(10)))
    assert s.params["flat"][:2] == (7.0, 1.0)
    rows = ops.apply_scaler(table, s).agg(F.avg("a"), F.stddev_pop("a"), F.max("flat")).first()
    assert rows[0] == pytest.approx(0) and rows[1] == pytest.approx(1) and rows[2] == 0.0


def test_minmax_is_not_clipped_and_constant_is_zero(spark, table):
    s = ops.fit_scaler(table, ["a", "flat"], "minmax")
    outside = spark.createDataFrame([(18.0, 7.0, 0.0)], table.schema)
    row = ops.apply_scaler(outside, s).first()
    assert (row["a"], row["flat"]) == (2.0, 0.0)
    with pytest.raises(ValueError, match="unknown scaler"):
        ops.fit_scaler(table, ["a"], "robust")


def test_inverse(spark, table):
    for s in (ops.fit_target_scaler(table), ops.fit_scaler(table, ["target"])):
        out = ops.inverse_scale(ops.scale_target(table, s), s, "target_scaled")
        assert all(r["target"] == pytest.approx(r["target_scaled"]) for r in out.collect())


def test_test_rows_do_not_matter(spark, table):
    more = table.withColumn("split", F.lit("train")).union(
        spark.createDataFrame([(1e9, 1e9, 1e9, "test")], "a double, flat double, target double, split string")
    )
    assert ops.fit_scaler(more.where("split = 'train'"), ["a"]).params == ops.fit_scaler(table, ["a"]).params


def test_save_load_checks_the_feature_list(spark, table):
    path = staging_path(spark, "scaler")
    s = ops.fit_scaler(table, ["a", "flat"])
    s.save(spark, path)
    assert ops.load_scaler(spark, path, ["a", "flat"]) == s
    with pytest.raises(ValueError, match="another feature list"):
        ops.load_scaler(spark, path, ["a"])
