import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sunweave.catalog.base import LATITUDE, std
from sunweave.models import load_forecaster
from sunweave.operators.evaluate import metrics
from sunweave.plans import job, studies
from sunweave.plans.prepare import prepare
from sunweave.plans.report import analysis_tables, dataset_dictionary
from sunweave.plans.train import fit_tabular, reload_and_score, train_sequence
from sunweave.session import shared_root, small_side, stage, staging_path


@pytest.fixture(scope="module")
def bundle(spark):
    return prepare(std(spark, SMALL), latitude=LATITUDE)


@pytest.mark.parametrize("preset", ["documented", "cli13", "notebook"])
def test_presets(spark, preset):
    b = prepare(std(spark, SMALL), preset=preset, latitude=LATITUDE)
    assert "rh" not in b.features and "target" not in b.features
    sizes = {r["split"]: r["count"] for r in b.rows.groupBy("split").count().collect()}
    assert sizes["train"] > sizes["val"] > 0 and sizes["test"] > 0
    stats = b.train.agg(*[F.avg(c) for c in b.features]).first()
    assert all(abs(v) < 1e-9 for v in stats)
    low, high = b.train.agg(F.min("target_scaled"), F.max("target_scaled")).first()
    assert (low, high) == (0.0, 1.0)
    spans = b.rows.groupBy("site", "split").agg(F.min("pos"), F.max("pos"), F.count("*")).collect()
    assert all(r[2] == 0 and r[3] == r[4] - 1 for r in spans)
    order = b.rows.groupBy("site", "split").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    for site in ("site_a", "site_b"):
        span = {r["split"]: r for r in order if r["site"] == site}
        assert span["train"]["b"] <= span["val"]["a"] and span["val"]["b"] <= span["test"]["a"]


def test_unknown_preset_and_feature(spark):
    with pytest.raises(ValueError, match="unknown preset"):
        prepare(std(spark, SMALL), preset="other", latitude=LATITUDE)
    with pytest.raises(ValueError, match="not found"):
        prepare(std(spark, SMALL), features=["irr_lag1"], latitude=LATITUDE)


def test_train_reload_score(spark, bundle):
    model = fit_tabular("LR ", bundle)
    path = staging_path(spark, "m")
    model.save(path)
    again = reload_and_score({"lr": load_forecaster(spark, "lr", path)}, bundle)
    assert again.count() == bundle.test.count()
    assert metrics(again).first()["rmse"] > 0
    with pytest.raises(ValueError, match="not a tabular"):
        fit_tabular("seq_flat", bundle)


def test_sequence_model_in_watts(spark, bundle):
    model, scored = train_sequence("seq_recurrent", bundle, units=8)
    per = {r["site"]: r["count"] for r in bundle.test.groupBy("site").count().collect()}
    got = {r["site"]: r["count"] for r in scored.groupBy("site").count().collect()}
    assert got == {s: n - 16 for s, n in per.items() if n > 16}
    truth = scored.join(bundle.test.select("site", F.col("pos").alias("idx"), "target"), ["site", "idx"])
    assert truth.where("actual <> target").count() == 0


def test_hash_sample_is_stable_and_nested(spark, bundle):
    small, large = (studies.hash_sample(bundle.train, f).select("site", "ts") for f in (0.2, 0.5))
    assert small.join(large, ["site", "ts"], "left_anti").count() == 0
    assert 0 < small.count() < large.count() < bundle.train.count()


def test_learned_horizons(spark, bundle):
    got = studies.learned_horizons(bundle, horizons=(1, 4)).collect()
    assert sorted(r["horizon"] for r in got) == [1, 4]


def test_tables_have_rows(spark, bundle):
    model = fit_tabular("lr", bundle)
    scored = stage(reload_and_score({"lr": model}, bundle), "pred")
    tables = analysis_tables(std(spark, SMALL), "site_b", scored)
    assert all(t.count() > 0 for t in tables.values())
    assert dataset_dictionary(spark, "site_b").where("standard_name = 'irr_horiz'").first()["raw_column"] == "FPHIRR"


def test_job_end_to_end(spark):
    from sunweave.catalog.base import site_raw

    path, out = staging_path(spark, "in"), staging_path(spark, "out")
    site_raw(spark, SMALL, "site_a").withColumnRenamed("row_id", "_c0").write.option("header", True).csv(path)
    job.main(["--site", "site_a", "--input", path, "--output", out, "--latitude", "43.45", "--models", "lr", "seq_flat"])
    rows = spark.read.option("header", True).csv(f"{out}/model_comparison").collect()
    assert {r["label"] for r in rows} == {"Linear Regression", "Flat Window Ridge"}
    assert load_forecaster(spark, "lr", f"{out}/models/lr").features
    assert job.expand(["tabular", "lr"]) == ["lr", "rf", "gbt"]


def test_small_side_checks_its_size(spark):
    df = spark.range(100)
    other = spark.range(1000).withColumnRenamed("id", "x")
    plan = lambda side: other.join(side, F.col("id") == F.col("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small_side(df, 100))
    assert "strategy=broadcast" not in plan(small_side(df, 99))


def test_shared_root_is_one_folder(spark):
    assert shared_root(spark) == shared_root(spark)
    assert staging_path(spark, "x") != staging_path(spark, "x")
