"""Features and forecasts on a stream against the batch chain on the same files."""

from datetime import timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sunweave.catalog.base import LATITUDE, std
from sunweave.operators.cleaning import clean_bins
from sunweave.operators.features import engineer_features
from sunweave.plans.prepare import prepare
from sunweave.plans.train import fit_tabular
from sunweave.session import staging_path
from sunweave.streaming import live_features, live_forecasts
from sunweave.streaming.features import ROCKS, STORE

COLUMNS = ["irr_horiz", "amb_temp", "wind_speed", "pressure", "target"]


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    yield
    spark.conf.set(STORE, before)


def run(df, name, state):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query


def test_stream_features_and_forecasts_equal_batch(spark, rocks):
    rows = std(spark, SMALL).select("site", "ts", *COLUMNS)
    days = [r[0] for r in rows.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()][:8]
    rows = rows.where(F.to_date("ts").isin(days))
    path, state = staging_path(spark, "feed"), staging_path(spark, "state")
    for i in range(0, len(days), 2):
        rows.where(F.to_date("ts").isin(days[i : i + 2])).coalesce(1).write.mode("append").parquet(path)
    bundle = prepare(std(spark, SMALL), latitude=LATITUDE)
    model = fit_tabular("lr", bundle)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    features = live_features(stream, LATITUDE, COLUMNS)
    assert run(features, "live", state).recentProgress
    got = spark.table("live")

    grid, bounded = clean_bins(rows, threshold=1.0)
    batch = engineer_features(grid, LATITUDE, bounded=bounded)
    last = got.groupBy("site").agg(F.max("ts").alias("last"))
    batch = batch.join(last, "site").where("ts <= last").drop("last")
    names = [c for c in batch.columns if c in got.columns]
    assert "target_lag8" in names and "irr_horiz_roll8_std" in names and "clearness_index" in names
    tidy = lambda df: {(r.site, r.ts): [None if r[c] is None else round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names] for r in df.collect()}
    found, wanted = tidy(got), tidy(batch)
    assert len(found) > 20 and found == wanted

    scored = live_forecasts(got, model, bundle.scaler).collect()
    again = {(r.site, r.ts): r.predicted for r in live_forecasts(batch, model, bundle.scaler).collect()}
    assert scored and {(r.site, r.ts): pytest.approx(r.predicted) for r in scored} == again


def test_late_readings_are_dropped_and_state_is_bounded(spark, rocks):
    base = spark.sql("SELECT timestamp_ntz'2024-06-01 08:00:00' AS t").first().t
    path, state = staging_path(spark, "feed"), staging_path(spark, "state")
    schema = "site string, ts timestamp_ntz, irr_horiz double, target double"

    def write(minutes, irr):
        rows = [("a", base + timedelta(minutes=m), irr + m, 2.0 * m) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    write(range(0, 600, 15), 500.0)
    write([5, 20, 600], 9000.0)  # the first two are hours late
    write(range(615, 900, 15), 500.0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = run(live_features(stream, LATITUDE, ["irr_horiz", "target"]), "late", state)
    got = {r.ts: r.irr_horiz for r in spark.table("late").collect()}
    assert base + timedelta(minutes=195) in got and got[base + timedelta(minutes=195)] == 695.0
    assert max(v for t, v in got.items() if t < base + timedelta(minutes=600)) < 1200.0
    rows = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators if "transformWithState" in op.operatorName]
    assert rows and max(rows) <= 4 + 8 + 1 + 4
