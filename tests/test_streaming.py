from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from sunweave.catalog.base import std
from sunweave.operators.cleaning import drop_bad_target
from sunweave.operators.resample import resample
from sunweave.session import staging_path
from sunweave.streaming import live_bins


def test_stream_equals_batch(spark):
    """The same files streamed in time order give the batch bins, but for the last open ones."""
    rows = std(spark, SMALL).drop("rh")
    path, state = staging_path(spark, "feed"), staging_path(spark, "state")
    days = [r[0] for r in rows.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()][:4]
    for day in days:
        rows.where(F.to_date("ts") == F.lit(day)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        live_bins(stream).writeStream.outputMode("append").format("memory").queryName("bins")
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("bins")
    last = got.agg(F.max("ts")).first()[0]
    batch = resample(drop_bad_target(rows.where(F.to_date("ts").isin(days))), complete=False).where(F.col("ts") <= F.lit(last))
    tidy = lambda df: rows_of(df.select("site", "ts", *[F.round(c, 6) for c in ("irr_horiz", "amb_temp", "target")]))
    assert got.count() > 50
    assert tidy(got) == tidy(batch)
