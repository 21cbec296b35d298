"""Parquet hand-over between jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunweave.session import small_side, stage


def write_site_parquet(df: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Snappy parquet, one directory per site so a site filter prunes the rest.

    Rebalancing by site gives small sites one file each and splits a huge one over several
    tasks, so neither many tiny files nor one giant task arises; the record limit bounds files.
    """
    (
        df.hint("rebalance", "site").write.mode("overwrite")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("site")
        .parquet(path)
    )


def parquet_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the prepared table if it exists, else build it from its source."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return build()


def _listed(spark: SparkSession, source: str) -> DataFrame:
    """``source_file, version`` of every file below ``source``; the version is its length and time. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    # The same spelling as input_file_name: without it a file and its rows would not meet.
    name = F.regexp_replace("path", "^file:/+", "file:///")
    version = F.concat_ws("-", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string"))
    return files.select(name.alias("source_file"), version.alias("version"))


def refreshed(
    spark: SparkSession, source: str, path: str, build: Callable[[list[str]], DataFrame]
) -> tuple[DataFrame, list[str]]:
    """The table that ``build`` makes of the files below ``source``, kept at ``path``, and the files read for it now.

    A manifest beside the data holds name and version of the files that the table was made of. Only new or changed files
    are built; their rows go to partitions of their own, and rows of files that changed or went are no longer read.
    The manifest is written last, so a broken run leaves the old table in place. ``build`` gets file names and must not
    shuffle: a row belongs to the file it came from. The driver holds the names of changed files.
    """
    manifests, rows = f"{path}/manifest", f"{path}/rows"
    now = stage(_listed(spark, source), "files")
    try:
        newest = spark.read.parquet(manifests)
        turn = newest.agg(F.max("turn")).first()[0] + 1
        before = newest.where(F.col("turn") == turn - 1).drop("turn")
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        turn, before = 0, now.where("false")
    changed = [(r.source_file, r.version) for r in now.join(before, ["source_file", "version"], "left_anti").orderBy("source_file").collect()]
    if changed:
        versions = spark.createDataFrame(changed, "source_file string, version string")
        name = F.regexp_replace(F.input_file_name(), "^file:/+", "file:///")
        built = build([f for f, _ in changed]).withColumn("source_file", name).join(small_side(versions), "source_file")
        built.withColumn("file_id", F.sha2(F.concat_ws("|", "source_file", "version"), 256)).drop("version").write.mode("append").partitionBy("file_id").parquet(rows)
    if changed or now.join(before, ["source_file", "version"], "full_outer").count() != now.count():
        now.withColumn("turn", F.lit(turn)).write.mode("append").parquet(manifests)
    held = small_side(now.select(F.sha2(F.concat_ws("|", "source_file", "version"), 256).alias("file_id")))
    return spark.read.parquet(rows).join(held, "file_id", "left_semi").drop("file_id"), [f for f, _ in changed]
