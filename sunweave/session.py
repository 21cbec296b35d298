"""Session defaults and the shared-folder helpers that cut long lineages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "sunweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a ``local[...]`` session without one gets a temporary folder; anywhere else a
    machine-local folder would lose data with its machine, so the missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if root:
        return root
    root = sc.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sunweave-"))
    return sc.getCheckpointDir()


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later purging."""
    app = spark.sparkContext.applicationId
    return os.path.join(shared_root(spark), f"sunweave-{app}", f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike an in-memory cache it outlives lost executors, and unlike a row checkpoint it is
    columnar, so later passes that need two columns read two columns. Its shuffle files go once it is written.
    """
    path = staging_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, "false")
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP_CONF, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark ``df`` for broadcast only after counting its rows and bytes; a larger one joins by shuffle.

    The side is written once to the shared folder, so counting does not compute it twice and nothing
    stays cached.
    """
    kept = stage(df, "side")
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in kept.schema.fields
             if not isinstance(f.dataType, (T.NumericType, T.DatetimeType, T.BooleanType))]
    width = sum(texts, F.lit(8 * len(kept.columns)))
    rows, size = kept.agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(kept) if rows <= max_rows and (size or 0) <= max_bytes else kept
