"""Bins of a running feed with the same operators as the batch chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.functions import numeric_columns
from sunweave.operators.cleaning import drop_bad_target
from sunweave.schema import RESAMPLE_RULE


def live_bins(
    std: DataFrame,
    rule: str = RESAMPLE_RULE,
    lateness: str = "30 minutes",
    columns: Sequence[str] | None = None,
    zoned: bool = False,
) -> DataFrame:
    """Mean per site and bin of a standardised stream; a bin is final once the watermark passes it.

    State is one row per open (site, bin): the watermark drops closed bins, so it does not grow
    with the feed. With ``zoned``, ``ts`` stays the event time that a further stateful operator needs.
    """
    columns = numeric_columns(std) if columns is None else list(columns)
    start = F.col("window.start")
    bins = (
        std.transform(drop_bad_target)
        # Watermarks need a zoned timestamp; under a UTC session it is the same instant.
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("site", F.window("ts", rule))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    if zoned:
        return bins.select("site", start.alias("ts"), *columns)
    return bins.select("site", start.cast("timestamp_ntz").alias("ts"), *columns)
