"""Sliding-window sequences and multi-step labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.operators.ordered import look_back
from sunweave.schema import LOOKBACK


def build_sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    lookback: int = LOOKBACK,
    series: Sequence[str] = ("site", "split"),
    horizon: int = 1,
    idx: str = "pos",
    keep: Sequence[str] = ("ts",),
    **layout,
) -> DataFrame:
    """``seq`` = the ``lookback`` rows that end ``horizon`` rows before the row, ``y`` its target.

    ``idx`` must be dense within ``series``; windows never cross splits. A row with fewer than
    ``lookback + horizon - 1`` predecessors yields no sequence.
    """
    def build(w):
        step = F.array(*[F.col(c).cast("double") for c in features])
        return {"seq": F.collect_list(step).over(w.rowsBetween(-(lookback + horizon - 1), -horizon))}

    out = look_back(df, lookback + horizon - 1, build, series=series, idx=idx, **layout)
    return out.where(F.col(idx) >= lookback + horizon - 1).select(
        *series, idx, *keep, "seq", F.col(target).alias("y")
    )


def flat_vector(seq: str = "seq"):
    """The window as one vector, oldest step first."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.flatten(F.col(seq)))
