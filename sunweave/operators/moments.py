"""Additive second moments of rows and of windows of rows.

A task adds up what its rows contribute and hands on one vector per key; vectors of a key are added in a
second step. The number of keys and the length of a vector depend on features and settings, never on rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.operators.ordered import BLOCK_ROWS, series_lengths
from sunweave.session import small_side

VECTORS = "key int, vector binary"


def vectors(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(rows, names=["key", "vector"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw)
            sums[key] = sums[key] + part if key in sums else part
    yield vectors(sums)


def collected(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the vectors of each key, added on the executors."""
    rows = parts.repartition("key").mapInArrow(_added, VECTORS).toArrow()
    return {k: np.frombuffer(v) for k, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())}


@dataclass
class Gram:
    """Count, sums and products of features and target: ``cross`` is Z'Z of rows (1, features..., target)."""

    cross: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.cross + other.cross)

    @property
    def n(self) -> float:
        return float(self.cross[0, 0])

    @property
    def means(self) -> np.ndarray:
        return self.cross[0, 1:] / self.cross[0, 0]

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Weights and free intercept of least squares plus ``alpha * |w|^2``."""
        if not self.n:
            raise ValueError("no training rows")
        mean = self.means
        centred = self.cross[1:, 1:] - self.n * np.outer(mean, mean)
        p = len(mean) - 1
        weights = np.linalg.lstsq(centred[:p, :p] + alpha * np.eye(p), centred[:p, p], rcond=None)[0]
        return weights, float(mean[p] - mean[:p] @ weights)


def _matrix(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    out = np.empty((batch.num_rows, last - first))
    for i in range(first, last):
        out[:, i - first] = batch.column(i).to_numpy(zero_copy_only=False)
    return out


def grams(df: DataFrame, features: Sequence[str], target: str, key: Column | None = None) -> dict[int, Gram]:
    """The Gram of the rows of each ``key`` (a small int; default: one key 0) in one scan.

    Rows without target or feature do not count; rows without key neither. Any union of keys is a sum of
    Grams, so nested subsets need no scan of their own.
    """
    names = [*features, target]
    rows = df.select((F.lit(0) if key is None else key).cast("int").alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, z = batch.column(0).to_numpy(), _matrix(batch, 0, 1 + len(names))
            z[:, 0] = 1.0
            for k in np.unique(keys).tolist():
                own = z[keys == k]
                part = (own.T @ own).ravel()
                sums[k] = sums[k] + part if k in sums else part
        yield vectors(sums)

    size = 1 + len(names)
    return {k: Gram(v.reshape(size, size)) for k, v in collected(rows.mapInArrow(run, VECTORS)).items()}


# ---- series in blocks -----------------------------------------------------------------------

def in_blocks(
    df: DataFrame, columns: Sequence[str], reach: int, series: Sequence[str], idx: str, keep: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows in series order, in blocks of positions that begin with the ``reach`` rows before them.

    Columns: ``run`` (equal within a block of a series), ``own`` (false for rows of the block before),
    ``columns`` as doubles, then ``keep``. Each block is one task's, whatever the length of its series.
    """
    if reach > block_rows:
        raise ValueError(f"reach {reach} exceeds the block of {block_rows} rows")
    home = F.floor(F.col(idx) / block_rows)
    tail = F.col(idx) % block_rows >= block_rows - reach
    cut = df.withColumn("_block", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))))
    cut = cut.repartition(*series, "_block").sortWithinPartitions(*series, "_block", idx)
    return cut.select(
        F.xxhash64(*series, "_block").alias("run"), (F.col("_block") == home).alias("own"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *keep,
    )


def segments(batches: Iterator[pa.RecordBatch], width: int, reach: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, pa.RecordBatch]]:
    """Stretches of one block: rows, how many of them are repeated from the stretch before, own rows, batch part.

    The repeated rows (``reach`` at most) come first; ``own`` and the batch part are about the others.
    """
    before, last = np.zeros((0, width)), None
    for batch in batches:
        runs, own, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch, 2, 2 + width)
        borders = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
        for a, b in zip(borders[:-1], borders[1:]):
            if b == a:
                continue
            if runs[a] != last:
                before, last = before[:0], runs[a]
            rows = np.concatenate([before, values[a:b]])
            yield rows, len(before), own[a:b], batch.slice(a, b - a)
            before = rows[-reach:] if reach else rows[:0]


def windows(rows: np.ndarray, before: int, own: np.ndarray, features: int, lookback: int, horizon: int, size: int = 2048):
    """Windows (n, steps, features) of a stretch and the positions (in ``rows``) of the rows they predict."""
    first = max(before, lookback + horizon - 1)
    at = np.arange(first, len(rows))
    at = at[own[at - before]]
    if len(rows) < lookback:
        return
    view = np.lib.stride_tricks.sliding_window_view(rows[:, :features], lookback, axis=0)
    for i in range(0, len(at), size):
        some = at[i : i + size]
        yield view[some - horizon - lookback + 1].transpose(0, 2, 1), some


def window_grams(
    df: DataFrame, features: Sequence[str], target: str, lookback: int, horizon: int, encode: Callable[[np.ndarray], np.ndarray],
    series: Sequence[str], idx: str, block_rows: int = BLOCK_ROWS,
) -> Gram:
    """The Gram of encoded windows and targets; windows exist only within a task, a few at a time."""
    reach, width = lookback + horizon - 1, len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows, before, own, _ in segments(batches, width, reach):
            for x, at in windows(rows, before, own, width - 1, lookback, horizon):
                z = np.column_stack([np.ones(len(at)), encode(x), rows[at, -1]])
                total = z.T @ z if total is None else total + z.T @ z
        yield vectors({} if total is None else {i: row for i, row in enumerate(total)})

    rows = collected(in_blocks(df, [*features, target], reach, series, idx, block_rows=block_rows).mapInArrow(run, VECTORS))
    return Gram(np.array([rows[i] for i in range(len(rows))]) if rows else np.zeros((1, 1)))


def lagged_grams(
    df: DataFrame, features: Sequence[str], target: str, lookback: int, horizons: Sequence[int],
    series: Sequence[str], idx: str, block_rows: int = BLOCK_ROWS,
) -> dict[int, Gram]:
    """The Gram of flat windows (oldest step first) and targets for each horizon, from lagged cross moments.

    With rows before the start and after the end taken as zeros, the products of steps s and s' over all
    windows that touch a series depend on s' - s alone. So ``lookback`` matrices of products of rows d apart,
    summed once through the blocks, give the whole matrix; the windows that stick out at the ends of a
    series are then taken away. No row ever holds a window, and one pass over the rows serves all horizons.
    """
    far, f = max(horizons), len(features)
    reach, d = lookback + far - 1, lookback * f
    names = [*features, target]

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, answers = np.zeros((lookback, f, f)), np.zeros((reach + 1, f))
        sums = np.zeros(f + 3)
        for rows, before, own, _ in segments(batches, f + 1, reach):
            x, n = rows[:, :f], len(rows)
            later = np.concatenate([np.zeros(before), own.astype(float)])
            mine = rows * later[:, None]
            for k in range(min(lookback, n)):
                low = max(before, k)
                products[k] += x[low - k : n - k].T @ mine[low:, :f]
            for k in range(1, min(reach + 1, n)):
                low = max(before, k)
                answers[k] += mine[low:, f] @ x[low - k : n - k]
            sums[:f] += mine[:, :f].sum(0)
            sums[f:] += later.sum(), mine[:, f].sum(), (mine[:, f] ** 2).sum()
        yield vectors({0: np.concatenate([products.ravel(), answers.ravel(), sums])})

    whole = collected(in_blocks(df, names, reach, series, idx, block_rows=block_rows).mapInArrow(inner, VECTORS))
    if not whole:
        return {h: Gram(np.zeros((d + 2, d + 2))) for h in horizons}
    flat = whole[0]
    products, answers = flat[: lookback * f * f].reshape(lookback, f, f), flat[lookback * f * f : -(f + 3)].reshape(reach + 1, f)
    sums = flat[-(f + 3) :]
    edges = _edges(df, names, lookback, tuple(horizons), series, idx)
    out = {}
    for k, h in enumerate(horizons):
        cross = np.zeros((d + 2, d + 2))
        for s in range(lookback):
            outside = edges[k * (lookback + 1) + s]
            mine = slice(1 + s * f, 1 + (s + 1) * f)
            for other in range(lookback):
                part = products[other - s] if other >= s else products[s - other].T
                cross[mine, 1 + other * f : 1 + (other + 1) * f] = part
            cross[mine, 1:-1] -= outside[: f * d].reshape(f, d)
            cross[mine, -1] = cross[-1, mine] = answers[lookback - 1 + h - s] - outside[f * d : f * d + f]
            cross[mine, 0] = cross[0, mine] = sums[:f] - outside[f * d + f :]
        n, y, yy = edges[k * (lookback + 1) + lookback]
        cross[0, 0], cross[0, -1], cross[-1, -1] = n, sums[f + 1] - y, sums[f + 2] - yy
        cross[-1, 0] = cross[0, -1]
        out[h] = Gram(cross)
    return out


def _edges(df: DataFrame, names: Sequence[str], lookback: int, horizons: tuple[int, ...], series: Sequence[str], idx: str) -> dict[int, np.ndarray]:
    """What windows sticking out of their series add to zero-padded sums, by horizon and step.

    Reads the first and last rows of each series only. Vectors: for each step the products with all
    columns, those with the answer, and sums; then the count of whole windows and sums of answers without a window.
    """
    f = len(names) - 1
    reach, d = lookback + max(horizons) - 1, lookback * f
    lengths = small_side(series_lengths(df, series))
    ends = df.join(lengths, list(series)).where((F.col(idx) < reach) | (F.col(idx) >= F.col("n_rows") - reach))
    ends = ends.repartition(*series).sortWithinPartitions(*series, idx)
    ends = ends.select(F.xxhash64(*series).alias("run"), F.col("n_rows").cast("double").alias("n"), F.col(idx).cast("double").alias("at"), *[F.col(c).cast("double") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def add(key: int, vector: np.ndarray) -> None:
            sums[key] = sums[key] + vector if key in sums else vector

        def one(rows: np.ndarray) -> None:
            n, at = int(rows[0, 0]), rows[:, 1].astype(np.int64)

            def padded(first: int, last: int) -> np.ndarray:
                out = np.zeros((last - first, f + 1))
                inside = (at >= first) & (at < last)
                out[at[inside] - first] = rows[inside, 2:]
                return out

            def flat(first: int, last: int) -> np.ndarray:
                """Windows that begin at ``first`` to ``last`` - 1, one row each."""
                if last <= first:
                    return np.zeros((0, d))
                held = padded(first, last + lookback - 1)[:, :f]
                return np.lib.stride_tricks.sliding_window_view(held, lookback, axis=0).transpose(0, 2, 1).reshape(last - first, d)

            head = flat(1 - lookback, 0)
            early = padded(0, reach)[:, f]
            for k, h in enumerate(horizons):
                whole = max(0, n - h - lookback + 1)
                z = np.concatenate([head, flat(whole, n)])
                # A window that begins before the series may have an answer; one that ends behind its last answer has none.
                y = np.zeros(len(z))
                y[: lookback - 1] = early[h : h + lookback - 1]
                products, answers, total = z.T @ z, z.T @ y, z.sum(0)
                for s in range(lookback):
                    mine = slice(s * f, (s + 1) * f)
                    add(k * (lookback + 1) + s, np.concatenate([products[mine].ravel(), answers[mine], total[mine]]))
                without = early[: lookback - 1 + h]
                add(k * (lookback + 1) + lookback, np.array([whole, without.sum(), (without**2).sum()]))

        held, last = [], None
        for batch in batches:
            runs, values = batch.column(0).to_numpy(), _matrix(batch, 1, 4 + f)
            borders = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(borders[:-1], borders[1:]):
                if b > a and runs[a] != last:
                    if held:
                        one(np.concatenate(held))
                    held, last = [], runs[a]
                if b > a:
                    held.append(values[a:b])
        if held:
            one(np.concatenate(held))
        yield vectors(sums)

    return collected(ends.mapInArrow(run, VECTORS))
