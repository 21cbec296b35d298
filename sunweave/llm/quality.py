"""Quality scores by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are training rows labelled 1; all documents are the unlabelled text, whatever their
labels. With class prior ``pi`` and logistic loss ``l``, the risk is
``pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)])``. The prior is estimated from the corpus: over
regions of high score, the share of unlabelled over the share of positive documents is smallest where
no negative is left, and there it is the prior. Features are shape statistics and hashed word shares
of the whole text; a linear model on them is fitted by full gradient steps, each one distributed pass
over the written features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import add_from_text
from sunweave.session import stage

HASHED = 48
STEPS, RATE, DECAY = 40, 0.25, 1e-4
BINS = 200
#: Share of the positives that a region must hold to count for the prior.
LEAST_SHARE = 0.3

_UPPER = W.byte_class((65, 90))
_LETTER = W.byte_class((65, 90), (97, 122), (128, 255))
_DIGIT = W.byte_class((48, 57))
_SPACE = W.byte_class((32, 32), (9, 13))
_SENTENCE = W.byte_class((44, 44), (46, 46))
_MARK = ~(_LETTER | _DIGIT | _SPACE | _SENTENCE)

SHAPES = [
    "log_words", "log_bytes", "upper", "digits", "spaces", "commas", "marks", "non_ascii", "lines", "word_length",
    "short_words", "long_words", "bare_marks", "end_marks", "capitals", "shouted", "same_as_last", "same_as_second_last",
    "distinct", "top_word", "no_words",
]
SIZE = len(SHAPES) + HASHED + 1


def features(block: W.Block) -> np.ndarray:
    """One row of SIZE numbers per text; the last is always 1."""
    found = block.words(W.NON_SPACE)
    n, raw = found.count, block.raw
    h = found.hashes()
    size = np.diff(block.offsets)
    bytes_, words = np.maximum(size, 1), np.maximum(n, 1)
    length = found.end - found.start
    share = lambda mask: W.sums(mask.astype(np.int64), size) / bytes_
    per_word = lambda mask: W.sums(mask.astype(np.int64), n) / words
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    letters, upper = letters[found.end] - letters[found.start], upper[found.end] - upper[found.start]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (found.row[1:] == found.row[:-1])
    twice = np.zeros(len(h), bool)
    twice[2:] = (h[2:] == h[:-2]) & (found.row[2:] == found.row[:-2])
    distinct, top = np.zeros(block.n), np.zeros(block.n)
    first = found.first
    for r in np.flatnonzero(n).tolist():
        own = np.sort(h[first[r] : first[r] + n[r]])
        change = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        distinct[r], top[r] = (len(change) - 1) / n[r] ** 0.8, np.diff(change).max() / n[r]
    last = raw[found.end - 1] if len(h) else raw[:0]
    head = raw[found.start] if len(h) else raw[:0]
    shape = [
        np.log1p(n), np.log1p(size), share(_UPPER[raw]), share(_DIGIT[raw]), share(_SPACE[raw]), share(_SENTENCE[raw]),
        share(_MARK[raw]), share(raw >= 128), np.sqrt(share(raw == 10)), np.log1p(W.sums(length, n) / words),
        per_word(length == 1), per_word(length >= 14), per_word(letters == 0), per_word(_MARK[last]), per_word(_UPPER[head]),
        per_word((upper >= 2) & (upper >= 0.6 * letters)), per_word(again), per_word(twice), distinct, top, n == 0,
    ]
    bag = np.bincount(found.row * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=block.n * HASHED)
    bag = np.sqrt(bag.reshape(block.n, HASHED) / words[:, None])
    return np.concatenate([np.stack(shape, axis=1), bag, np.ones((block.n, 1))], axis=1).astype(np.float32)


def _features(block: W.Block) -> list[pa.Array]:
    x = features(block)
    return [W.lists(x.ravel(), np.full(block.n, SIZE), pa.float32())]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id's text modulo ``parts``; null ids are in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, SIZE).astype(np.float64)


def _totals(rows: DataFrame, fn) -> np.ndarray:
    """Sum over all rows of the flat array ``fn(x, part)`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(_matrix(batch), batch.column("part").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.float64))], names=["i", "v"])

    got = rows.select("x", "part").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(got)])


def _gradients(weights: np.ndarray, centre: np.ndarray, spread: np.ndarray, parts: tuple[int, ...]):
    """Numbers and gradient sums: losses of positives as positive, as negative, of all as negative."""

    def run(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        z = (x - centre) / spread
        f = z @ weights
        up, down = -1 / (1 + np.exp(np.clip(f, -50, 50))), 1 / (1 + np.exp(np.clip(-f, -50, 50)))
        loss = np.logaddexp(0, f)
        p = np.isin(part, parts).astype(float)
        return np.concatenate([[p.sum(), len(f), (loss * p).sum(), loss.sum()], (up * p) @ z, (down * p) @ z, down @ z])

    return run


def fit(rows: DataFrame, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, centre and spread of the features, and the estimated class prior.

    ``part`` of a row is 0 without a trusted label, else 1 or 2. The prior is estimated with a first fit
    on part 1 and the scores of part 2, which that fit has not seen; the second fit uses both.
    """
    moments = _totals(rows, lambda x, p: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        return np.zeros(SIZE), np.zeros(SIZE), np.ones(SIZE), 0.5
    n, mean = moments[0], moments[1 : SIZE + 1] / moments[0]
    spread = np.sqrt(np.maximum(moments[SIZE + 1 :] / n - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    mean[-1], spread[-1] = 0.0, 1.0
    weights, prior = np.zeros(SIZE), 0.5
    for phase in range(2):
        m, v = np.zeros(SIZE), np.zeros(SIZE)
        for step in range(1, steps + 1):
            got = _totals(rows, _gradients(weights, mean, spread, (1,) if phase == 0 else (1, 2)))
            n_p, n_u = got[0], got[1]
            if not n_p:
                break
            g_pos, g_neg, g_all = (got[4 + i * SIZE : 4 + (i + 1) * SIZE] for i in range(3))
            rest = got[3] / n_u - prior * got[2] / n_p
            part = g_all / n_u - prior * g_neg / n_p
            grad = (prior * g_pos / n_p + part if rest >= 0 else -part) + DECAY * weights
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            rate = RATE * (1 - 0.9 * step / steps)
            weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if phase == 0 and n_p:
            prior = estimate_prior(rows, weights, mean, spread, prior)
    return weights, mean, spread, prior


def estimate_prior(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, otherwise: float) -> float:
    """Smallest ratio of the unlabelled to the positive share over regions above a score."""

    def counts(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-np.clip((x - mean) / spread @ weights, -50, 50)))
        at = np.minimum((s * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at[part == 2], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(float)

    got = _totals(rows, counts)
    p, u = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (got[:BINS], got[BINS:]))
    usable = p >= LEAST_SHARE
    if not usable.any():
        return otherwise
    return float(np.clip(np.min(u[usable] / p[usable], initial=1.0), 0.05, 0.98))


def quality(docs: DataFrame, labels: DataFrame, steps: int = STEPS, held: int = 1, parts: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels are read only of rows whose fold ``crc32(doc_id) mod parts`` is not ``held``. The score is
    between 0 and 1, higher where label 1 is likelier; ``predicted`` is 1 from 0.5 on.

    Null and empty texts are scored like any other, by the features of no words. A null doc_id has no
    label and is not held out. Several labels of one doc_id count as positive only if all are 1; rows
    repeating a doc_id share its label and are scored by their own text. Without positives all scores
    are 0.5. Other columns are ignored, whatever their names. No rows give no rows.
    """
    x = stage(add_from_text(docs, _features, [("x", "array<float>")], keep=["doc_id"]), "features")
    trusted = labels.where(fold(F.col("doc_id"), parts) != held).groupBy(F.col("doc_id").alias("_doc")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_q"))
    trusted = trusted.where("_q = 1").select("_doc")
    rows = x.join(trusted, x["doc_id"] == trusted["_doc"], "left")
    part = F.when(F.col("_doc").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("_doc"), F.lit(2))).cast("int")
    rows = rows.select("x", part.alias("part"))
    rows = stage(rows, "training-rows")
    weights, mean, spread, _ = fit(rows, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = (_matrix(batch) - mean) / spread @ weights
            score = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = x.mapInArrow(run, f"doc_id {kind}, score double")
    out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
