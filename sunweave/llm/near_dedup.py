"""Near-duplicate documents with SetSketch registers: band, estimate by likelihood, verify, cluster.

Registers are exponentially spaced truncated minima: register i of a set is
``clip(floor(1 - log_b(min_i)), 0, q + 1)`` where ``min_i`` is the smallest of independent
exponentially distributed hashes of the set's shingles. Registers of a union are element-wise
maxima, and two registers agree about as often as the sets are similar.

Steps: (1) one pass computes set identity, size and registers of each document; equal sets become
one class, so thousands of copies are one node. (2) Bands of registers put classes into buckets.
(3) Bucket members are compared with pivots, then those that links have not joined with each other
(``links.joined``); likelihood estimates drop pairs that are far from the threshold and full shingle
sets confirm the rest. (4) Components of the confirmed links.

Nothing is capped. ``bands`` x ``rows`` registers miss a pair exactly at
similarity 0.75 with probability (1 - 0.75^rows)^bands: 5e-6 with 32 bands of 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import fresh, named
from sunweave.llm.links import joined, shared_buckets
from sunweave.session import stage

SHINGLE = 5
#: Links need 100 * intersection >= SHARE * union.
SHARE = 75
BANDS, ROWS = 32, 4
#: Spacing, rate and largest value of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: A pair goes on to verification unless its estimate is this far below the threshold: over six
#: standard deviations of an estimate from 128 registers.
SLACK = 0.24

_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """m registers for each run of ``hashes`` that begins at ``start`` (no run is empty)."""
    low = np.empty((len(start), m), dtype=np.uint64)
    scratch = np.empty_like(hashes)
    for i in range(m):
        np.multiply(hashes, _SEEDS[0, i], out=scratch)
        scratch += _SEEDS[1, i]
        low[:, i] = np.minimum.reduceat(scratch, start)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    point = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(point) / np.log(BASE)), 0, LIMIT + 1).astype(">u2")


def shingle_sets(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes row by row in ascending order, and how many each row has."""
    return distinct_sets(block.words(W.NON_SPACE))


def distinct_sets(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, of words already found."""
    values, many = W.shingles(found, SHINGLE)
    borders = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        fresh[1:] = values[1:] != values[:-1]
        begin = borders[:-1][many > 0]
        fresh[begin] = True
    return values[fresh], W.sums(fresh.astype(np.int64), many)


def set_identity(values: np.ndarray, many: np.ndarray) -> pa.Array:
    """128-bit identity of each set: two independent sums over its members; null for empty sets."""
    one, two = W.sums(W.mix(values), many), W.sums(W.mix(values * np.uint64(0x9FB21C651E98DF25) + np.uint64(7)), many)
    ids = W.pack(one, two)
    return pa.compute.if_else(pa.array(many > 0), ids, pa.scalar(None, pa.binary()))


def _sketch(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for block in W.blocks(column):
                values, many = shingle_sets(block)
                regs = np.zeros((block.n, m), dtype=">u2")
                full = many > 0
                if full.any():
                    start = np.concatenate([[0], np.cumsum(many)[:-1]])[full]
                    regs[full] = registers(values, start, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n),
                        set_identity(values, many),
                        pa.array(many.astype(np.int64)),
                        W.binary(regs.view(np.uint8).reshape(block.n, 2 * m)),
                    ],
                    names=["doc_id", "set_id", "n_shingles", "regs"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(0)):
            values, many = shingle_sets(block)
            yield pa.RecordBatch.from_arrays(
                [set_identity(values, many), W.lists(values.view(np.int64), many, pa.int64())],
                names=["set_id", "shingles"],
            )


def _share(x: np.ndarray) -> np.ndarray:
    """p_b(x) of the register model: -log_b(1 - x (b - 1) / b)."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood given how many registers of a are larger or smaller.

    The log-likelihood is concave in the similarity, so a ternary search over [0, n_min / n_max] finds it.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = m - more - less

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _share(np.maximum(u - v * j, 0)), _share(np.maximum(v - u * j, 0))
        parts = ((more, up), (less, down), (same, 1 - up - down))
        return sum(np.where(n > 0, n * np.log(np.maximum(p, 1e-12)), 0.0) for n, p in parts)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate comes near the threshold and whose full sets reach it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column
        a, b = (np.frombuffer(b"".join(col(c).to_pylist()), dtype=">u2").reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
        n_a, n_b = col("n_a").to_numpy(), col("n_b").to_numpy()
        near = estimate((a > b).sum(1), (a < b).sum(1), a.shape[1], n_a.astype(float), n_b.astype(float)) >= SHARE / 100 - SLACK
        flat = [col(c).flatten().to_numpy() for c in ("s_a", "s_b")]
        ends = [np.cumsum(n) for n in (n_a, n_b)]
        good = np.zeros(batch.num_rows, dtype=bool)
        for i in np.flatnonzero(near).tolist():
            x, y = (f[e[i] - n[i] : e[i]] for f, e, n in zip(flat, ends, (n_a, n_b)))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good[i] = 100 * shared >= SHARE * (len(x) + len(y) - shared)
        yield pa.RecordBatch.from_arrays([col("a"), col("b")], names=["a", "b"]).filter(pa.array(good))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, set_id, n_shingles, regs`` of every row; set_id is null where there are no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _sketch(bands * rows), f"doc_id {kind}, set_id binary, n_shingles long, regs binary"
    )


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, shingles`` of the classes in ``ids``, from the text of one document of each."""
    wanted = classes.join(ids, classes["set_id"] == ids["id"]).select("set_id", "rep")
    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "set_id binary, shingles array<bigint>")
    sets = sets.join(wanted.select("set_id"), "set_id", "left_semi")
    return sets.groupBy(F.col("set_id").alias("id")).agg(F.first("shingles").alias("shingles"))


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ids whose full shingle sets reach the threshold."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(_verify, "a binary, b binary")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * shared >= 75 * all of their distinct 5-word shingles (words split
    at white space, A-Z lower-cased; fewer than five words: the whole sequence). ``component_id`` is
    the smallest doc_id reachable over links, ``kept`` tells that it is the document's own.

    Null, empty and wordless texts have no shingles and stand alone. A null doc_id is never the
    smallest while another exists; a component of null ids has a null component_id and all of it is
    kept. Rows that repeat a doc_id are judged by their own text and may be in different components.
    Other columns are ignored, whatever their names. No rows give no rows.
    """
    sk = stage(sketch(docs, bands, rows), "sketches")
    classes = sk.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs")
    )
    classes = stage(classes, "classes")
    width = 2 * rows
    keys = F.expr(f"explode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(regs, i * {width} + 1, {width}))))")
    buckets = classes.select(F.col("set_id").alias("id"), "n", keys.alias("bucket"))
    members = stage(shared_buckets(buckets).select("bucket", "id", "n"), "buckets")
    sets = sets_of(docs, classes, members.select("id").distinct()).join(classes.select(F.col("set_id").alias("id"), "regs"), "id")
    sets = stage(sets, "sets")
    found = joined(members, sets, SHARE, lambda pairs: confirm(sets, pairs))
    lowest = found.join(classes.select(F.col("set_id").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("low"))
    ids = found.join(lowest, "root").select(F.col("node").alias("set_id"), "low")
    ids = classes.select("set_id", "rep").join(ids, "set_id", "left").select("set_id", F.coalesce("low", "rep").alias("low"))
    out = sk.select("doc_id", "set_id", "n_shingles").join(ids, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document per component stays (see ``near_duplicates``).

    A document is a doc_id with its text: rows that share a doc_id, or have none, but differ in text are judged
    apart. The least doc_id stays, null ones last, then the least text hash. Rows equal in both are one document
    and stay or go together. No rows give no rows.
    """
    id_, text = named("doc_id"), named("text")
    identity = F.struct(id_.isNull().alias("last"), id_.alias("id"), F.xxhash64(text).alias("hash"))
    apart = near_duplicates(docs.select(identity.alias("doc_id"), text.alias("text")))
    kept = apart.where("kept").select(F.col("doc_id.id").alias(fresh(docs, "kept_id")), F.col("doc_id.hash").alias(fresh(docs, "kept_hash"))).distinct()
    kept_id, kept_hash = (named(c) for c in kept.columns)
    return docs.join(kept, id_.eqNullSafe(kept_id) & (F.xxhash64(text) == kept_hash), "left_semi")
