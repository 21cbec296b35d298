"""Repeated lines: windows of three consecutive lines, found globally, later occurrences removed.

One pass hashes the lines of each document and every three in a row (128 bits). Windows are counted
with map-side combining; the first occurrence of each repeated window is joined back to mark the later
ones, whose positions are merged per document into the lines to remove. Only window hashes are
shuffled for the search, text once for the removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import add_from_text, columns, fresh, map_batches, named
from sunweave.session import stage

LINES = 3

_SECOND = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def line_ranges(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line (newline excluded; an empty text is one empty line), and lines per row."""
    newline = np.flatnonzero(block.data == 10)
    row = np.searchsorted(block.offsets, newline, side="right") - 1
    count = 1 + np.bincount(row, minlength=block.n)
    rows = np.repeat(np.arange(block.n), count)
    head = np.zeros(len(rows), dtype=bool)
    head[np.cumsum(count) - count] = True
    start = np.empty(len(rows), dtype=np.int64)
    start[head], start[~head] = block.offsets[:-1], newline + 1
    end = np.empty_like(start)
    last = np.cumsum(count) - 1
    end[:-1] = start[1:] - 1
    end[last] = block.offsets[1:]
    return start, end, rows, count


def _windows(size: int):
    def run(block: W.Block) -> list[pa.Array]:
        start, end, rows, count = line_ranges(block)
        prefix = block.prefix()
        h = block.hash_ranges(start, end, prefix)
        whole = block.hash_ranges(block.offsets[:-1], block.offsets[1:], prefix)
        many = np.maximum(count - size + 1, 0)
        inside = rows[: max(len(h) - size + 1, 0)] == rows[size - 1 :] if len(h) >= size else np.zeros(0, bool)
        one = W.grams(h, size)[inside]
        two = W.grams(W.mix(h * _SECOND[0]), size)[inside]
        return [
            pa.array(whole.view(np.int64)), pa.array(count.astype(np.int64)),
            W.lists(one.view(np.int64), many, pa.int64()), W.lists(two.view(np.int64), many, pa.int64()),
        ]

    return run


def repeated_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``doc_id, text_hash, removed``: line numbers (from 0, ascending) to remove, of documents that have any.

    A document's ``text_hash`` tells rows apart that share a doc_id. Occurrences are ordered by doc_id
    (null last), text_hash and position; all but the first of each window are covered.
    """
    added = [("text_hash", "bigint"), ("n_lines", "bigint"), ("one", "array<bigint>"), ("two", "array<bigint>")]
    made = add_from_text(docs, _windows(size), added, keep=["doc_id"])
    seen = made.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("one", "two")).alias("pos", "w"))
    seen = stage(seen.select("doc_id", "text_hash", "pos", "w.one", "w.two"), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    first = seen.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    first = first.where("first != final").select("one", "two", "first")
    later = seen.join(first, ["one", "two"]).where(place != F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + size - 1))))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(covered).alias("removed"))


def without_lines(text: int, removed: int, keep: int):
    """Batches with the lines numbered in column ``removed`` cut from column ``text``; the first ``keep`` columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(text).to_pylist()
            for i, lines in enumerate(batch.column(removed).to_pylist()):
                if lines:
                    gone = set(lines)
                    out[i] = "\n".join(x for n, x in enumerate(out[i].split("\n")) if n not in gone)
            arrays = batch.columns
            arrays[text] = pa.array(out, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=[f"c{i}" for i in range(keep)])

    return run


def dedup_lines(docs: DataFrame, size: int = LINES) -> tuple[DataFrame, str, str]:
    """Rows of ``docs`` with repeated lines removed from ``text`` and two more columns, whose names follow.

    They are the number of lines before (long) and the line numbers removed (array, ascending; empty if
    none). Lines are split at newlines and compared with A-Z lower-cased. A window is ``size`` lines in
    a row within one document; of each window that occurs again, in the same document or another, all
    occurrences but the first by (doc_id, position) are removed, overlapping ones merged.

    A null text stays null and counts as one empty line; documents of fewer than ``size`` lines have no
    window and stay as they are. Null doc_ids come last. Rows equal in doc_id and text are the same
    document: they get the same result, and none is a later occurrence of the other. Names that clash
    are avoided. No rows give no rows.
    """
    text_hash, n_lines, removed = fresh(docs, "text_hash"), fresh(docs, "n_lines"), fresh(docs, "removed")
    found = repeated_lines(docs, size).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("removed").alias("_r"))

    def mark(block: W.Block) -> list[pa.Array]:
        whole = block.hash_ranges(block.offsets[:-1], block.offsets[1:])
        return [pa.array(whole.view(np.int64)), pa.array(line_ranges(block)[3].astype(np.int64))]

    marked = add_from_text(docs, mark, [(text_hash, "bigint"), (n_lines, "bigint")])
    found = found.withColumnsRenamed({"_d": fresh(marked, "d"), "_h": fresh(marked, "h"), "_r": removed})
    d, h = found.columns[0], found.columns[1]
    same = named("doc_id").eqNullSafe(named(d)) & (named(text_hash) == named(h))
    both = marked.join(found, same, "left")
    both = both.select(*columns(docs), named(n_lines), F.coalesce(named(removed), F.array().cast("array<int>")).alias(removed))
    names = both.columns
    cut = without_lines(names.index("text"), names.index(removed), len(names))
    return map_batches(both, cut, both.schema), n_lines, removed
