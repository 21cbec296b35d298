"""Repeated passages: paragraph MinHash, banded, verified by exact Jaccard, removed by component.

A paragraph is a line. Paragraphs with the same set of 5-word shingles are one class; classes are put
into buckets by bands of MinHash values and linked where their full shingle sets reach the threshold.
Components of links are clusters, of which the first paragraph in (doc_id, position) stays. What is
reported and removed are runs of neighbouring repeated paragraphs with at least MIN_WORDS words: a
stray short line that many documents share is no passage.

Verbatim runs do not depend on lines: a run is a stretch of words covered by WINDOW-word windows that
occur at more than one place. Anchors are the smallest hashes of GRAM-word grams within every WINDOW
words, so equal windows hold equal anchors. Only windows around anchors that occur twice are hashed and
counted; each is a key of its own, hence no pairs of places are made and every run ends at its exact word.
Equal texts are one text until the end.

Ten bands of two values miss a pair exactly at similarity 0.75 with probability 2.6e-4, at 0.8 with
3.6e-5, at 0.9 with 6e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import add_from_text, columns, fresh, map_batches, named
from sunweave.llm.line_dedup import line_ranges
from sunweave.llm.links import joined, shared_buckets
from sunweave.llm.near_dedup import SHARE, SHINGLE, distinct_sets, set_identity
from sunweave.session import stage

BANDS, ROWS = 10, 2
#: Words of the shortest run that counts as a passage: what similarity 0.75 leaves of 50 and more.
MIN_WORDS = 40
#: Words of a window of a verbatim run, and of the grams that anchors are chosen from.
WINDOW, GRAM = 50, 25
#: Grams in a window.
SPAN = WINDOW - GRAM + 1

_SEEDS = np.random.default_rng(78).integers(1, 1 << 63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def paragraphs(block: W.Block) -> tuple[W.Block, np.ndarray, np.ndarray]:
    """The block with one row per line, and the text row and line number of each."""
    start, end, rows, count = line_ranges(block)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    borders = np.concatenate([start, [len(block.data)]])
    return W.Block(block.first, len(rows), block.data, borders), rows, number


def minima(hashes: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """m MinHash values for each run of ``hashes`` that begins at ``start``."""
    low = np.empty((len(start), m), dtype=np.uint64)
    scratch = np.empty_like(hashes)
    for i in range(m):
        np.multiply(hashes, _SEEDS[0, i], out=scratch)
        scratch += _SEEDS[1, i]
        low[:, i] = np.minimum.reduceat(scratch, start)
    return low


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                lines, row, number = paragraphs(block)
                found = lines.words(W.NON_SPACE)
                values, many = distinct_sets(found)
                whole = block.hash_ranges(block.offsets[:-1], block.offsets[1:])
                full = np.flatnonzero(many > 0)
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                if len(full):
                    low = minima(values, (np.cumsum(many) - many)[full], bands * rows)
                    for b in range(bands):
                        keys[:, b] = W.grams(low[:, b * rows : (b + 1) * rows].ravel(), rows)[::rows] * np.uint64(2 * b + 3)
                ids = set_identity(values, many).take(pa.array(full))
                first = batch.column(0).slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        first.take(pa.array(row[full])), pa.array(whole.view(np.int64)[row[full]]), pa.array(number[full].astype(np.int32)),
                        pa.array(found.count[full].astype(np.int32)), ids, pa.array(many[full].astype(np.int64)),
                        W.lists(W.mix(keys.ravel()).view(np.int64), np.full(len(full), bands), pa.int64()),
                    ],
                    names=["doc_id", "text_hash", "line", "words", "set_id", "n", "keys"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(0)):
            lines, row, number = paragraphs(block)
            values, many = distinct_sets(lines.words(W.NON_SPACE))
            whole = block.hash_ranges(block.offsets[:-1], block.offsets[1:])
            wanted = batch.column(1).slice(block.first, block.n).to_pylist()
            chosen = np.zeros(len(row), dtype=bool)
            begin = np.searchsorted(row, np.arange(block.n))
            for r, spots in enumerate(wanted):
                mine = [s["line"] for s in spots if s["text_hash"] == int(whole.view(np.int64)[r])]
                chosen[begin[r] + np.array(mine, dtype=np.int64)] = True
            member = np.repeat(chosen, many)
            ids = set_identity(values, many).filter(pa.array(chosen))
            yield pa.RecordBatch.from_arrays(
                [ids, W.lists(values[member].view(np.int64), many[chosen], pa.int64())], names=["id", "shingles"]
            )


def repeated_paragraphs(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """All paragraphs of ``docs`` with words: ``doc_id, text_hash, line, words, cluster, first, copies``.

    ``cluster`` is null for a paragraph that occurs once; ``first`` is the place (doc_id, text_hash, line)
    of its cluster's first member, ``copies`` the number of its members.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(
        _sketch(bands, rows),
        f"doc_id {kind}, text_hash bigint, line int, words int, set_id binary, n bigint, keys array<bigint>",
    )
    made = stage(made, "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line")
    classes = made.groupBy(F.col("set_id").alias("id")).agg(
        F.min(place).alias("place"), F.max(place).alias("final"), F.max("n").alias("n"), F.max("keys").alias("keys"), F.count("*").alias("size")
    )
    classes = stage(classes, "paragraph-classes")
    buckets = classes.select("id", "n", F.explode("keys").alias("bucket"))
    members = stage(shared_buckets(buckets).select("bucket", "id", "n"), "paragraph-buckets")

    spots = classes.join(members.select("id").distinct(), "id", "left_semi")
    spots = spots.select(F.col("place.doc_id").alias("_doc"), F.struct("place.text_hash", "place.line").alias("s"))
    spots = spots.groupBy("_doc").agg(F.collect_list("s").alias("spots"))
    texts = docs.select("doc_id", "text").join(spots, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "spots")
    sets = texts.mapInArrow(_sets, "id binary, shingles array<bigint>").groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = stage(sets, "paragraph-sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
        shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        return both.where(100 * shared >= SHARE * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")

    found = joined(members, sets, SHARE, confirm)
    at = classes.select("id", "place", "final", "size").join(found.withColumnRenamed("node", "id"), "id", "left")
    at = at.select("id", "place", "final", "size", F.coalesce("root", "id").alias("cluster"))
    clusters = at.groupBy("cluster").agg(F.min("place").alias("first"), F.max("final").alias("final"), F.sum("size").alias("copies"))
    clusters = clusters.where("first != final").drop("final")
    named_ids = stage(at.select("id", "cluster").join(clusters, "cluster"), "paragraph-clusters")
    out = made.select("doc_id", "text_hash", "line", "words", F.col("set_id").alias("id"))
    return out.join(named_ids, "id", "left").select("doc_id", "text_hash", "line", "words", "cluster", "first", "copies")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Paragraphs within repeated passages: one row each, of documents that hold any.

    Columns: ``doc_id, text_hash, line`` (number from 0), ``words, first_doc_id, first_line`` (of the
    cluster's first member), ``copies`` (members), ``removed`` (not the first). A passage is a run of
    repeated paragraphs with no other paragraph in between and at least ``min_words`` words in all.
    Paragraphs are similar at Jaccard 0.75 or more of their 5-word shingles (words split at white
    space, A-Z lower-cased; fewer than five words: the whole sequence); clusters are components.

    Null and empty texts and blank lines have no paragraphs. ``text_hash`` tells rows apart that share a
    doc_id; rows equal in both are one document, whose paragraphs are listed once. Null doc_ids come
    last in order. Other columns are ignored, whatever their names. No rows give no rows.
    """
    # Rows that repeat share a document, so the window below finds them where it needs them.
    marked = repeated_paragraphs(docs, bands, rows).repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "line"])
    order = Window.partitionBy("doc_id", "text_hash").orderBy("line")
    unique = F.col("cluster").isNull().cast("int")
    runs = marked.withColumn("run", F.sum(unique).over(order)).where("cluster is not null")
    total = F.sum("words").over(Window.partitionBy("doc_id", "text_hash", "run"))
    runs = runs.withColumn("total", total).where(F.col("total") >= min_words)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line")
    return runs.select(
        "doc_id", "text_hash", "line", "words", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line").alias("first_line"), "copies", (F.col("first") != own).alias("removed"),
    )


def slide(values: np.ndarray, n: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every n consecutive values; there are at least n."""
    size = 1
    while 2 * size <= n:
        values = of(values[:-size], values[size:])
        size *= 2
    return of(values[: len(values) - n + size], values[n - size :])


def anchors(found: W.Words, g: np.ndarray) -> np.ndarray:
    """Word index of the grams in ``g`` that are the smallest (ties: all) of a window within one row."""
    n = len(g) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = found.row[:n] == found.row[WINDOW - 1 :]
    low = np.where(whole, slide(g, SPAN, np.minimum), np.uint64(0))
    edge = np.zeros(SPAN - 1, np.uint64)
    best = slide(np.concatenate([edge, low, edge]), SPAN, np.maximum)
    return np.flatnonzero((best == g) & (best > 0))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(2)):
            found = block.words(W.NON_SPACE)
            g = W.grams(found.hashes(), GRAM)
            at = anchors(found, g)
            row, h = found.row[at], g[at]
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(h)))
            row, h = row[new], h[new]
            count, twice = np.bincount(row, minlength=block.n), np.bincount(row[many > 1], minlength=block.n)
            long = found.count >= WINDOW
            part = batch.slice(block.first, block.n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(long)), part.column(1).filter(pa.array(long)), pa.array(found.count[long].astype(np.int32)),
                 W.lists(h.view(np.int64), count[long], pa.int64()), W.lists(h[many > 1].view(np.int64), twice[long], pa.int64())],
                names=["doc_id", "key", "n", "anchors", "twice"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(3)):
            part = batch.slice(block.first, block.n)
            found = block.words(W.NON_SPACE)
            g = W.grams(found.hashes(), GRAM)
            at = anchors(found, g)
            # An anchor shared in one row is shared wherever it stands.
            wanted = part.column(4).flatten().to_numpy(zero_copy_only=False)
            at = at[np.isin(g[at].view(np.int64), wanted)]
            marks = np.zeros(len(found.row) + 1, np.int64)
            np.add.at(marks, np.maximum(at - (SPAN - 1), 0), 1)
            np.add.at(marks, at + 1, -1)
            start = np.flatnonzero(np.cumsum(marks)[:-1])
            start = start[start + WINDOW <= len(found.row)]
            start = start[found.row[start] == found.row[start + WINDOW - 1]]
            row = found.row[start]
            h = W.mix(g[start] * np.uint64(3) + W.mix(g[start + WINDOW - GRAM]))
            ends = np.concatenate([[0], np.cumsum(block.data == 10)])
            line = ends[found.start[start]] - ends[block.offsets[row]]
            count = np.bincount(row, minlength=block.n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), W.lists(h.view(np.int64), count, pa.int64()),
                 W.lists((start - found.first[row]).astype(np.int32), count, pa.int32()), W.lists(line.astype(np.int32), count, pa.int32())],
                names=["doc_id", "key", "size", "h", "start", "line"],
            )


def verbatim_runs(docs: DataFrame) -> DataFrame:
    """Runs of words in windows of WINDOW words that occur more than once, wherever lines break.

    Columns: ``doc_id, key`` (xxhash64 of the text), ``line`` (in which the run starts), ``start, end`` (word
    numbers from 0, end exclusive), ``first_doc_id, first_line, first_start`` (where its first window occurs
    first, in order of doc_id, text and position), ``copies`` (most places of one of its windows), ``removed``
    (those are other places). A run is a longest stretch of consecutive windows that agree in ``removed``
    and in the document of the first place; neighbouring runs may overlap. A text that equals an earlier
    one is one run. Words are split at white space, A-Z lower-cased.

    Null, empty and short texts have no runs. Rows equal in doc_id and text are one document; null
    doc_ids come last. A text that repeats itself keeps one period. No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where("text is not null")
    made = stage(rows.mapInArrow(_anchors, f"doc_id {kind}, key bigint, n int, anchors array<bigint>, twice array<bigint>"), "anchors")
    held = made.select("doc_id", "key", "n").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    texts = held.groupBy("key").agg(F.min(order).alias("place"), F.max("n").alias("n"), F.count("*").alias("size"))
    texts = stage(texts.select("key", "place.doc_id", "n", "size"), "run-texts")

    each = made.select("key", F.explode("anchors").alias("anchor"))
    among = each.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("anchor")
    shared = among.union(made.select(F.explode("twice").alias("anchor"))).distinct()
    wanted = each.join(shared, "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stage(texts.join(wanted, "key").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "size", "anchors"), "run-anchors")
    near = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    near = near.select("doc_id", "key", "size", "text", "anchors")
    near = near.mapInArrow(_windows, f"doc_id {kind}, key bigint, size bigint, h array<bigint>, start array<int>, line array<int>")
    near = stage(near.dropDuplicates(["key"]), "run-windows")
    windows = F.explode(F.arrays_zip("h", "start", "line")).alias("w")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "w.start", "w.line")
    found = near.select("doc_id", "key", "size", windows).groupBy("w.h").agg(F.min(place).alias("first"), F.sum("size").alias("copies"), F.count("*").alias("places"))
    found = found.where("places > 1").select("h", F.col("first.key").alias("from"), F.col("first.start").alias("first_start"), F.col("first.line").alias("first_line"), "copies")
    # Rows of windows carry numbers only; texts give the documents of the few runs that are left.
    hits = near.select("key", windows).select("key", "w.*").join(stage(found, "run-places"), "h").drop("h")
    hits = hits.withColumn("removed", (F.col("from") != F.col("key")) | (F.col("first_start") != F.col("start")))
    alike = Window.partitionBy("key", "removed", "from").orderBy("start")
    hits = hits.withColumn("chain", F.col("start") - F.row_number().over(alike))
    runs = hits.groupBy("key", "removed", "from", "chain").agg(
        F.min("start").alias("start"), (F.max("start") + WINDOW).alias("end"), F.min_by("line", "start").alias("line"),
        F.min_by("first_line", "start").alias("first_line"), F.min_by("first_start", "start").alias("first_start"), F.max("copies").alias("copies"),
    )
    out = ["doc_id", "key", "line", "start", "end", "first_doc_id", "first_line", "first_start", "copies", "removed"]
    runs = runs.join(texts.select("key", "doc_id"), "key").join(texts.select(F.col("key").alias("from"), F.col("doc_id").alias("first_doc_id")), "from")
    same = texts.where("size > 1").select("key", F.col("doc_id").alias("first_doc_id"), "size")
    zero = F.lit(0)
    whole = held.join(same, "key").select(
        "doc_id", "key", zero.alias("line"), zero.alias("start"), F.col("n").alias("end"), "first_doc_id", zero.alias("first_line"),
        zero.alias("first_start"), F.col("size").alias("copies"), (~F.col("doc_id").eqNullSafe(F.col("first_doc_id"))).alias("removed"),
    )
    return runs.select(*out).unionByName(whole.select(*out))


def _cut(text: int, lines: int, runs: int, keep: int):
    """Batches with ``text`` rewritten without the lines and word ranges listed in two other columns."""

    def one(given: str, gone: list[int], ranges: list[dict]) -> str:
        data = given.encode()
        block = W.Block(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        found = block.words(W.NON_SPACE)
        out = np.zeros(len(data) + 1, np.int64)
        for r in ranges:
            # The white space behind a run goes with it.
            out[found.start[r["start"]]] += 1
            out[found.start[r["end"]] if r["end"] < len(found.start) else len(data)] -= 1
        out = np.cumsum(out)[:-1] > 0
        kept, at = [], 0
        for i, x in enumerate(data.split(b"\n")):
            left = np.frombuffer(x, np.uint8)[~out[at : at + len(x)]].tobytes()
            if i not in gone and (left.strip(b" \t\r\v\f") or len(left) == len(x)):
                kept.append(left)
            at += len(x) + 1
        return b"\n".join(kept).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, gone, ranges = (batch.column(c).to_pylist() for c in (text, lines, runs))
            new = [one(t, set(g or ()), r or []) if t and (g or r) else t for t, g, r in zip(given, gone, ranges)]
            cols = [pa.array(new, batch.column(c).type) if c == text else batch.column(c) for c in range(keep)]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(keep)])

    return run


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages and runs cut from ``text`` but at their first place.

    A line whose words all lie in cut runs goes with its line break.
    """
    gone = repeated_passages(docs, min_words).where("removed").groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("lines"))
    ranges = verbatim_runs(docs).where("removed").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    names = [fresh(docs, x) for x in ("cut_doc", "cut_hash", "cut_lines")]
    more = [fresh(docs, x) for x in ("run_doc", "run_key", "run_ranges")]
    gone, ranges = gone.toDF(*names), ranges.toDF(*more)
    mark = fresh(docs, "own_hash")
    own = add_from_text(docs, lambda b: [pa.array(b.hash_ranges(b.offsets[:-1], b.offsets[1:]).view(np.int64))], [(mark, "bigint")])
    same = named("doc_id").eqNullSafe(named(names[0])) & (named(mark) == named(names[1]))
    equal = named("doc_id").eqNullSafe(named(more[0])) & (F.xxhash64(named("text")) == named(more[1]))
    both = own.join(gone, same, "left").join(ranges, equal, "left").select(*columns(docs), named(names[2]), named(more[2]))
    n = len(docs.columns)
    return map_batches(both, _cut(docs.columns.index("text"), n, n + 1, n), docs.schema)
