"""Phrase collocations per language by direct-address tiling of frequency-ranked ids.

Level 1 counts words, level m phrases of m words as pairs of overlapping phrases of m - 1 words, so one
recursion serves all lengths: the frequent phrases of a level are ranked by frequency over all languages, the
rank becomes the id, and the next level counts pairs of ids. A phrase of at least ``least`` occurrences has only
such parts, so a pair is counted only where both ids exist.

A task cuts the pairs of its partition into tiles of 1024 x 1024 ids. The most frequent ids have the smallest
numbers, hence few tiles hold most pairs: tiles that fill up are counted with a dense ``bincount`` (8 MB each,
at most ``DENSE``), all others as sorted coordinates with counts. Spark adds the counts of the tasks by pair.

The ``HEAD`` most frequent phrases of a level have ids that every task holds (16 MB of hashes for words, 8 MB of
pairs above). Others are the tail: a bitmap of at most 8 MB says which phrases may belong to it, and what it lets
through is counted by its text. So the size of the vocabulary changes which way a phrase is counted and never
its count. Words are told apart by 128 bits where they are looked up, and by their text where they are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import add_from_text, checked_broadcast, named
from sunweave.session import stage

LEAST, LONGEST, FIRST = 30, 4, 2000
#: A candidate falls if a longer one that holds it has at least this share of its count, in hundredths.
INSIDE = 80
HEAD = 1 << 20
TILE_BITS, DENSE = 10, 8
#: Pairs settled together, and coordinates kept before they are handed on.
SETTLE = 1 << 21
MOST_BITS = 1 << 26
#: Bytes of text worked on at once; longer texts are cut between words, with as many words of overlap as a phrase needs.
BYTES = 1 << 21

_U = np.uint64
BREAK = W.byte_class((10, 13))
BREAK[list(b".,;:!?")] = True
IN_WORD = ~(BREAK | W.byte_class((9, 9), (32, 32)))
_OTHER = np.random.default_rng(20250311).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = np.random.default_rng(41).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * _U(2) + _U(1)


class Direct:
    """Position of 64-bit keys in a fixed array, found through a direct-address table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = _U((1 << max(4, int(4 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        place = self._home(keys)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            lost = self.slots[place] != left
            left, place = left[lost], ((place[lost] + _U(1)) & self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15) >> _U(20)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            slot = self.slots[place]
            used = slot >= 0
            left, place, slot = left[used], place[used], slot[used]
            same = self.keys[slot] == keys[left]
            out[left[same]] = slot[same]
            left, place = left[~same], (place[~same] + _U(1)) & self.mask
        return out


@dataclass
class Level:
    """What a task knows of the frequent phrases of one length.

    ``keys`` of the head: hashes of words with ``second`` to confirm them, or pairs of ids of the level
    below; ``ids`` their ranks; ``tail`` a bitmap over phrase hashes of the others, None if there are none.
    """

    keys: np.ndarray
    ids: np.ndarray
    second: np.ndarray | None
    tail: np.ndarray | None

    def prepare(self) -> Level:
        self.direct = Direct(self.keys)
        return self

    def maybe(self, h: np.ndarray) -> np.ndarray:
        if self.tail is None:
            return np.zeros(len(h), dtype=bool)
        bit = h & _U(64 * len(self.tail) - 1)
        return (self.tail[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1


def language_keys(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], dtype=np.uint64)


def word_keys(block: W.Block, found: W.Words, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word and its language; ``lang`` holds a key for each row."""
    first = found.hashes()
    prefix = np.zeros(len(block.data) + 1, dtype=np.uint64)
    np.cumsum(_OTHER[block.data] * W._POWERS.up[: len(block.data)], out=prefix[1:])
    second = (prefix[found.end] - prefix[found.start]) * W._POWERS.down[found.start]
    own = lang[found.row]
    return W.mix(first + own), W.mix(second ^ own)


def phrase_hash(keys: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` words that start at each position (the last m - 1 positions have none)."""
    n = max(len(keys) - m + 1, 0)
    return W.mix(sum((keys[j : j + n] * _STEP[j] for j in range(m)), np.zeros(n, dtype=np.uint64)) + _U(m))


def _runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


class Tiles:
    """Counts of pairs of ids: dense tiles for the crowded ones, sorted coordinates for the rest."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.n = 0
        self.dense: dict[int, np.ndarray] = {}
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.n += len(codes)

    @staticmethod
    def tile(codes: np.ndarray) -> np.ndarray:
        bits = _U(TILE_BITS)
        return ((codes >> (_U(32) + bits)) << _U(32)) | ((codes & _U(0xFFFFFFFF)) >> bits)

    @staticmethod
    def cell(codes: np.ndarray) -> np.ndarray:
        low = _U((1 << TILE_BITS) - 1)
        return ((((codes >> _U(32)) & low) << _U(TILE_BITS)) | (codes & low)).astype(np.int64)

    def settle(self) -> None:
        """Count what waits."""
        codes = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        self.waiting, self.n = [], 0
        order = np.argsort(tiles := self.tile(codes), kind="stable") if len(codes) else np.zeros(0, np.int64)
        codes, tiles = codes[order], tiles[order] if len(codes) else codes
        begin = _runs(tiles)
        end = np.append(begin[1:], len(tiles))
        sparse = np.ones(len(codes), dtype=bool)
        cells = 1 << (2 * TILE_BITS)
        for k in np.argsort(begin - end, kind="stable")[: 4 * DENSE].tolist():
            tile, a, b = int(tiles[begin[k]]), begin[k], end[k]
            if tile not in self.dense:
                if b - a < cells >> 4 or len(self.dense) >= DENSE:
                    continue
                self.dense[tile] = np.zeros(cells, dtype=np.int64)
            self.dense[tile] += np.bincount(self.cell(codes[a:b]), minlength=cells)
            sparse[a:b] = False
        rest = np.sort(codes[sparse])
        begin = _runs(rest)
        self._merge(rest[begin], np.diff(np.append(begin, len(rest))))

    def _merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        codes, counts = np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        begin = _runs(codes)
        self.codes, self.counts = codes[begin], np.add.reduceat(counts, begin) if len(begin) else counts

    def hand_on(self, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Coordinates with counts, once there are many; at the end those of the dense tiles too."""
        if every or len(self.codes) >= SETTLE:
            yield self.codes, self.counts
            self.codes, self.counts = self.codes[:0], self.counts[:0]
        if every:
            for tile, counts in self.dense.items():
                at = np.flatnonzero(counts)
                row = _U((tile >> 32) << TILE_BITS) + (at >> TILE_BITS).astype(np.uint64)
                column = _U((tile & 0xFFFFFFFF) << TILE_BITS) + (at & ((1 << TILE_BITS) - 1)).astype(np.uint64)
                yield (row << _U(32)) | column, counts[at]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a string column."""
    size = end - start
    borders = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(borders[-1]) + np.repeat(start - borders[:-1], size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def _texts(block: W.Block, found: W.Words, at: np.ndarray, m: int) -> pa.Array:
    """The ``m`` words from each position, with one space between."""
    if m == 1:
        return _strings(block.data, found.start[at], found.end[at])
    raw = block.data.tobytes()
    spans = [range(i, i + m) for i in at.tolist()]
    return pa.array([b" ".join(raw[found.start[j] : found.end[j]] for j in span).decode() for span in spans], pa.string())


def statuses(levels: list[Level], first: np.ndarray, second: np.ndarray, together: np.ndarray):
    """What the phrase of ``len(levels)`` words at each position is: its id, -2 for perhaps in the tail, or -1.

    ``together[i]``: words i and i + 1 stand in one piece.
    """
    at = levels[0].direct.find(first)
    known = at >= 0
    known[known] = levels[0].second[at[known]] == second[known]
    now = np.where(known, levels[0].ids[np.maximum(at, 0)] if len(levels[0].ids) else -1, np.where(levels[0].maybe(first), -2, -1))
    for m, level in enumerate(levels[1:], start=2):
        left, right = now[:-1], now[1:]
        live = (left != -1) & (right != -1) & together[: len(left)]
        both = np.flatnonzero(live & (left >= 0) & (right >= 0))
        out = np.full(len(left), -1, dtype=np.int64)
        if level.tail is not None:
            h = phrase_hash(first, m)
            out[: len(h)][level.maybe(h) & live[: len(h)]] = -2
        at = level.direct.find((left[both].astype(np.uint64) << _U(32)) | right[both].astype(np.uint64))
        out[both[at >= 0]] = level.ids[at[at >= 0]]
        now = out
    return now


_SCHEMA = "code bigint, lang string, phrase string, n bigint"


def _counter(levels: list[Level], limit: int):
    """Counts, over a partition, of phrases one word longer than the known levels: by pair of ids, or by text."""
    m = len(levels) + 1

    def by_code(tiles: Tiles, every: bool = False) -> Iterator[pa.RecordBatch]:
        for codes, counts in tiles.hand_on(every):
            for i in range(0, len(codes), 1 << 18):
                c, n = codes[i : i + (1 << 18)], counts[i : i + (1 << 18)]
                none = pa.nulls(len(c), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), none, none, pa.array(n)], names=["code", "lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for level in levels:
            level.prepare()
        for batch in batches:
            langs = batch.column(1).fill_null("und").dictionary_encode()
            names, of_row = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            keys = language_keys(names.to_pylist())
            for block, found, _ in W.parts(batch.column(0), IN_WORD, m - 1, limit):
                if len(found.start) < m:
                    continue
                own = of_row[block.first : block.first + block.n]
                first, second = word_keys(block, found, keys[own])
                if m == 1:
                    at = np.arange(len(first))
                    h = first
                else:
                    piece = np.cumsum(BREAK[block.data], dtype=np.int32)[found.start]
                    together = (piece[1:] == piece[:-1]) & (found.row[1:] == found.row[:-1])
                    now = statuses(levels, first, second, together)
                    live = (now[:-1] != -1) & (now[1:] != -1) & together[: len(now) - 1]
                    pairs = live & (now[:-1] >= 0) & (now[1:] >= 0)
                    x, y = now[:-1][pairs], now[1:][pairs]
                    tiles.add((x.astype(np.uint64) << _U(32)) | y.astype(np.uint64))
                    if tiles.n >= SETTLE:
                        tiles.settle()
                        yield from by_code(tiles)
                    at = np.flatnonzero(live & ~pairs)
                    h = phrase_hash(first, m)[at] if len(at) else first[:0]
                if len(at):
                    order = np.argsort(h, kind="stable")
                    # The text of the first of a run stands for the run: confirmed by the second hash of each word.
                    same = h[order][1:] == h[order][:-1]
                    for j in range(m):
                        word = second[at[order] + j]
                        same &= word[1:] == word[:-1]
                    begin = np.flatnonzero(np.concatenate([[True], ~same]))
                    n = np.diff(np.append(begin, len(at)))
                    one = at[order[begin]]
                    lang = names.take(pa.array(own[found.row[one]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(one), pa.int64()), lang, _texts(block, found, one, m), pa.array(n)], names=["code", "lang", "phrase", "n"]
                    )
        tiles.settle()
        yield from by_code(tiles, every=True)

    return run


def counted(texts: DataFrame, levels: list[Level], limit: int = BYTES) -> DataFrame:
    """``code, lang, phrase, n``: occurrences of phrases one word longer than ``levels``, named by code or by text."""
    keys = ["code", "lang", "phrase"]
    out = texts.mapInArrow(_counter(levels, limit), _SCHEMA)
    if not levels:
        keys = ["lang", "phrase"]
    elif all(level.tail is None for level in levels):
        keys = ["code"]
    out = out.groupBy(*keys).agg(F.sum("n").alias("n"))
    return out.select(*[F.col(c) if c in keys else F.lit(None).cast("bigint" if c == "code" else "string").alias(c) for c in ("code", "lang", "phrase")], "n")


def ranked(frequent: DataFrame) -> DataFrame:
    """``frequent`` with ``id``: its rank by n descending. One range sort; the offsets are one row per partition."""
    order = [F.col("n").desc(), "lang", "phrase"]
    rows = frequent.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("part", F.shiftright("at", 33)), "ranked")
    offset, offsets = 0, []
    for r in sorted(rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect(), key=lambda r: r.part):
        offsets.append((r.part, offset - r.low))
        offset += r.n
    shifts = rows.sparkSession.createDataFrame(offsets, "part bigint, shift bigint")
    return rows.join(F.broadcast(shifts), "part").select(*frequent.columns, (F.col("at") + F.col("shift")).alias("id"))


def _hashes(m: int):
    """Columns first, second (of the first word) and h (of the phrase) for a table of phrases with their language."""

    def run(block: W.Block, lang: pa.Array) -> list[pa.Array]:
        found = block.words(IN_WORD)
        codes = lang.dictionary_encode()
        own = language_keys(codes.dictionary.to_pylist())[codes.indices.to_numpy(zero_copy_only=False)]
        first, second = word_keys(block, found, own)
        at = found.first
        whole = phrase_hash(first, m)[at] if m > 1 else first[at]
        return [pa.array(x.view(np.int64)) for x in (first[at], second[at], whole)]

    return run


def level_of(table: DataFrame, m: int, head: int) -> Level:
    """What tasks have to know of a ranked table ``lang, phrase, n, code, id``: the head, and a bitmap of the tail."""
    in_head = (F.col("id") < head) & (F.lit(True) if m == 1 else F.col("code").isNotNull())
    with_hash = lambda rows: add_from_text(rows, _hashes(m), [("first", "bigint"), ("second", "bigint"), ("h", "bigint")], keep=["code", "id"], text="phrase", also=["lang"])
    got = (with_hash(table.where(in_head)) if m == 1 else table.where(in_head).select(F.col("code").alias("first"), F.lit(0).cast("bigint").alias("second"), "id")).select("first", "second", "id").toArrow()
    keys, second, ids = (got.column(c).combine_chunks().to_numpy().astype(np.int64) for c in ("first", "second", "id"))
    order = np.argsort(ids)
    keys, second, ids = keys[order].view(np.uint64), second[order].view(np.uint64), ids[order]
    rest = table.where(~in_head)
    n = rest.count()
    tail = None
    if n:
        bits = min(MOST_BITS, 1 << (16 * n).bit_length())
        bit = F.col("h").bitwiseAND(F.lit(bits - 1))
        rows = with_hash(rest).select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        rows = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
        tail = np.zeros(bits >> 6, dtype=np.uint64)
        tail[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Level(keys, ids, second if m == 1 else None, tail)


def _named(frequent: DataFrame, below: DataFrame) -> DataFrame:
    """Rows counted by pair of ids get the language and text that the ids of the level below stand for."""
    by_code = frequent.where("code is not null").withColumns({"x": F.shiftright("code", 32), "y": F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))})
    left = below.select(F.col("id").alias("x"), F.col("lang").alias("own"), F.col("phrase").alias("head"))
    right = below.select(F.col("id").alias("y"), F.substring_index("phrase", " ", -1).alias("last"))
    joined = by_code.join(left, "x").join(right, "y")
    joined = joined.select("code", F.col("own").alias("lang"), F.concat_ws(" ", "head", "last").alias("phrase"), "n")
    return joined.unionByName(frequent.where("code is null"))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, head: int = HEAD, limit: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences in a language, and word totals.

    The first frame has ``lang, phrase, m, n`` (m words, n occurrences), the second ``lang, n``. Both are
    exact, written tables; ``head`` and ``limit`` (bytes of text at once) only decide how a phrase is counted.
    """
    texts = docs.select(named("text").cast("string").alias("text"), F.coalesce(named("lang").cast("string"), F.lit("und")).alias("lang"))
    tables, levels = [], []
    totals = None
    for m in range(1, longest + 1):
        rows = counted(texts, levels, limit)
        if m == 1:
            rows = stage(rows, "words")
            totals = stage(rows.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
        # Written, because both the naming by two ways of counting and the range sort read it.
        frequent = stage(rows.where(F.col("n") >= least), f"frequent-{m}")
        table = ranked(frequent if m == 1 else _named(frequent, tables[-1]))
        tables.append(stage(table, f"phrases-{m}"))
        if m < longest:
            levels.append(level_of(tables[-1], m, head))
    every = reduce(DataFrame.unionByName, [t.select("lang", "phrase", F.lit(m).alias("m"), "n") for m, t in enumerate(tables, start=1)])
    return every, totals


def _floor_share(a: str, total: Column) -> Column:
    """floor(2000000 a / total) on decimals of 38 digits: nothing is rounded and nothing overflows."""
    return F.call_function("div", F.col(a).cast("decimal(20,0)") * F.lit(2000000).cast("decimal(7,0)"), total.cast("decimal(20,0)"))


def scored(every: DataFrame) -> DataFrame:
    """``lang, phrase, m, a, l, r, score`` of all phrases of two and more words, by their lowest-scoring cut."""
    some = every.where("m > 1").select("lang", "phrase", "m", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "m", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("right"),
    )
    lefts = every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    cuts = cuts.withColumn("score", _floor_share("a", F.col("l").cast("decimal(20,0)") + F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.first("m").alias("m"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "cut.score")


def outermost(every: DataFrame, found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """``found`` without phrases inside a longer frequent one that has ``inside`` hundredths of their occurrences."""
    longer = every.where("m > 2").select("lang", "m", "n", F.split("phrase", " ").alias("w"))
    cut = longer.select("lang", "m", "n", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    cut = cut.select("lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("i"))
    held = cut.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("phrase")).agg(F.max("n").alias("around"))
    return found.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < inside * F.col("a"), F.lit(True))).drop("around")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, longest: int = LONGEST, inside: int = INSIDE, head: int = HEAD, limit: int = BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` best phrases of each language.

    Texts are lower-cased (A-Z only), cut into pieces at ``. , ; : ! ?`` and line breaks and into words at
    spaces and tabs. ``a`` counts all occurrences of a phrase of 2 to ``longest`` words, overlapping ones too; at
    least ``least`` are needed. The cut into a first part (``l`` occurrences) and the rest (``r``) with the least
    floor(2000000 a / (l + r)) counts, the shortest first part among equal ones. Phrases inside a longer one with
    ``inside`` hundredths of their count are left out. Order: score and a descending, phrase ascending by bytes.
    ``n`` is the number of word occurrences in the language.

    A null text has no words, a null lang is ``und``; empty texts add nothing. Rows that repeat count again, each
    with its own text; doc_id and other columns are not read, whatever their names. Very long texts are
    worked on in parts of ``BYTES`` bytes, or of the longest word. No rows give no rows.
    """
    every, totals = phrases(docs, least, longest, head, limit)
    best = outermost(every, scored(every), inside)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
    return top.join(checked_broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
