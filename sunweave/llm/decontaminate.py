"""Benchmark passages in training documents by winnowing.

Fingerprints of a text are the smallest hash of its 5-word grams within every 6 consecutive grams
(all of them on ties). Two texts that share 10 or more words in a row share one such window of grams
and so at least one fingerprint; each shared fingerprint is then extended word by word. Items of fewer
than 10 words are searched as a whole, every gram of their length being a fingerprint.

The benchmark goes to the executors in blocks of bounded bytes, one pass over the documents for each
(one pass for any common benchmark). Documents are never shuffled, so hot passages cost nothing extra.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import add_from_text, columns, fresh, named
from sunweave.session import stage

WINDOW, GRAM = 10, 5
#: Grams in a winnowing window: any WINDOW words hold at least one whole window.
SPAN = WINDOW - GRAM + 1
#: Bytes of benchmark text held by an executor at once.
BLOCK = 16 << 20
#: Candidate alignments extended at once.
BATCH = 1 << 20


def winnow(found: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the fingerprints of rows of at least WINDOW words."""
    h = W.grams(hashes, GRAM)
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = h[:n].copy()
    for j in range(1, SPAN):
        np.minimum(low, h[j : j + n], out=low)
    whole = found.row[:n] == found.row[WINDOW - 1 : WINDOW - 1 + n]
    chosen = np.zeros(len(h), dtype=bool)
    for j in range(SPAN):
        chosen[j : j + n] |= whole & (h[j : j + n] == low)
    at = np.flatnonzero(chosen)
    return at, h[at]


def every_gram(found: W.Words, hashes: np.ndarray, n: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of all n-word grams, or of those in ``rows`` only."""
    h = W.grams(hashes, n)
    inside = found.row[: len(h)] == found.row[n - 1 :] if len(h) else np.zeros(0, bool)
    if rows is not None and len(h):
        inside &= rows[found.row[: len(h)]]
    at = np.flatnonzero(inside)
    return at, h[at]


class Index:
    """Fingerprints of a block of items, sorted, with the words around them."""

    def __init__(self, items: list[tuple[str | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        blocks = list(W.blocks(pa.array([t for _, t in items], pa.large_string()), limit=1 << 62))
        self.words = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not blocks:
            return
        found = blocks[0].words(W.ALNUM)
        self.words, self.row = found.hashes(), found.row
        self.first, self.count = found.first, found.count
        self._add(0, *winnow(found, self.words))
        for n in range(1, WINDOW):
            rows = found.count == n
            if rows.any():
                self._add(n, *every_gram(found, self.words, n, rows))

    def _add(self, kind: int, at: np.ndarray, h: np.ndarray) -> None:
        if len(h):
            order = np.argsort(h, kind="stable")
            self.tables[kind] = h[order], at[order]

    def hits(self, found: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges that match (start, end), and the item of each."""
        out = [np.zeros((3, 0), np.int64)]
        for kind, (known, place) in self.tables.items():
            at, h = every_gram(found, hashes, kind) if kind else winnow(found, hashes)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            some = high > low
            at, low, many = at[some], low[some], (high - low)[some]
            done = 0
            while done < len(at):
                to = max(done + 1, int(np.searchsorted(np.cumsum(many[done:]), BATCH)) + done)
                m = many[done:to]
                p = np.repeat(at[done:to], m)
                q = place[np.repeat(low[done:to] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
                out.append(self._extend(found, hashes, p, q, kind))
                done = to
        return tuple(np.concatenate(out, axis=1))

    def _extend(self, found: W.Words, hashes: np.ndarray, p: np.ndarray, q: np.ndarray, kind: int) -> np.ndarray:
        row, item = found.row[p], self.row[q]
        length, need = (kind, kind) if kind else (GRAM, WINDOW)
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        equal = np.ones(len(p), bool)
        for j in range(length):
            equal &= hashes[p + j] == self.words[q + j]
        for grown, step in ((left, -1), (right, 1)):
            alive = equal.copy()
            for j in range(1, need - length + 1):
                a, b = (p - j, q - j) if step < 0 else (p + length - 1 + j, q + length - 1 + j)
                alive &= (a >= 0) & (b >= 0) & (a < len(hashes)) & (b < len(self.words))
                a, b = np.where(alive, a, 0), np.where(alive, b, 0)
                alive &= (found.row[a] == row) & (self.row[b] == item) & (hashes[a] == self.words[b])
                grown += alive
        good = equal & (left + length + right >= need)
        return np.stack([(p - left)[good], (p + length + right)[good], item[good]])


def _search(shared, first: bool):
    def run(block: W.Block, *before: pa.Array) -> list[pa.Array]:
        index: Index = shared.value
        found = block.words(W.ALNUM)
        start, end, item = index.hits(found, found.hashes())
        row = found.row[start] if len(start) else start
        base = found.first
        marks = np.zeros(len(found.row) + 1, np.int64)
        np.add.at(marks, start, 1)
        np.add.at(marks, end, -1)
        pairs = np.unique(np.stack([row, item]), axis=1)
        names: list[list[str]] = [[] for _ in range(block.n)]
        if not first:
            for r, (spans, ids) in enumerate(zip(before[0].to_pylist(), before[1].to_pylist())):
                names[r] += ids
                for a, b in zip(spans[::2], spans[1::2]):
                    marks[base[r] + a] += 1
                    marks[base[r] + b] -= 1
        for r, i in pairs.T.tolist():
            names[r].append(index.ids[i])
        hit = np.cumsum(marks)[:-1] > 0
        spans: list[list[int]] = [[] for _ in range(block.n)]
        if hit.any():
            begin = hit.copy()
            begin[1:] &= ~hit[:-1] | (found.row[1:] != found.row[:-1])
            stop = hit.copy()
            stop[:-1] &= ~hit[1:] | (found.row[1:] != found.row[:-1])
            for a, b in zip(np.flatnonzero(begin).tolist(), np.flatnonzero(stop).tolist()):
                r = int(found.row[a])
                spans[r] += [a - int(base[r]), b - int(base[r]) + 1]
        return [
            pa.array(found.count.astype(np.int64)),
            pa.array(spans, pa.list_(pa.int32())),
            pa.array([sorted({i for i in x if i is not None}) for x in names], pa.list_(pa.string())),
        ]

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK, keep: list[str] | None = None) -> tuple[DataFrame, str, str, str]:
    """Rows of ``docs`` with three more columns, and the names of these columns.

    They are: words of the text (long), word ranges that occur in the benchmark (flat array start,
    end, start, ...; ends exclusive, merged), and ids of the items with an occurring window (sorted as
    strings, distinct). Words are runs of letters and digits, A-Z lower-cased; a window is 10
    consecutive words of an item, or the whole of a shorter one.

    Null and empty texts have no words and no hits; so do null items. Words of items with a null id are hit like
    any others; only the list of ids leaves them out. Repeated rows and ids are each judged by their own text; items
    sharing an id count once. An empty benchmark hits nothing. Names that clash are avoided.
    """
    keep = docs.columns if keep is None else keep
    n_words, spans, items = fresh(docs, "n_words"), fresh(docs, "hit_spans"), fresh(docs, "hit_items")
    added = [(n_words, "bigint"), (spans, "array<int>"), (items, "array<string>")]
    given = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("t")).where("t is not null")
    total = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    out = docs
    for part in range(parts):
        mine = given.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part) if parts > 1 else given
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r.id, r.t) for r in mine.collect()]))
        if part == 0:
            carried = keep if parts == 1 else [*dict.fromkeys([*keep, "text"])]
            out = add_from_text(docs, _search(shared, True), added, keep=carried)
        else:
            old = [fresh(out, "before_spans"), fresh(out, "before_items")]
            out = stage(out, "searched").drop(n_words).withColumnsRenamed({spans: old[0], items: old[1]})
            carried = [c for c in out.columns if c not in old]
            out = add_from_text(out, _search(shared, False), added, keep=carried, also=old)
    if parts > 1:
        out = out.select(*[named(c) for c in [*keep, n_words, spans, items]])
    return out, n_words, spans, items


def hit_words(spans: str) -> Column:
    """Words within flat ranges: sum of ends minus sum of starts."""
    return F.expr(f"aggregate(transform(`{spans}`, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all columns."""
    found, _, spans, _ = contamination(docs, benchmark, block_bytes)
    return found.where(F.size(F.col(spans)) == 0).select(*columns(docs))
