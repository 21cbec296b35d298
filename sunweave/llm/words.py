"""Words of a column of texts as flat numpy arrays, one bounded block of rows at a time.

Arrow hands a batch of texts over as one byte buffer with offsets. Word borders, word hashes and
n-gram hashes are computed on that buffer for many rows at once; nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once. A single longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GRAM = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

#: A-Z to a-z, every other byte as it is (the bytes of other letters in UTF-8 stay untouched).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table over bytes that is true within the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but space and the controls from tab to carriage return.
NON_SPACE = byte_class((0, 8), (14, 31), (33, 255))
#: Digits, lower-case letters and every byte of a multi-byte letter.
ALNUM = byte_class((48, 57), (97, 122), (128, 255))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = _Powers()


@dataclass
class Block:
    """Rows ``first`` to ``first + n`` of a batch: their lower-cased bytes, row borders and bytes as given."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    raw: np.ndarray | None = None

    def words(self, is_word: np.ndarray) -> Words:
        mask = is_word[self.data]
        size = len(mask)
        begins, ends = self.offsets[:-1], self.offsets[1:]
        filled = ends > begins
        before = np.zeros(size, dtype=bool)
        before[1:] = mask[:-1]
        before[begins[filled]] = False
        after = np.zeros(size, dtype=bool)
        after[:-1] = mask[1:]
        after[ends[filled] - 1] = False
        start = np.flatnonzero(mask & ~before)
        end = np.flatnonzero(mask & ~after) + 1
        row = np.searchsorted(self.offsets, start, side="right") - 1
        return Words(self, start, end, row, np.bincount(row, minlength=self.n))

    def prefix(self) -> np.ndarray:
        _POWERS.upto(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * _POWERS.up[: len(self.data)], out=out[1:])
        return out

    def hash_ranges(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the bytes of each range, equal for equal bytes wherever they stand."""
        prefix = self.prefix() if prefix is None else prefix
        return mix((prefix[end] - prefix[start]) * _POWERS.down[start])


@dataclass
class Words:
    """Words of a block: byte ranges, row within the block, words per row."""

    block: Block
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word."""
        return np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return self.block.hash_ranges(self.start, self.end)


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into row ranges of at most ``limit`` bytes, or one longer row."""
    column = texts(column)
    wide = pa.types.is_large_string(column.type)
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, dtype=np.int64 if wide else np.int32)
    borders = borders[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(borders, borders[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        raw = data[borders[at] : borders[to]]
        yield Block(at, to - at, LOWER[raw], borders[at : to + 1] - borders[at], raw)
        at = to


def parts(column: pa.Array, is_word: np.ndarray, overlap: int = 0, limit: int = BLOCK_BYTES) -> Iterator[tuple[Block, Words, bool]]:
    """Blocks of a text column with their words, and whether the text goes on in the next block.

    A text beyond ``limit`` bytes comes in several blocks of one row, cut between words. They share ``overlap``
    words, so that ``overlap`` + 1 words in a row lie whole in exactly one of them.
    """
    for block in blocks(column, limit):
        size = len(block.data)
        if size <= limit:
            yield block, block.words(is_word), False
            continue
        at, room = 0, limit
        while at < size:
            end = min(at + room, size)
            while end < size and is_word[block.data[end]]:
                gap = np.flatnonzero(~is_word[block.data[end : end + limit]])
                end = min(end + (int(gap[0]) if len(gap) else limit), size)
            part = Block(block.first, 1, block.data[at:end], np.array([0, end - at]))
            found = part.words(is_word)
            if end < size and len(found.start) <= overlap:
                room *= 2
                continue
            yield part, found, end < size
            at, room = (end if end == size or not overlap else at + int(found.start[-overlap])), limit


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; the caller masks those that cross a row border."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _GRAM[0]
    for j in range(1, k):
        out += words[j : j + n] * _GRAM[j]
    return mix(out + _U(k))


def shingles(found: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles row by row, and how many each row has.

    A row of fewer than ``k`` words, but at least one, has its whole word sequence as one shingle.
    """
    h = found.hashes() if hashes is None else hashes
    count, first = found.count, found.first
    short = np.flatnonzero((count > 0) & (count < k))
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(int(many.sum()), dtype=np.uint64)
    place = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64)
    if len(h) >= k:
        whole = grams(h, k)
        inside = found.row[: len(whole)] == found.row[k - 1 :]
        keep = np.ones(len(out), dtype=bool)
        keep[place[short]] = False
        out[keep] = whole[inside]
    for n in range(1, k):
        rows = short[count[short] == n]
        if len(rows):
            total = np.zeros(len(rows), dtype=np.uint64)
            for j in range(n):
                total += h[first[rows] + j] * _GRAM[j]
            out[place[rows]] = mix(total + _U(n))
    return out, many


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of ``values``; run lengths may be zero."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(count)
    return total[end] - total[end - count]


def pack(first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Two 64-bit hashes per row as one 16-byte binary value."""
    both = np.empty((len(first), 2), dtype=">u8")
    both[:, 0], both[:, 1] = first, second
    return binary(both.view(np.uint8).reshape(len(first), 16))


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as a binary column."""
    n, width = rows.shape
    borders = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(rows).tobytes())]
    )


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Flat values cut into one list per row."""
    borders = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(values, type=kind))
