"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

The fingerprint of bytes b_0 .. b_{n-1} is ``sum((b_i + 1) * base^i)`` modulo two primes of 31 bits.
Fingerprints compose: of two neighbouring chunks, ``f(xy) = f(x) + base^len(x) * f(y)``, so the chunks
of a huge text are hashed side by side and put together with shifts by their lengths. Texts with
equal length and fingerprint are then compared byte for byte in chunks that stream through a join;
no text meets another one whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.llm.columns import add_from_text, columns, fresh, raw_texts
from sunweave.llm.words import Block, blocks, sums
from sunweave.session import stage

#: Bytes of a chunk.
CHUNK = 1 << 16
#: The two largest primes below 2^31, with one base each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)

_U = np.uint64


def _ladder(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo a prime, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), prime)) % _U(prime)])
    return out[:n]


_LADDERS: dict[tuple[int, int], np.ndarray] = {}


def ladder(base: int, prime: int, n: int = CHUNK) -> np.ndarray:
    """As ``_ladder``, remembered by each worker."""
    known = _LADDERS.get((base, prime))
    if known is None or len(known) < n:
        known = _LADDERS[base, prime] = _ladder(base, prime, n)
    return known


def shifted(length: int, right: int, base: int, prime: int) -> int:
    """The share of a chunk with fingerprint ``right`` that follows ``length`` bytes."""
    return pow(base, length, prime) * right % prime


def compose(left: int, length: int, right: int, base: int = BASES[0], prime: int = PRIMES[0]) -> int:
    """Fingerprint of two neighbouring byte strings from theirs and the length of the left one."""
    return (left + shifted(length, right, base, prime)) % prime


def fingerprints(block: Block, bases: tuple[int, int] = BASES, chunk: int = CHUNK) -> np.ndarray:
    """One 62-bit fingerprint per row: chunks hashed side by side, then composed."""
    size = np.diff(block.offsets)
    pieces = -(-size // chunk)
    row = np.repeat(np.arange(block.n), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = block.offsets[row] + number * chunk
    length = np.minimum(chunk, block.offsets[row + 1] - start)
    place = np.arange(len(block.data)) - np.repeat(start, length)
    out = np.zeros(block.n, dtype=np.uint64)
    for base, prime in zip(bases, PRIMES):
        terms = (block.data.astype(np.uint64) + _U(1)) * ladder(base, prime, chunk)[place]
        parts = sums(terms, length) % _U(prime) if len(row) else np.zeros(0, dtype=np.uint64)
        step = pow(base, chunk, prime)
        parts = parts * _ladder(step, prime, int(number.max(initial=0)) + 1)[number] % _U(prime)
        out = (out << _U(31)) | (sums(parts, pieces) % _U(prime))
    return out


def _prints(bases: tuple[int, int]):
    def run(block: Block) -> list[pa.Array]:
        sha = [hashlib.sha256(x).hexdigest() for x in raw_texts(block)]
        return [pa.array(np.diff(block.offsets)), pa.array(fingerprints(block, bases).view(np.int64)), pa.array(sha, pa.string())]

    return run


_PRINT = [("size", "bigint"), ("print", "bigint"), ("text_sha256", "string")]


def prints(docs: DataFrame, bases: tuple[int, int] = BASES) -> DataFrame:
    """``doc_id, size, print, text_sha256`` of every row, of its text with A-Z lower-cased."""
    return add_from_text(docs, _prints(bases), _PRINT, keep=["doc_id"])


def _chunks(bases: tuple[int, int], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                size, print_, sha = _prints(bases)(block)
                pieces = [[bytes(t[i : i + chunk]) for i in range(0, len(t), chunk)] for t in raw_texts(block)]
                row = pa.array(np.repeat(np.arange(block.n), [len(p) for p in pieces]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n).take(row), size.take(row), print_.take(row), sha.take(row),
                        pa.array([i for p in pieces for i in range(len(p))], pa.int64()),
                        pa.array([x for p in pieces for x in p], pa.binary()),
                    ],
                    names=["doc_id", "size", "print", "text_sha256", "chunk", "bytes"],
                )

    return run


def differing(docs: DataFrame, members: DataFrame, bases: tuple[int, int] = BASES, chunk: int = CHUNK) -> DataFrame:
    """``(size, print)`` of groups in which some text differs from the group's first in any chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = members.select("_id").distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    rows = texts.mapInArrow(
        _chunks(bases, chunk),
        f"doc_id {kind}, size bigint, print bigint, text_sha256 string, chunk bigint, bytes binary",
    )
    heads = members.select(F.col("size").alias("_size"), F.col("print").alias("_print"), "head").distinct()
    rows = rows.join(heads, (F.col("size") == F.col("_size")) & (F.col("print") == F.col("_print"))).drop("_size", "_print")
    rows = stage(rows, "chunks")
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_sha256") == F.col("head.text_sha256")))
    first = first.groupBy("size", "print", "chunk").agg(F.first("bytes").alias("expected"))
    met = rows.join(first, ["size", "print", "chunk"])
    return met.where("bytes != expected").select("size", "print").distinct()


def exact_duplicates(docs: DataFrame, bases: tuple[int, int] = BASES, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after lower-casing A-Z; null counts as empty. The largest
    doc_id of a group stays (``keep_id``); group_size counts rows. A null doc_id stays only where all
    of its group are null. Rows that repeat a doc_id are rows of their own: those that also repeat the
    text are all reported as kept with the kept id (``deduplicate`` leaves one of them). Other columns
    are ignored, whatever their names. No rows give no rows.

    Should texts of one length and fingerprint differ, their group is divided by SHA-256.
    """
    fp = stage(prints(docs, bases), "fingerprints")
    key = ["size", "print"]
    groups = fp.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "text_sha256")).alias("head"))
    many = stage(groups.where("n > 1").select(*key, "head"), "groups")
    members = fp.join(many, key).select(*key, "head", F.col("doc_id").alias("_id"))
    clash = differing(docs, members, bases, chunk).withColumn("clash", F.lit(True))
    apart = fp.join(clash, key, "left").withColumn("part", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).drop("clash")
    key = [*key, "part"]
    final = apart.groupBy(*key).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    out = apart.join(final, key)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one for each distinct text (see ``exact_duplicates``)."""
    sha, kept_id, kept_sha = fresh(docs, "sha"), fresh(docs, "kept_id"), fresh(docs, "kept_sha")
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    marked = add_from_text(docs, lambda b: [pa.array([hashlib.sha256(x).hexdigest() for x in raw_texts(b)], pa.string())], [(sha, "string")])
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    return marked.join(kept.distinct(), same, "left_semi").dropDuplicates(["doc_id", sha]).select(*columns(docs))
