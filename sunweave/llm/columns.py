"""Columns computed from a text column, a bounded block of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunweave.llm.words import BLOCK_BYTES, Block, blocks
from sunweave.session import stage


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(name: str) -> Column:
    """The column called ``name``, even if the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def add_from_text(
    docs: DataFrame,
    fn: Callable[..., list[pa.Array]],
    added: list[tuple[str, str]],
    keep: list[str] | None = None,
    text: str = "text",
    also: list[str] | None = None,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``docs`` with columns ``added`` (name, type) that ``fn(block)`` computes from ``text``.

    ``keep`` lists the columns carried over (default: all). ``also`` names further columns that ``fn``
    gets as arrays after the block. Rows keep their order and partition; nothing is shuffled.
    """
    keep = docs.columns if keep is None else keep
    also = also or []
    source = docs.select(*[named(c) for c in dict.fromkeys([*keep, *also, text])])
    at = {c: i for i, c in enumerate(source.columns)}
    schema = T.StructType([source.schema[c] for c in keep])
    for name, kind in added:
        schema = schema.add(name, T._parse_datatype_string(kind))
    names = [f"c{i}" for i in range(len(schema.fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at[text]), limit):
                part = batch.slice(block.first, block.n)
                made = fn(block, *[part.column(at[c]) for c in also])
                yield pa.RecordBatch.from_arrays([*[part.column(at[c]) for c in keep], *made], names=names)

    return map_batches(source, run, schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: ``fn`` sees and gives columns called c0, c1, ..."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(fn, plain)
    return out.toDF(*schema.names)


def raw_texts(block: Block) -> Iterator[memoryview]:
    """The bytes of each row of a block."""
    whole = memoryview(block.data)
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
        yield whole[a:b]


def checked_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 16 << 20) -> DataFrame:
    """``df``, written once, marked for broadcast only if its counted rows and bytes stay within bounds.

    A larger one is returned without the mark and joins by shuffle.
    """
    kept = stage(df, "side")
    width = [F.coalesce(F.octet_length(named(f.name)), F.lit(0)) for f in kept.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    row = kept.agg(F.count("*").alias("n"), F.sum(sum(width, F.lit(8 * len(kept.columns)))).alias("b")).first()
    return F.broadcast(kept) if row.n <= max_rows and (row.b or 0) <= max_bytes else kept
