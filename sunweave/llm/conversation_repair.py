"""Cheapest repair of conversations by dynamic programming over a grammar of their fault sequences.

Every row becomes a symbol: the class of its role's initial and its first fault. The symbol strings of all
conversations, each distinct one once, are compressed by Re-Pair: rounds of pair counts replace frequent pairs by rules.
A symbol or rule carries a min-plus matrix over the four states of the wanted order (nothing yet, system, user,
assistant): the least cost from state to state, and the edits that reach it, as a rope that shares the ropes
of the rules below. Matrices are computed once per rule, bottom-up, and used by all conversations. Equal costs are
decided by the edits in ASCII order; two cheapest edit strings between the same states never are
one a beginning of the other (the longer would cost an insertion more), so the product of the best is the best.

Long conversations are cut into blocks of ``BLOCK`` rows, whose matrices are multiplied ``FAN`` at a time, so no
conversation's rows meet in one task. Its edits are one string in the end, and a product holds up to 16 such strings: a
conversation of ten million rows takes some 160 MB. The grammar is bounded: ``ROUNDS`` x ``PAIRS`` rules.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm.columns import named
from sunweave.session import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
ROUNDS, PAIRS = 10, 32
BLOCK_BITS, FAN_BITS = 10, 6
BLOCK, FAN = 1 << BLOCK_BITS, 1 << FAN_BITS

#: Symbols: 4 x initial (s, u, a, other) + fault (none, truncated, blank, duplicate), then the rules.
FIRST_SYMBOL = 0x4E00
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
RULES_AT = FIRST_SYMBOL + 16

#: States: nothing yet, after system, after user, after assistant; where each role leads from each state.
STATES = range(4)
_TO = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)

Cell = tuple  # (cost, rope); a rope is a string or a pair of ropes


def spelled(rope) -> str:
    """The text of a rope."""
    out, todo = [], [rope]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            out.append(now)
        else:
            todo += (now[1], now[0])
    return "".join(out)


def joined(a, b):
    return b if a == "" else a if b == "" else (a, b)


def better(a: Cell | None, b: Cell | None) -> Cell | None:
    """The cheaper cell; of equal costs that whose edits come first."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or spelled(a[1]) <= spelled(b[1]) else b


def through(row: list, matrix: list) -> list:
    """Min-plus product of a row of cells and a matrix."""
    out: list = [None] * 4
    for k in STATES:
        if row[k] is None:
            continue
        for j in STATES:
            cell = matrix[k][j]
            if cell is not None and (out[j] is None or row[k][0] + cell[0] <= out[j][0]):
                out[j] = better(out[j], (row[k][0] + cell[0], joined(row[k][1], cell[1])))
    return out


def product(a: list, b: list) -> list:
    return [through(row, b) for row in a]


UNIT = [[(0, "") if i == j else None for j in STATES] for i in STATES]


def _insertions() -> list:
    """Cheapest insertions from state to state, none included."""
    one: list = [[None] * 4 for _ in STATES]
    for role in "ua":
        for i, j in _TO[role].items():
            one[i][j] = (INSERT_COST, INSERT)
    two = product(one, one)
    return [[better(UNIT[i][j], better(one[i][j], two[i][j])) for j in STATES] for i in STATES]


INSERTED = _insertions()


def symbol_matrix(symbol: int) -> list:
    """Insertions before a row, then one edit of the row."""
    initial, fault = divmod(symbol, 4)
    cells: list = [[None] * 4 for _ in STATES]
    for i in STATES:
        cells[i][i] = (DELETE_COST, DELETE)
    if fault < 2:
        extra = TRUNCATED_COST * fault
        for role in "ua":
            for i, j in _TO[role].items():
                cells[i][j] = better(cells[i][j], (REROLE_COST + extra, REROLE))
        if initial < 3:
            for i, j in _TO[INITIALS[initial]].items():
                cells[i][j] = better(cells[i][j], (extra, KEEP))
    return product(INSERTED, cells)


def legal(a: int, b: int) -> bool:
    """Whether a row of initial class ``b`` may follow one of class ``a``."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


@dataclass
class Piece:
    """What a symbol or a product of symbols stands for: its matrix, first and last initial class, illegal neighbours."""

    matrix: list
    first: int
    last: int
    illegal: int

    def then(self, other: Piece) -> Piece:
        illegal = self.illegal + other.illegal + (not legal(self.last, other.first))
        return Piece(product(self.matrix, other.matrix), self.first, other.last, illegal)


@dataclass
class Grammar:
    """``pieces`` by symbol: the 16 terminals, then one for each rule."""

    rules: list[str]

    def __post_init__(self) -> None:
        self.pieces = [Piece(symbol_matrix(x), x // 4, x // 4, 0) for x in range(16)]
        for pair in self.rules:
            left, right = (self.pieces[ord(c) - FIRST_SYMBOL] for c in pair)
            self.pieces.append(left.then(right))

    def from_start(self, text: str) -> tuple[list, int]:
        """Cells from the first state over a compressed string, and its illegal neighbours."""
        row, illegal, last = UNIT[0], 0, None
        for c in text:
            piece = self.pieces[ord(c) - FIRST_SYMBOL]
            row = through(row, piece.matrix)
            illegal += piece.illegal + (last is not None and not legal(last, piece.first))
            last = piece.last
        return row, illegal

    def whole(self, text: str) -> Piece:
        pieces = [self.pieces[ord(c) - FIRST_SYMBOL] for c in text]
        out = pieces[0]
        for piece in pieces[1:]:
            out = out.then(piece)
        return out


def ended(row: list) -> tuple[int, str]:
    """Cost and edits of the cheapest way to a legal end."""
    cell = None
    for j in ENDS:
        cell = better(cell, through(row, INSERTED)[j])
    return cell[0], spelled(cell[1])


def compressed(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> tuple[DataFrame, list[str]]:
    """``sequences`` (seq, open) with ``packed``, the string under the grammar, and its rules (pairs of symbols).

    Each round counts the pairs of neighbours in all distinct strings and replaces the most frequent ones, those
    that occur twice or more, from left to right. Rules of a round are made of symbols of earlier ones.
    """
    now, rules = stage(sequences.withColumn("packed", F.col("seq")), "sequences"), []
    for _ in range(rounds):
        c = F.split("packed", "")
        twos = now.where(F.length("packed") > 1).select(F.explode(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))).alias("pair"))
        top = twos.groupBy("pair").count().where("count > 1").orderBy(F.col("count").desc(), "pair").limit(pairs).collect()
        if not top:
            break
        packed = F.col("packed")
        for row in top:
            packed = F.replace(packed, F.lit(row.pair), F.lit(chr(RULES_AT + len(rules))))
            rules.append(row.pair)
        now = stage(now.withColumn("packed", packed), "sequences")
    return now, rules


_CELLS = "array<struct<cost:bigint,edits:array<string>>>"


def _evaluated(rules: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            out = []
            for seq, wide, packed in zip(*(batch.column(c).to_pylist() for c in ("seq", "open", "packed"))):
                row, illegal = grammar.from_start(packed)
                cost, audit = ended(row)
                cells, first, last = None, None, None
                if wide:
                    piece = grammar.whole(packed)
                    first, last = piece.first, piece.last
                    cells = [None if x is None else {"cost": x[0], "edits": [spelled(x[1])]} for line in piece.matrix for x in line]
                out.append({"seq": seq, "cost": cost, "audit": audit, "illegal": illegal, "first": first, "last": last, "cells": cells})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("seq", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.list_(pa.string()))]))),
            ]))

    return run


def _edits_first(a: dict | None, b: dict | None) -> dict | None:
    if a is None or b is None:
        return b if a is None else a
    if a["cost"] != b["cost"]:
        return a if a["cost"] < b["cost"] else b
    return a if "".join(a["edits"]) <= "".join(b["edits"]) else b


def _times(a: list, b: list) -> list:
    """Product of two matrices of 16 cells whose edits are lists with one string per block."""
    out: list = [None] * 16
    for i in STATES:
        for k in STATES:
            if (x := a[4 * i + k]) is None:
                continue
            for j in STATES:
                if (y := b[4 * k + j]) is not None:
                    out[4 * i + j] = _edits_first(out[4 * i + j], {"cost": x["cost"] + y["cost"], "edits": [*x["edits"], *y["edits"]]})
    return out


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the consecutive blocks of each input row's list ``all``."""
    for batch in batches:
        out = []
        for key, blocks in zip(batch.column("key").to_pylist(), batch.column("all").to_pylist()):
            now = blocks[0]
            for x in blocks[1:]:
                illegal = now["illegal"] + x["illegal"] + (not legal(now["last"], x["first"]))
                now = {"starts": now["starts"] + x["starts"], "illegal": illegal, "first": now["first"], "last": x["last"], "cells": _times(now["cells"], x["cells"])}
            out.append({"key": key} | {c: now[c] for c in ("starts", "illegal", "first", "last", "cells")})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field("key"), *_BLOCK_FIELDS]))


_BLOCK_FIELDS = [
    pa.field("starts", pa.list_(pa.int64())), pa.field("illegal", pa.int64()), pa.field("first", pa.int32()), pa.field("last", pa.int32()),
    pa.field("cells", pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.list_(pa.string()))]))),
]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and the edits of each block of whole conversations."""
    for batch in batches:
        out = []
        for key, starts, illegal, cells in zip(*(batch.column(c).to_pylist() for c in ("key", "starts", "illegal", "cells"))):
            cell = None
            for k in STATES:
                for j in ENDS:
                    if cells[k] is not None and (end := INSERTED[k][j]) is not None:
                        edits = [*cells[k]["edits"][:-1], cells[k]["edits"][-1] + spelled(end[1])]
                        cell = _edits_first(cell, {"cost": cells[k]["cost"] + end[0], "edits": edits})
            out.append({"key": key, "starts": starts, "illegal": illegal, "cost": cell["cost"], "edits": cell["edits"]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            batch.schema.field("key"), ("starts", pa.list_(pa.int64())), ("illegal", pa.int64()), ("cost", pa.int64()), ("edits", pa.list_(pa.string())),
        ]))


def _per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a conversation: its edit, the place its output takes, and insertions before and after it.

    Outputs are numbered from 0; ``system`` says that number 0 is a kept system row, so users have odd numbers.
    """
    names = ["pos", "edit", "place", "before", "after", "system"]
    for batch in batches:
        rows: list[tuple] = []
        for starts, edits, symbols in zip(*(batch.column(c).to_pylist() for c in ("starts", "edits", "symbol"))):
            text = "".join(edits)
            first = next((c for c in text if c != DELETE), "")
            system = first == KEEP and symbols in range(4) if first else False
            place = 0
            for start, piece in zip(starts, edits):
                before = 0
                for c in piece:
                    if c == INSERT:
                        before += 1
                        continue
                    rows.append((start, c, place + before, before, 0, system))
                    place += before + (c != DELETE)
                    start, before = start + 1, 0
                if before:
                    rows[-1] = (*rows[-1][:4], before, system)
                    place += before
                if len(rows) > 50_000:
                    yield _rows_batch(rows[:-1], names)
                    rows = rows[-1:]
        yield _rows_batch(rows, names)


def _rows_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it a user's.
    """
    known = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select(named("conv_id").alias("conv_id"), named("turn").alias("turn"), known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("fault != 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def faulty(conversations: DataFrame) -> DataFrame:
    """``pos, conv_id, turn, role, text, fault, symbol`` of every row, written.

    ``pos`` numbers all rows by (conv_id, turn, role, text), nulls first, without gaps within a task's share. ``fault``
    is the first that holds: blank (no character but spaces), duplicate (role and text stood earlier in the
    conversation), truncated (the last character but spaces is none of ``.!?``), or empty.
    """
    known = lambda c: F.coalesce(named(c).cast("string"), F.lit(" ")).alias(c)
    keys = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(named("conv_id").alias("conv_id"), named("turn").alias("turn"), known("role"), known("text"))
    rows = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()), "turns")
    digest = F.sha2("text", 256)
    again = rows.groupBy(F.col("conv_id").alias("own"), F.col("role").alias("as_role"), digest.alias("digest"))
    again = again.agg(F.min("pos").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("role") == F.col("as_role")) & (digest == F.col("digest"))
    both = rows.join(again, same, "left").select("pos", *keys, "earliest")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("pos") > F.col("earliest"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    )
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((F.length("role") == 0) | (initial < 0), 3).otherwise(initial)
    place = F.array_position(F.array(*[F.lit(x) for x in FAULTS]), F.col("fault")).cast("int") - 1
    both = both.withColumn("fault", fault).withColumn("symbol", 4 * initial + place)
    return stage(both.select("pos", *keys, "fault", "symbol"), "faults")


@dataclass
class Repair:
    """Result of ``repair``; see there."""

    summary: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """Cheapest edits that give every conversation the order ``system? (user assistant)+``, or leave it empty.

    Keeping a row costs 0, changing its role to user or assistant 1, deleting it 2 (blank and duplicate rows have to
    go), inserting an empty row of user or assistant 5; a truncated row that stays costs 5 more. Of equally cheap
    edits the ASCII-least string of their initials (K, R, D, I) is taken. Roles count by their initial.

    ``summary``: one row per conversation, ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; gaps
    are missing turn numbers between the least and the largest, illegal the neighbours whose initials are not
    su, ua or au, before the repair. ``rows``: the repaired conversations, ``conv_id, place, edit, turn,
    role, text``, place from 0; inserted rows have no turn.

    Rows are ordered by turn, nulls first; rows that share a turn by role and text. Null roles and texts count as
    one space, rows with null conv_id are one conversation; repeated rows are duplicates. Texts are never cut. Other
    columns are ignored, whatever their names. No rows give no rows.
    """
    rows = faulty(conversations)
    block = F.shiftright("pos", BLOCK_BITS)
    signs = F.array(*[F.lit(chr(FIRST_SYMBOL + i)) for i in range(16)])
    spelled_out = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: F.element_at(signs, x["symbol"] + 1)), "")
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(spelled_out.alias("seq"), F.min("pos").alias("start"))
    ends = rows.groupBy("conv_id").agg(
        F.shiftright(F.min("pos"), BLOCK_BITS).alias("low"), F.shiftright(F.max("pos"), BLOCK_BITS).alias("high"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    ends = stage(ends, "conversations")
    cut = ends.select(F.col("conv_id").alias("own"), (F.col("low") != F.col("high")).alias("open"))
    blocks = blocks.join(cut, F.col("conv_id").eqNullSafe(F.col("own")))
    blocks = stage(blocks.select(F.struct("conv_id").alias("key"), "block", "start", "seq", "open"), "blocks")
    packed, rules = compressed(blocks.groupBy("seq").agg(F.max("open").alias("open")))
    known = stage(packed.mapInArrow(_evaluated(rules), f"seq string, cost bigint, audit string, illegal bigint, first int, last int, cells {_CELLS}"), "matrices")
    found = blocks.join(known, "seq")
    alone = found.where("not open").select("key", F.array("start").alias("starts"), "illegal", "cost", F.array("audit").alias("edits"))
    kind = blocks.select("key").schema["key"].dataType.simpleString()
    parts = stage(found.where("open").select("key", "block", F.array("start").alias("starts"), "illegal", "first", "last", "cells"), "products")
    whole = ends.where("low != high").count()
    shape = f"key {kind}, starts array<bigint>, illegal bigint, first int, last int, cells {_CELLS}"
    while parts.count() > whole:
        parts = parts.withColumn("block", F.shiftright("block", FAN_BITS))
        fields = F.struct("low", "starts", "illegal", "first", "last", "cells")
        lists = parts.withColumn("low", F.col("starts")[0]).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("low", fields.alias("x")))).alias("all"))
        lists = lists.select(F.struct("key", "block").alias("key"), F.transform("all", lambda v: v["x"]).alias("all"))
        parts = lists.mapInArrow(_multiplied, shape.replace(f"key {kind}", f"key struct<key:{kind},block:bigint>"))
        parts = stage(parts.select("key.key", "key.block", "starts", "illegal", "first", "last", "cells"), "products")
    closed = parts.select("key", "starts", "illegal", "cells").mapInArrow(_closed, f"key {kind}, starts array<bigint>, illegal bigint, cost bigint, edits array<string>")
    solved = stage(alone.unionByName(closed), "solved")
    own = solved.select(F.col("key.conv_id").alias("own"), "illegal", "cost", F.array_join("edits", "").alias("audit"))
    summary = ends.join(own, F.col("conv_id").eqNullSafe(F.col("own"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(summary, _repaired(rows, solved))


def _repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The rows that the edits leave or add, with their place in the conversation."""
    # Whether the first output is a kept system row: the symbol of the first row that is not deleted.
    first = F.length(F.regexp_extract(F.array_join("edits", ""), "^D*", 0))
    skipped = F.aggregate(
        F.arrays_zip("starts", F.transform("edits", lambda e: F.length(e)).alias("size")), F.struct(first.alias("left"), F.lit(None).cast("bigint").alias("pos")),
        lambda acc, x: F.struct(
            F.when(acc["pos"].isNull(), acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"),
            F.when(acc["pos"].isNull() & (acc["left"] < x["size"]), x["starts"] + acc["left"]).otherwise(acc["pos"]).alias("pos"),
        ), lambda acc: acc["pos"],
    )
    heads = solved.select("starts", "edits", skipped.alias("head"))
    symbols = heads.join(rows.select(F.col("pos").alias("head"), "symbol"), "head", "left").select("starts", "edits", "symbol")
    edits = symbols.mapInArrow(_per_row, "pos bigint, edit string, place bigint, before int, after int, system boolean")
    both = rows.join(edits, "pos")

    def role(place: Column) -> Column:
        return F.when((place + F.col("system").cast("int")) % 2 == 0, "user").otherwise("assistant")

    nothing = F.array().cast("array<struct<place:bigint,edit:string,turn:bigint,role:string,text:string>>")

    def added(n: Column, begin: Column) -> Column:
        make = lambda place: F.struct(place.alias("place"), F.lit(INSERT).alias("edit"), F.lit(None).cast("bigint").alias("turn"), role(place).alias("role"), F.lit("").alias("text"))
        return F.when(n > 0, F.transform(F.sequence(begin, begin + n - 1), make)).otherwise(nothing)

    place = F.col("place")
    stays = F.struct(place.alias("place"), F.col("edit"), F.col("turn").cast("bigint").alias("turn"), F.when(F.col("edit") == KEEP, F.col("role")).otherwise(role(place)).alias("role"), F.col("text"))
    stays = F.when(F.col("edit") == DELETE, nothing).otherwise(F.array(stays))
    after = place + F.when(F.col("edit") == DELETE, 0).otherwise(1)
    return both.select("conv_id", F.inline(F.concat(added(F.col("before"), place - F.col("before")), stays, added(F.col("after"), after))))


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the ``role:text`` lines of repaired conversations, in order, joined by newlines.

    A hash is taken from its text front to back, so each conversation passes through one task, row by row: the sorted
    rows are streamed and nothing of a conversation is held but the hash.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, now = None, None, None
        for batch in batches:
            schema = batch.schema.field("conv_id")
            ids, hashes = [], []
            for key, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if now is None or key != last:
                    if now is not None:
                        ids.append(last)
                        hashes.append(now.hexdigest())
                    last, now = key, hashlib.sha256(line.encode())
                else:
                    now.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.type), pa.array(hashes, pa.string())], names=["conv_id", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], schema.type), pa.array([now.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return ordered.mapInArrow(run, f"conv_id {kind}, sha256 string")
