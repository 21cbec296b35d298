"""Conversation repair against a search over all edits, on odd rows, and for long conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from sunweave.llm import conversation_repair as R
from sunweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """rows: (role, text) in order -> first fault of each."""
    out, seen = [], set()
    for role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by Dijkstra over (row, state), edits compared as strings."""
    heap, done = [(0, "", 0, 0, ())], set()
    to = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            # The first to arrive at either end is the least of both only if the other is not cheaper.
            return cost, audit, out
        for name in ("user", "assistant"):
            if state in to[name[0]]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to[name[0]][state], (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if found[i] in ("", "truncated"):
                extra = 5 * (found[i] == "truncated")
                if state in to.get(role[:1], {}):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to[role[:1]][state], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if state in to[name[0]]:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, to[name[0]][state], (*out, (name, text))))
    raise AssertionError


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """All rows -> {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}."""
    out, by = {}, {}
    for r in harmed(rows):
        by.setdefault(r[0], []).append(r)
    for c in {r[0] for r in rows}:
        own = sorted(by.get(c, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        said = [(r[2], r[3]) for r in own]
        found = faults(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, mended = cheapest(said, found)
        text = "\n".join(f"{a}:{b}" for a, b in mended)
        out[c] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def queried(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    rows = QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_matrices_give_the_cheapest_edits():
    """All strings of up to four symbols, folded row by row and under a grammar."""
    names = ["system", "user", "assistant", "tool"]
    grammar = R.Grammar([chr(R.FIRST_SYMBOL + 4) + chr(R.FIRST_SYMBOL + 9), chr(R.RULES_AT) * 2])
    for n in range(4):
        for symbols in itertools.product([0, 1, 2, 4, 5, 8, 9, 12], repeat=n):
            rows = [(names[x // 4], f"{i}." if x % 4 != 2 else "") for i, x in enumerate(symbols)]
            cost, audit, _ = cheapest(rows, [R.FAULTS[x % 4] for x in symbols])
            text = "".join(chr(R.FIRST_SYMBOL + x) for x in symbols)
            packed = text
            for i, pair in enumerate(grammar.rules):
                packed = packed.replace(pair, chr(R.RULES_AT + i))
            row, illegal = grammar.from_start(packed)
            assert R.ended(row) == (cost, audit)
            assert illegal == sum(not R.legal(a // 4, b // 4) for a, b in zip(symbols, symbols[1:]))
            if n:
                assert R.ended(grammar.whole(packed).matrix[0]) == (cost, audit)


def test_given_conversations(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert queried(spark, df, tmp_path) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def random_rows(rng, conversations, length):
    rows = []
    for c in range(conversations):
        turn = rng.choice([0, 0, None, 7])
        for _ in range(rng.randrange(length)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "u", "Sys"])
            text = rng.choice(["Yes.", "no", "", " \n", None, "What?", "é🙂", "a\nb.", f"own {rng.random()}."])
            rows.append((None if c == 3 else c, turn, role, text))
            if turn is not None:
                turn += rng.choice([0, 1, 1, 1, 2])
    return rows


def test_odd_rows(spark, tmp_path):
    rows = random_rows(random.Random(8), 120, 12) + [(900, None, None, None), (901, 5, "user", "x" * 200_000 + "."), (901, 6, "assistant", "y!")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", cost int, audit string").repartition(4)
    got = queried(spark, df, tmp_path)
    assert got == plain(rows)
    empty = spark.createDataFrame([], SCHEMA)
    mended = R.repair(empty)
    assert not mended.summary.collect() and not mended.rows.collect() and not R.digests(mended.rows).collect()


@pytest.mark.parametrize("bits", [(5, 3), (10, 6)])
def test_long_conversations_in_blocks(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(R, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(R, "FAN_BITS", bits[1])
    rng = random.Random(9)
    rows = []
    for c, n in ((1, 3000), (None, 1500), (5, 3), (6, 1100)):
        for t in range(n):
            role = rng.choice(["user", "assistant", "assistant", "user", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice(["Yes.", f"{t}!", "cut", f"{t}.", f"{t}?"])))
    rows.append((1, -1, "system", "Be kind."))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert queried(spark, df, tmp_path) == plain(rows)


def test_repaired_rows_are_in_order(spark):
    rows = random_rows(random.Random(10), 60, 9)
    mended = R.repair(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for r in mended.rows.collect():
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert all((r.text == "" and r.turn is None) == (r.edit == "I") or r.turn is None for r in own)
    audits = {r.conv_id: r.audit for r in mended.summary.collect()}
    assert {c: len(a) - a.count("D") for c, a in audits.items() if len(a) > a.count("D")} == {c: len(own) for c, own in by.items()}


def test_frequent_pairs_become_rules(spark):
    a, b, c = (chr(R.FIRST_SYMBOL + x) for x in (4, 8, 0))
    df = spark.createDataFrame([(a + b + a + b + a + b + a + b, False), (c + a + b + a + b, False), (b, False)], "seq string, open boolean")
    packed, rules = R.compressed(df)
    assert rules[0] == a + b and any(chr(R.RULES_AT) in x for x in rules[1:])
    for row in packed.collect():
        text = row.packed
        for i in reversed(range(len(rules))):
            text = text.replace(chr(R.RULES_AT + i), rules[i])
        assert text == row.seq
