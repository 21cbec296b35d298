"""Phrase collocations against plain Python: every way of counting gives the same phrases."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sunweave.llm import collocations as C
from sunweave.llm import words as W

SMALL = "/root/testdata/sf0.001"


def plain(docs, least=C.LEAST, first=C.FIRST, inside=C.INSIDE):
    """docs: (text, lang) -> set of (lang, rank, phrase, a, l, r, n, score)."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        covered = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and 100 * covered[p] < inside * a:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], start=1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def found(df, **options):
    rows = [tuple(r) for r in C.collocations(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.mark.parametrize("options", [{}, {"head": 300, "limit": 1000}])
def test_given_documents(docs, options):
    expected = plain([(r.text, r.lang) for r in docs.collect()], least=4, first=500)
    assert len(expected) > 500
    assert found(docs, least=4, first=500, **options) == expected


def test_odd_rows(spark):
    rng = random.Random(5)
    drawn = [" ".join(rng.choice("a b c é f, g. H i;".split()) for _ in range(rng.randrange(30))) for _ in range(200)]
    texts = [None, "", " \t ", ".,;:!?\n\r", "a\x0bb\x0cc", "Ab aB AB ab", "x" * 5000, "one two\tthree  four.", "a b " * 9000, "no-break space word", "  é É"] + drawn
    rows = [(None if i % 7 == 0 else i % 11, t, (None, "en", "und", "é", "")[i % 5], 1, 2, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, rank int, `phrase` string")
    expected = plain([(r[1], r[2]) for r in rows], least=2)
    assert found(df.repartition(5), least=2) == expected
    assert found(df, least=2, head=3, limit=50) == expected
    assert found(df.union(df), least=4) == {(g, k, p, 2 * a, 2 * x, 2 * y, 2 * n, s) for g, k, p, a, x, y, n, s in expected}
    assert not C.collocations(df.limit(0)).collect()


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits: the shares are taken on decimals."""
    a, b = 4 * 10**15 + 1, 4 * 10**15 + 3
    every = spark.createDataFrame([("en", "x", 1, b), ("en", "y", 1, b + 2), ("en", "x y", 2, a)], "lang string, phrase string, m int, n bigint")
    row = C.scored(every).first()
    assert row.score == 2_000_000 * a // (2 * b + 2) and (row.l, row.r) == (b, b + 2)


def test_tiles_count_dense_and_sparse_alike(monkeypatch):
    monkeypatch.setattr(C, "SETTLE", 1 << 14)
    rng = np.random.default_rng(3)
    tiles, seen, handed = C.Tiles(), Counter(), Counter()
    for i in range(12):
        x = np.concatenate([rng.integers(0, 900, 100_000), rng.integers(0, 1 << 20, 3000)]).astype(np.uint64)
        y = np.concatenate([rng.integers(0, 900, 100_000), rng.integers(0, 1 << 20, 3000)]).astype(np.uint64)
        codes = (x << np.uint64(32)) | y
        seen.update(codes.tolist())
        tiles.add(codes)
        tiles.settle()
        for codes, counts in tiles.hand_on(i == 11):
            for code, n in zip(codes.tolist(), counts.tolist()):
                handed[code] += n
    assert len(tiles.dense) == 1 and handed == seen


def test_direct_addresses():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    asked = np.concatenate([keys[::-1], keys + np.uint64(1)])
    where = {k: i for i, k in enumerate(keys.tolist())}
    assert C.Direct(keys).find(asked).tolist() == [where.get(k, -1) for k in asked.tolist()]
    assert C.Direct(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_parts_of_a_long_text_hold_each_phrase_once():
    text = "alpha beta  gamma. delta\tepsilon " * 40 + "z" * 300 + " end of it"
    for m in (1, 2, 4):
        got, whole = Counter(), Counter()
        for target, limit in ((got, 64), (whole, 1 << 20)):
            for block, words, _ in W.parts(pa.array(["short one", text, None]), C.IN_WORD, m - 1, limit):
                raw = block.data.tobytes()
                said = [raw[a:b] for a, b in zip(words.start, words.end)]
                for i in range(len(said) - m + 1):
                    if words.row[i] == words.row[i + m - 1]:
                        target[tuple(said[i : i + m])] += 1
        assert got == whole


def test_ranks_are_dense_and_by_frequency(spark):
    df = spark.range(1000).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("phrase"), (F.col("id") % 37 + 30).alias("n"), F.lit(None).cast("bigint").alias("code"))
    rows = C.ranked(df).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1000))
    assert [(r.n, r.phrase) for r in rows] == sorted(((r.n, r.phrase) for r in rows), key=lambda x: (-x[0], x[1]))
