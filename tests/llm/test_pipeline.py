"""The pipeline, stage by stage, against plain Python; the queries against their SQL."""

import glob
import hashlib
import math
import os
import re

import brute
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sunweave.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def poisson_count(doc_id, rate, seed=17):
    u = int(hashlib.md5(f"{seed}:1:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u and n < 160:
        n += 1
        p *= rate / n
        total += p
    return n


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns, left = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL).cache()
        assert docs.columns == columns
        got = {r.doc_id for r in docs.collect()}
        pairs = [(d, r.text) for d, r in left.items()]
        if name == "language_id":
            # The given documents are all in learned languages, so only those without letters go.
            assert got == {d for d, t in pairs if re.search(r"[^\W\d_]", t or "")}
        elif name == "exact_dedup":
            assert got == set({brute.low(t): d for d, t in sorted(pairs)}.values())
        elif name == "near_dedup":
            assert got == {d for d, (_, c, _) in brute.near(pairs).items() if c == d}
        else:
            assert got == {d for d, t in pairs if not brute.contamination(t, items)[1]}
        left = {d: left[d] for d in got}
    size, sources = {}, {r.source for r in left.values()}
    for r in left.values():
        size[r.source] = size.get(r.source, 0) + max(len(r.text or ""), 1)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    expected = {(d, k) for d, r in left.items() for k in range(1, 1 + poisson_count(d, sum(size.values()) / len(sources) / size[r.source]))}
    assert {(r.doc_id, r.copy_no) for r in mixed.collect()} == expected
    assert {(r.doc_id, r.copy_no) for r in corpus_pipeline.run(spark, SMALL).collect()} == expected


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SMALL)
    rel = con.execute(ORACLES[name])
    names = sorted(d[0] for d in rel.description)
    assert names == sorted(got.columns)
    order = [[d[0] for d in rel.description].index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())
