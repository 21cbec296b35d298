"""Every registered query runs; those with SQL equal DuckDB row by row."""

import glob
import os
import re

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORPUS = re.compile(r"op\d+_|pipeline$")  # tests of their own


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not CORPUS.match(n)))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    ours = [tuple(r) for r in df.collect()]
    assert ours
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert normal(ours, df.columns) == normal(rel.fetchall(), names)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
