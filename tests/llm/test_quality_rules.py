"""Quality rules against plain Python, on odd rows, and on an empty table."""

import re
from collections import Counter

import pytest

from sunweave.llm import quality_rules as Q

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words int, kept string, `a.b` string"


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


def measured(df, rules=Q.RULES):
    got, names = Q.quality_rules(df, rules)
    wanted = [names[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "kept")]
    return [(r["doc_id"], r["text"], *[r[n] for n in wanted]) for r in got.collect()]


def test_measures_equal_plain_python(spark):
    got = measured(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert len(got) == 200
    for _, text, *values, broken, kept in got:
        assert tuple(values) == plain(text)
        assert kept == (not values[-1] and not broken)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
    texts = [
        None, "", " \t\n ", long, long, long + " " + long, "the same eight words again and again here " * 40, "x", "\n\n\n",
        "a\x0bb\x0cc\rd", "é🙂 " * 30, "#" * 500, "A LOUD TEXT " * 3 + "of many words that are all different from one another so far",
        "\n".join(["- item of a list"] * 12), " one two\u0085three",
    ]
    df = spark.createDataFrame([(None if i % 5 == 0 else i // 2, t, None, 3, "x", None) for i, t in enumerate(texts)], SCHEMA)
    got, names = Q.quality_rules(df)
    assert got.columns[:6] == df.columns and names["n_words"] == "_n_words" and names["kept"] == "_kept"
    found = measured(df)
    assert sorted((x[0] is None, x[0], x[1] or "") for x in found) == sorted((r[0] is None, r[0], r[1] or "") for r in df.collect())
    for _, text, *values, _, _ in found:
        assert tuple(values) == plain(text)
    assert Q.passing(df).columns == df.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert not Q.quality_rules(empty)[0].collect() and not Q.passing(empty).collect()


def test_rules_are_taken_from_the_table(spark):
    words = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, words), (2, words + " " + "% " * 10), (3, "of the " + words)], "doc_id long, text string")
    rules = [Q.Rule("symbols", "n_symbols", "n_words", most=100), Q.Rule("stop", "n_stop_words", "n_words", least=1, enough=31)]
    got = {x[0]: (x[-2], x[-1]) for x in measured(df, rules)}
    assert got == {1: ([], True), 2: (["symbols", "stop"], False), 3: ([], True)}
    assert all(x[-1] for x in measured(df, []))
    with pytest.raises(ValueError):
        Q.compiled([Q.Rule("x", "no_such", "n_words", most=1)])


def test_no_python_and_no_shuffle(spark):
    got, _ = Q.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_most_labelled_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got, _ = Q.quality_rules(docs)
    rows = got.join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_filters_on_the_verdict_do_not_repeat_the_measures(spark):
    kept = Q.passing(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 2 and plan.index("Filter") < plan.index("inline(")
