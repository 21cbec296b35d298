"""Each corpus operator against brute force, on odd rows, and on an empty table."""

import time
import math
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from sunweave.llm import decontaminate, exact_dedup, graph, language, line_dedup, links, lm, mixing, near_dedup, quality, sanitise, substring_dedup

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed int, copy_no int, `a.b` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = [
        (1, line), (1, line), (2, None), (None, line.upper()), (None, None), (3, ""), (4, " \t\n "), (5, long), (6, long),
        (7, long + " tail"), (8, "a b c"), (8, "d e f"), (9, "A b C"), (10, f"x\n{line}\ny\nz"), (11, f"x\n{line}\ny\nz"),
        (12, "\n\n\n"), (13, "é" * 300), (14, "1234 5678"), (15, "mail a@b.co and a@b.co"), (16, "🙂 ok"),
    ]
    rows = [(d, t, None if (d or 0) % 3 == 0 else "en", None if (d or 0) % 4 == 0 else f"s{(d or 0) % 2}", None, 1, 2, None) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_near_duplicates_equal_brute_force(docs, pairs):
    assert {r[0]: r[1:] for r in rows(near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept"))} == brute.near(pairs)


def test_one_of_each_group_stays_whatever_its_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    far = " ".join(f"v{i}" for i in range(60))
    rows_ = [(None, text + " end"), (None, "more " + text), (4, text), (4, "quite another text of a few words only here"), (7, text + " x"), (None, "alone among all"), (None, None), (None, ""), (None, far), (None, far + " y")]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted(rows(near_dedup.keep_one(df)), key=str)
    assert got in [sorted([rows_[2], rows_[3], *rows_[5:8], x], key=str) for x in rows_[8:]]


def test_near_duplicates_in_families(spark):
    """Copies of one text, each with words of its own: some linked, some just below the threshold."""
    texts = []
    for i in range(90):
        w = [f"w{j}" for j in range(150)]
        for j in range(1 + i % 6):
            w[(i * 37 + j * 29) % 150] = f"own{i}-{j}"
        texts.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r[0]: r[1:] for r in rows(got.select("doc_id", "n_shingles", "component_id", "kept"))} == brute.near(texts)


def test_blocks_and_rows_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(links, "SMALL", 2)
    monkeypatch.setattr(links, "BLOCK", 16)
    test_near_duplicates_in_families(spark)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = rows(near_dedup.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {}
    for d, n, c, kept in got:
        by.setdefault(d, []).append((n, c, kept))
    assert by[1] == [(8, 1, True)] * 2 and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)]
    assert sorted(by[None], key=str) == [(0, None, True), (8, 1, False)]
    assert by[5][0][1:] == (5, True) and by[6][0][1:] == (5, False) and by[7][0][1:] == (5, False)
    assert by[9] == [(1, 8, False)] and sorted(c for _, c, _ in by[8]) == [8, 8]
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and rows(near_dedup.keep_one(empty)) == rows(near_dedup.near_duplicates(empty)) == []


def test_estimate_is_close(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = rng.integers(1, 1 << 63, 3000, dtype=np.uint64)
    a, b = values[:2000], values[500:]
    both = near_dedup.registers(np.concatenate([a, b]), np.array([0, 2000]), 512).astype(int)
    n = np.array([2000.0]), np.array([2500.0])
    got = near_dedup.estimate((both[:1] > both[1:]).sum(1), (both[:1] < both[1:]).sum(1), 512, *n)
    assert abs(got[0] - 1500 / 3000) < 0.07


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 3), *[(100 + i, 101 + i) for i in range(40)]]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 1, 9: 1, 10: 1, **{100 + i: 100 for i in range(41)}}
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def test_exact_duplicates(docs, pairs, odd, empty):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()}
    same = {}
    for d, t in pairs:
        same.setdefault(brute.low(t), []).append(d)
    assert got == {d: (max(ids), len(ids), d == max(ids), brute.sha(t)) for t, ids in same.items() for d in ids}
    by = {}
    for r in exact_dedup.exact_duplicates(odd).collect():
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(1, 3, True)] * 2 and (1, 3, False) in by[None] and by[2] == [(3, 3, False)] and by[5] == [(6, 2, False)]
    left = exact_dedup.deduplicate(odd)
    assert left.columns == odd.columns and left.where("doc_id = 1").count() == 1 and left.count() == len({brute.low(t) for t, in rows(odd.select("text"))})
    assert rows(exact_dedup.exact_duplicates(empty)) == rows(exact_dedup.deduplicate(empty)) == []


def test_colliding_fingerprints_are_told_apart(spark):
    """With base 1 the fingerprint is a sum of bytes: anagrams collide and only comparison parts them."""
    df = spark.createDataFrame([(1, "abc"), (2, "cab"), (3, "ABC"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df, bases=(1, 1), chunk=2).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_fingerprints_compose():
    import numpy as np
    import pyarrow as pa

    from sunweave.llm import words as W

    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    block = next(W.blocks(pa.array([text, text[:1700], text[1700:]])))
    whole, left, right = (int(x) >> 31 for x in exact_dedup.fingerprints(block, chunk=64))
    assert exact_dedup.compose(left, 1700, right) == whole
    assert np.array_equal(exact_dedup.fingerprints(block, chunk=64), exact_dedup.fingerprints(block, chunk=1 << 16))


def contamination(docs, benchmark, **more):
    found, n, spans, items = decontaminate.contamination(docs, benchmark, keep=["doc_id"], **more)
    return [tuple(r) for r in found.select("doc_id", n, decontaminate.hit_words(spans), items).collect()]


def test_contamination(spark, docs, pairs, odd, empty):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, "one two three"), (901, None), (902, ""), (903, pairs[3][1]), (904, "Ten ELEVEN twelve"), (None, "a b c"), (905, "a a a a a a a a a a a a"), (None, "nobody named this passage of rare words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(5000, "a " * 30), (5001, "zz one two three one two zz ten eleven twelve"), (5002, "a " * 9), (5003, "x Nobody named THIS passage of rare words y"), (5004, "c a b c")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    expected = sorted((d, n, h, [x for x in i if x != "None"]) for d, t in [*pairs, *more] for n, h, i in [brute.contamination(t, items)])
    assert (5003, 9, 7, []) in expected and (5004, 4, 3, []) in expected
    assert sorted(contamination(df, bench)) == expected
    assert sorted(contamination(df, bench, block_bytes=2000)) == expected
    clean = decontaminate.decontaminate(odd, bench)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} >= {2, 3, 4, 5, 12}
    assert 1 not in {r.doc_id for r in clean.collect()}
    assert rows(decontaminate.decontaminate(empty, bench)) == [] and decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_lines(docs, pairs, odd, empty):
    clean, n_lines, removed = line_dedup.dedup_lines(docs)
    got = {r.doc_id: (r.text, r[n_lines]) for r in clean.collect()}
    ordered = sorted(pairs)
    assert got == {d: (c, t.count("\n") + 1) for (d, t), c in zip(ordered, brute.clean_lines([t for _, t in ordered]))}
    clean, _, removed = line_dedup.dedup_lines(odd)
    assert removed == "_removed" and clean.columns[: len(odd.columns)] == odd.columns and clean.count() == odd.count()
    by = {r.doc_id: r for r in clean.collect()}
    assert by[10].text.startswith("x\n") and by[11].text == "" and by[11]["_removed"] == [0, 1, 2, 3] and by[2].text is None
    assert rows(line_dedup.dedup_lines(empty)[0]) == []


def test_passages(docs, pairs, odd, empty):
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == brute.passages(sorted(pairs))
    found = substring_dedup.repeated_passages(odd)
    by = {(r.doc_id, r.line): r for r in found.collect()}
    assert set(by) == {(5, 0), (6, 0), (7, 0)} and not by[5, 0].removed and by[7, 0].first_doc_id == 5
    cut = substring_dedup.remove_passages(odd)
    text = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == odd.columns and text[6] == text[7] == "" and len(text[5]) > 1000 and text[2] is None
    assert rows(substring_dedup.repeated_passages(empty)) == rows(substring_dedup.remove_passages(empty)) == []


def test_verbatim_runs(spark, docs, pairs, odd, empty):
    """Runs of 50 words and more are found wherever lines break, to the exact word."""
    word = lambda k, i: f"t{k}x{i * i % 7919}"
    own = [[word(k, i) for i in range(300)] for k in range(8)]
    run = [word("run", i) for i in range(60)]
    inside = [
        " ".join(own[0][:90] + run + own[0][90:]), " ".join(own[1][:7] + run + own[1][7:]), " ".join(own[2] + run[:49]),
        "\n".join(" ".join(x[i : i + 7]) for x in [own[3][:40] + run[5:58] + own[3][40:]] for i in range(0, len(x), 7)),
        " ".join(own[4]) + "\n" + " ".join(run[10:]).upper(), " ".join(own[5] + own[5][100:170]), "a b c " * 60, " ".join(own[5]),
    ]
    made = [*sorted(pairs), *[(10**6 + i, t) for i, t in enumerate(inside)]]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    found = substring_dedup.verbatim_runs(df).collect()
    every = {(r.doc_id, i) for r in found for i in range(r.start, r.end)}
    later = {(r.doc_id, i) for r in found if r.removed for i in range(r.start, r.end)}
    assert (every, later) == brute.verbatim(made)
    first = {r.doc_id: (r.first_doc_id, r.first_start, r.start, r.end) for r in found if r.removed and r.doc_id >= 10**6}
    assert first[10**6 + 1] == (10**6, 90, 7, 67) and 10**6 + 2 not in first and first[10**6 + 5] == (10**6 + 5, 100, 300, 370)
    text = {r.doc_id: r.text for r in substring_dedup.remove_passages(df).collect() if r.doc_id >= 10**6}
    assert text[10**6] == inside[0] and text[10**6 + 1] == " ".join(own[1]) and text[10**6 + 4] == " ".join(own[4])
    assert brute.words(text[10**6 + 3]) == own[3] and text[10**6 + 6] == "a b c " and text[10**6 + 7] == ""
    assert {(r.doc_id, r.end, r.removed) for r in substring_dedup.verbatim_runs(odd).collect() if r.start == 0} >= {(5, 40_000, False), (6, 40_000, True)}
    assert rows(substring_dedup.verbatim_runs(empty)) == []


def test_mixing(spark, docs, odd, empty):
    got, copy_no, key = mixing.mix(docs, repeat=6.0)
    sizes = dict(rows(got.groupBy("source").agg(F.sum(F.length("text")))))
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert abs(sum(sizes.values()) / (6 * total) - 1) < 0.2
    again = rows(mixing.mix(docs.repartition(7), repeat=6.0)[0].select("doc_id", copy_no, key))
    assert sorted(again) == sorted(rows(got.select("doc_id", copy_no, key)))
    only, copy_no, _ = mixing.mix(docs, weights={"src1": 2.0}, repeat=3.0)
    assert {r.source for r in only.collect()} == {"src1"}
    mean = {r.key: r.rate for r in mixing.rates(docs).collect()}
    drawn = mixing.mix(docs, repeat=200.0)[0].groupBy("source").count()
    n = dict(rows(docs.groupBy("source").count()))
    for source, many in rows(drawn):
        expected = 200 * mean["=" + source] * n[source]
        assert abs(many - expected) < 6 * math.sqrt(expected)
    mixed, copy_no, _ = mixing.mix(odd)
    assert copy_no == "_copy_no" and mixed.columns[: len(odd.columns)] == odd.columns and mixed.count() > 0
    assert rows(mixing.mix(empty)[0]) == [] and rows(mixing.mix(docs, weights={})[0]) == []


def test_poisson_inversion(spark):
    cdf = spark.range(1).select(mixing._distribution(F.lit(2.5)).alias("c")).first().c
    assert all(abs(cdf[k] - sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(k + 1))) < 1e-12 for k in range(20))


def test_base_spans(spark, docs, pairs, odd, empty):
    hard = [
        "a@b.c_d@e.f", "x..y%+-@h-1.co.uk, z@nope", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.01.1", "4111 1111 1111 1111 4111-1111-1111-1111",
        "41111111111111111111111 5", "+1 (736) 555-2678. +1-2 +49 30.1234567-", "é🙂 q@é.com p@q.r🙂 +123456789", "1" * 5000, "a" * 20000, "a.b@c." * 3000,
        "12--4111111111111111", "@@@ a@b.c@d.e", "+" * 50 + "1234567890", "", None,
    ]
    all_ = [*pairs, *[(10_000 + i, t) for i, t in enumerate(hard)]]
    df = spark.createDataFrame(all_, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in sanitise.personal_data(df).collect()}
    assert got == {d: brute.base_spans(t) for d, t in all_}
    found = {}
    for r in sanitise.personal_data(odd).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert len(found[15][0].spans) == 2 and len(found[1]) == 2 and found[2][0].spans == []
    clean = sanitise.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert {r.text for r in clean.where("doc_id = 15").collect()} == {"mail [email] and [email]"}
    assert rows(sanitise.personal_data(empty)) == rows(sanitise.sanitise(empty)) == []


def test_disclosing_terms(spark):
    """A nickname that stands only next to one address gives it away; a common word does not."""
    texts = [(i, f"note {i} zorro writes from box{i} z@m.org about item{i}") for i in range(6)]
    texts += [(100 + i, f"note {i} writes about item{i} and more") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in sanitise.personal_data(df).collect():
        terms = [texts[r.doc_id][1][t.start : t.end] for t in r.terms] if r.doc_id < 100 else []
        assert ("zorro" in terms) == (r.doc_id < 100) and not {"note", "writes", "about"} & set(terms) and (r.doc_id < 100 or not r.terms)
    clean = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    assert clean[0] == "note 0  writes  0 [email] about item0" and clean[100] == texts[6][1]


def test_disclosing_terms_at_any_distance(spark):
    """A telling term is found far from the address, and wherever it stands again in the text."""
    far = " and more about it" * 40
    texts = [(i, f"z@m.org{far} zorro {i}{far} Zorro.{far}" + " zorro" * (i % 2)) for i in range(6)]
    texts += [(100 + i, f"note {i}{far}") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in sanitise.personal_data(df).collect():
        text = texts[r.doc_id][1] if r.doc_id < 100 else ""
        assert [(t.start, t.end) for t in r.terms] == [m.span() for m in re.finditer("[zZ]orro", text)]
    clean = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    assert "orro" not in "".join(clean.values()) and clean[1] == f"[email]{far}  1{far} .{far} " and clean[100] == texts[6][1]


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert all(0 <= r.score <= 1 for r in held) and len(held) > 300
    right = {q: [r.predicted == q for r in held if r.quality == q] for q in (0, 1)}
    assert all(sum(x) / len(x) > 0.97 for x in right.values())


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 1), (8, 0), (8, 1), (None, 1), (10, None)], "doc_id long, quality int")
    got = quality.quality(odd, labels, steps=2)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert {r.score for r in quality.quality(odd, labels.limit(0), steps=2).collect()} == {0.5}
    assert rows(quality.quality(empty, labels, steps=2)) == []


def test_language_on_held_out_rows(docs, odd, empty):
    found, lang, score = language.identify(docs)
    held = found.where(quality.fold(F.col("doc_id"), 4) == 2).collect()
    assert len(held) > 20 and sum(r[lang] == r.lang for r in held) / len(held) > 0.95
    found, lang, score = language.identify(odd)
    assert found.count() == odd.count()
    by = {r.doc_id: (r[lang], r[score]) for r in found.collect()}
    assert by[2] == by[3] == by[4] == by[14] == by[12] == ("und", 0.0) and by[5][0] == "en"
    assert language.identified(odd).columns == odd.columns
    assert rows(language.identify(empty)[0]) == []


def test_only_texts_of_learned_languages_are_identified(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    russian = "привет мир это обычный русский текст который ни на одном из языков не написан и потому должен быть отвергнут".split()
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(4, 10))) for _ in range(200)) for _ in range(4)]
    strange = [" ".join(rng.choice(russian) for _ in range(200)) for _ in range(4)] + noise
    short = ["zxq", "привет мир", "1 2 3", None, ""]
    extra = spark.createDataFrame([(90_000 + i, t, None, "s", 1) for i, t in enumerate(strange + short)], docs.schema)
    kept = {r.doc_id for r in language.identified(docs.union(extra)).select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()}
    assert lettered - kept == set() and {90_008, 90_009} <= kept and not kept & {90_010, 90_011, 90_012}
    assert not kept & set(range(90_000, 90_008))


def test_without_labels_every_text_with_a_letter_stays(docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.identified(unlabelled).count() == docs.where(r"text rlike '\\p{L}'").count()


def test_code_switched_words(spark, docs):
    """Marginals of a text of two languages change sides where the language does."""
    import numpy as np
    import pyarrow as pa

    from sunweave.llm import words as W

    field = language.fit(language.sample(docs))
    texts = {r.lang: r.text for r in docs.where("n_chars > 800").collect()}
    a, b = (" ".join(texts[x].split()[:40]) for x in ("en", "de"))
    block = next(W.blocks(pa.array([f"{a} {b}"])))
    found = block.words(language.LETTERS)
    got, _ = language.marginals(language.emissions(block, found, field), found.count, field.moves)
    side = [field.languages[i] for i in got.argmax(1)]
    half = len(W.texts(pa.array([a]))[0].as_py().split())
    assert side[: half - 5].count("en") > 0.8 * (half - 5) and side[-30:].count("de") > 24


def test_marginals_equal_enumeration():
    """Segments and chains against the sum over all state sequences."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    score, moves, count = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([7, 0, 2])
    old, language.SEGMENT = language.SEGMENT, 3
    got, expected = language.marginals(score, count, moves, pairs=True)
    language.SEGMENT = old
    truth, steps, at = np.zeros((9, 2)), np.zeros((2, 2)), 0
    for n in (7, 2):
        total, part, part_steps = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=n):
            w = math.exp(sum(score[at + i, s] for i, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += w
            for i, s in enumerate(path):
                part[i, s] += w
            for x, y in zip(path, path[1:]):
                part_steps[x, y] += w
        truth[at : at + n], steps = part / total, steps + part_steps / total
        at += n
    assert np.allclose(got, truth) and np.allclose(expected, steps)


@pytest.mark.parametrize("head", [1 << 20, 500])
def test_language_model(docs, pairs, head):
    got = {r.doc_id: r for r in lm.language_model_scores(docs, head=head, rounds=2).collect()}
    base, n = brute.base_scores(pairs)
    assert set(got) == set(base)
    for d, (tokens, known, score) in base.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, brute.fold(d, 10) == 0)
        assert math.isclose(r.base_score, score, rel_tol=1e-9, abs_tol=1e-6) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.02


def test_language_model_does_not_depend_on_the_layout(docs):
    one, many = ({r.doc_id: r.score for r in lm.language_model_scores(docs.repartition(n)).collect()} for n in (1, 16))
    assert all(math.isclose(one[d], many[d], rel_tol=1e-6) for d in one)


def test_head_tokens_are_found_by_their_leading_bits():
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (0, 1, 3, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        zero = np.zeros(len(keys), np.int64)
        vocab = lm.Vocabulary(keys, zero, zero - 1, 0, 0, np.zeros(lm.TAIL), np.zeros(lm.TAIL), True)
        asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        where = {k: i for i, k in enumerate(keys.tolist())}
        assert vocab.find(asked).tolist() == [where.get(k, -1) for k in asked.tolist()]


def test_long_texts_are_tokenised_in_pieces():
    import numpy as np
    import pyarrow as pa

    from sunweave.llm import words as W

    texts = ["short text", " ".join(f"w{i % 999}" for i in range(700_000)) + " \n " * 5, None, "x" * 3_000_000, ""]
    got, held = [], []
    for _, h, count, more in lm.pieces(pa.array(texts)):
        held.append(h)
        if not more:
            got += np.split(np.concatenate(held), np.cumsum(count)[:-1]) if len(held) == 1 else [np.concatenate(held)]
            held = []
    whole = next(W.blocks(pa.array(texts), limit=1 << 30))
    h, count = lm.tokens(whole)
    assert len(got) == 5 and all((a == b).all() for a, b in zip(got, np.split(h, np.cumsum(count)[:-1])))
    trainer = lm._Trainer(lm.blank(), 0.01)
    before = [w.copy() for w in trainer.weights]
    trainer.learn([np.arange(100_000, dtype=np.int64).astype(np.int16) % 1000, *[np.zeros(3, np.int16)] * 127])
    assert trainer.seen == 100_000 + 3 * 127 and any((a != b).any() for a, b in zip(before, trainer.weights))


def test_language_model_is_a_distribution_and_its_gradient_is_right():
    import numpy as np

    vocab = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0, 0, np.zeros(lm.TAIL), np.zeros(lm.TAIL), True)
    weights = [w.astype(np.float64) + 0.05 * np.random.default_rng(1).normal(size=w.shape) for w in lm.starting(vocab)]
    every = np.arange(lm.WORDS + lm.TAIL)
    state = np.tile(np.random.default_rng(2).normal(size=lm.HIDDEN), (len(every), 1))
    assert abs(np.exp(lm._outputs(state, every, weights)[0]).sum() - 1) < 1e-5
    target = np.array([[5, 700], [1030, 9], [64, 1039]], dtype=np.int16)
    inputs = np.concatenate([np.full((1, 2), lm.START, np.int16), target[:-1]])

    def loss(w):
        h, _, _ = lm._forward(inputs, np.zeros((2, lm.HIDDEN)), w[0], w[1], False)
        return -lm._outputs(h.reshape(-1, lm.HIDDEN), target.ravel(), w)[0].sum()

    grads = [np.zeros_like(w) for w in weights]
    h, _, kept = lm._forward(inputs, np.zeros((2, lm.HIDDEN)), weights[0], weights[1], True)
    _, d = lm._outputs(h.reshape(-1, lm.HIDDEN), target.ravel(), weights, grads)
    lm._backward(kept, inputs, d.reshape(h.shape), weights, grads)
    for which, at in ((0, (lm.START, 3)), (0, (5, 40)), (1, (2, 7)), (1, (4, 45)), (2, (3, 1)), (4, (0, 2, 9)), (3, (16,)), (5, (1, 0))):
        moved = [w.copy() for w in weights]
        moved[which][at] += 1e-2
        back = [w.copy() for w in weights]
        back[which][at] -= 1e-2
        assert abs((loss(moved) - loss(back)) / 2e-2 - grads[which][at]) < 2e-3 * max(1, abs(grads[which][at]))


def test_language_model_of_odd_rows(odd, empty):
    got = lm.language_model_scores(odd, head=8, rounds=1)
    assert got.count() == odd.count() and got.where("score is null or isnan(score) or base_score is null").count() == 0
    one = got.where("doc_id = 1").collect()
    assert len(one) == 2 and one[0] == one[1]
    assert rows(lm.language_model_scores(empty, rounds=1)) == []


def test_staged_tables_leave_no_shuffle_files(spark):
    from sunweave.session import stage

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shuffled = lambda: {x for x in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffled()
    rows = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert rows.count() == 7


def test_pipeline_field_learns_from_every_text(spark):
    many = 3 * language.DOCS_PER_LANGUAGE
    own = lambda i: "".join(chr(97 + int(x)) for x in f"{i:04d}")
    rows = [(None if i % 9 == 0 else i, f"the {own(i)}q {own(i)}q {own(i)}q", "en") for i in range(many)]
    rows += [(i, f"der {own(i)}z {own(i)}z {own(i)}z", "de") for i in range(many)] + [(1, None, "en"), (2, "x", None), (3, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    field = language.fit_all(docs, part_bytes=2000)
    assert field.languages == ["de", "en", "fr"] and len(field.lexicon) == 2 * many + 2
    assert sorted(set(field.meaning.tolist())) == [0, 1]
    again = language.fit_all(docs.repartition(2), part_bytes=2000)
    assert (again.weights == field.weights).all() and (again.moves == field.moves).all()
    assert language.fit_all(docs.where("lang is null")) is None
    copies = spark.createDataFrame([(1, rows[5][1], "en")] * 300 + [(2, rows[-5][1], "de")] * 300, docs.schema)
    assert abs(language.fit_all(copies, part_bytes=200).weights).max() > 0


def test_fitting_a_part_takes_memory_by_block_not_by_part():
    """fitting 4 MB of text took 39 times its bytes, now 8; with it an executor passed its memory."""
    import tracemalloc

    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 12)))
    lists = {lang: [word(letters) for _ in range(5000)] for lang, letters in (("a", "abcdefghij"), ("b", "fghijklmno"), ("c", "klmnopqrst"))}
    texts = [(" ".join(rng.choices(lists[lang], k=400)), lang) for lang in lists for _ in range(470)]
    size = sum(len(t) for t, _ in texts)
    assert size > 4_000_000
    given = language.fit(texts[::50], steps=0)
    tracemalloc.start()
    field = language.fit(texts, given=given, batch=language.BATCH_WORDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * size, peak / size
    assert abs(field.weights).max() > 0


def test_words_of_a_part_do_not_depend_on_its_blocks():
    import numpy as np

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["der", "the", "Über", "naïve", "x", "zwei2drei", "..."]) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + ["", "1 2", "the " * 300]
    whole = language._spelled(texts)
    for limit in (1, 16, 100):
        assert all((a == b).all() for a, b in zip(whole, language._spelled(texts, limit)))
    names, slots, many, back, count = whole
    split = [re.findall(r"[a-z\x80-\U0010ffff]+", t.lower().replace("Ü", "ü")) for t in texts]
    assert count.tolist() == [len(x) for x in split] and len(names) == len({w for x in split for w in x})
    assert len(slots) == many.sum() and len(np.unique(back)) == len(names)
    assert all(len(x) == 0 for x in language._spelled([])) and language._spelled([""])[4].tolist() == [0]
