"""Registered queries of the corpus operators: each applies one to its whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunweave.llm import (
    collocations,
    conversation_repair,
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    lm,
    mixing,
    near_dedup,
    quality,
    quality_rules,
    sanitise,
    substring_dedup,
)
from sunweave.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_substring_dedup")
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that lie in repeated passages, and verbatim runs of words (with their
    start and end) that do not depend on lines, with where each first occurs."""
    docs = table(spark, sf_dir, "documents")
    # The runs are written before the lines are looked for, so that the shuffles of one are gone when the other begins.
    runs = stage(substring_dedup.verbatim_runs(docs).drop("key").withColumn("words", F.col("end") - F.col("start")), "runs")
    lines = substring_dedup.repeated_passages(docs).drop("text_hash")
    return lines.unionByName(runs, allowMissingColumns=True)


@query("op2_benchmark_decontamination", rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
spans AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM spans),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))),
found AS (SELECT p.doc_id, p.k, p.i, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.g = x.g),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""")
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in all documents, by winnowed fingerprints."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found, n_words, spans, items = decontaminate.contamination(docs, benchmark, keep=["doc_id"])
    n_hit = decontaminate.hit_words(spans)
    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"),
    )


@query("op3_line_dedup", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i, translate(array_to_string(ls[i : i + 2], chr(10)), '{UPPER}', '{LOWER}') AS g
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
gone_lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN t ELSE array_to_string(
    list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END) AS clean_sha256
FROM d LEFT JOIN gone_lists ON d.doc_id = gone_lists.doc_id
""")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated three-line windows over all documents, later occurrences removed."""
    clean, n_lines, removed = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select(
        "doc_id", F.col(n_lines).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"),
    )


@query("op4_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""")
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents by composed fingerprints, confirmed chunk by chunk."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by positive-unlabelled learning."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a conditional random field over their words."""
    found, lang, score = language.identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


@query("op7_poisson_mixing", """
WITH d AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, greatest(coalesce(length(text), 0), 1) AS size FROM documents),
s AS (SELECT key, sum(size) AS size FROM d GROUP BY key),
r AS (SELECT key, (1.0::DOUBLE / (SELECT count(*) FROM s)) * (SELECT sum(size) FROM s)::DOUBLE / size::DOUBLE AS rate FROM s),
u AS (SELECT d.*, ('0x' || substr(md5('17:1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM d),
terms AS (SELECT key, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, (SELECT unnest(range(0, 161)) AS k)),
cdf AS (SELECT key, k, sum(p) OVER (PARTITION BY key ORDER BY k) AS c FROM terms),
n AS (SELECT key, list(c ORDER BY k) AS c FROM cdf GROUP BY key),
x AS (SELECT u.*, unnest(range(1, len(list_filter(n.c, lambda v: v <= u)) + 1)) AS copy_no FROM u JOIN n ON u.key = n.key)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no,
  md5('17:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy_no) AS shuffle_key
FROM x
""")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that every source has the same expected share of characters."""
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


@query("op8_pii_sanitisation")
def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms next to it that give it away."""
    found = sanitise.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = sanitise.written(F.col("spans"))
    terms = sanitise.written(F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    every = F.array_join(F.filter(F.array(base, terms), lambda x: x != ""), ",")
    return found.select("doc_id", *[count(k) for k in sanitise.PATTERNS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


@query("op9_minhash_near_dedup")
def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by SetSketch bands, verified on full shingle sets."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of all documents under a gated recurrent model and under exact token counts."""
    return lm.language_model_scores(table(spark, sf_dir, "documents"))


@query("op11_phrase_collocations", rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
said AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
places AS (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM said, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM places) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= {collocations.LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1) c
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM cuts),
held AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM often WHERE m > 2)) GROUP BY ALL),
top AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase
  WHERE q = 1 AND coalesce(100 * around < {collocations.INSIDE} * a, true))
SELECT top.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM top JOIN totals ON top.lang = totals.lang
WHERE rank <= {collocations.FIRST}
""")
def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most tightly bound phrases of each language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _emit(state: str, role: str, text: str, cost: str, initial: str) -> str:
    line = f"{state}.t || CASE WHEN {state}.n = 0 THEN '' ELSE chr(10) END || {role} || ':' || {text}"
    return f"struct_pack(c := {state}.c + {cost}, e := {state}.e || '{initial}', n := {state}.n + 1, t := {line})"


def _repair_sql() -> str:
    """Recursive SQL for op12: rows in order, four states, insertions before each row and at the end."""
    insert_u = lambda s: _emit(s, "'user'", "''", "5", "I")
    insert_a = lambda s: _emit(s, "'assistant'", "''", "5", "I")
    best = lambda *cells: f"list_sort([{', '.join(cells)}])[1]"
    drop = lambda s: f"struct_pack(c := {s}.c + 2, e := {s}.e || 'D', n := {s}.n, t := {s}.t)"
    never = "struct_pack(c := 1000000000, e := '', n := 0, t := '')"
    may = lambda cell, when: f"CASE WHEN {when} THEN {cell} ELSE {never} END"
    keep = lambda s, i: may(_emit(s, "role", "text", "extra", "K"), f"stays AND left(role, 1) = '{i}'")
    turn = lambda s, r: may(_emit(s, f"'{r}'", "text", "1 + extra", "R"), "stays")
    to_u = ", ".join(f"{x}" for s in ("n1", "s1", "a1") for x in (keep(s, "u"), turn(s, "user")))
    inserted = f"""n AS n1, s AS s1, {best('u', insert_u('n'), insert_u('s'), insert_u('a'))} AS u0, a AS a0"""
    filled = f"""n1, s1, u0, a0, {best('u0', insert_u('a0'))} AS u1, {best('a0', insert_a('u0'))} AS a1"""
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bits AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc FROM raw),
harmed AS (
  SELECT conv_id, turn, fault, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS fault FROM bits) WHERE fault <> 0),
twice AS (SELECT * FROM harmed UNION ALL SELECT * FROM harmed WHERE fault = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM twice),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
    lag(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
rows_in AS (
  SELECT *, NOT blank AND NOT again AS stays, CASE WHEN NOT blank AND NOT again AND cut THEN 5 ELSE 0 END AS extra FROM seen),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (stays AND cut) AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last_i
  FROM rows_in GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0, e := '', n := 0, t := '') AS n, {never} AS s, {never} AS u, {never} AS a FROM facts
  UNION ALL
  SELECT conv_id, i, {drop('n1')}, {best(drop('s1'), keep('n1', 's'))}, {best(drop('u1'), to_u)},
    {best(drop('a1'), keep('u1', 'a'), turn('u1', 'assistant'))}
  FROM (SELECT conv_id, i, role, text, stays, extra, {filled}
    FROM (SELECT w.conv_id, r.i, r.role, r.text, r.stays, r.extra, {inserted} FROM walk w JOIN rows_in r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
ends AS (
  SELECT w.conv_id, {best('n1', 'a1')} AS x
  FROM (SELECT conv_id, {filled} FROM (SELECT w.conv_id, {inserted} FROM walk w JOIN facts f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.last_i)) w)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.e, '') AS audit,
  sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op12_conversation_repair", _repair_sql())
def conversation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with planted faults: what is wrong, the cheapest repair, and the repaired text's hash."""
    conversations = table(spark, sf_dir, "conversations")
    mended = conversation_repair.repair(conversation_repair.damaged(conversations))
    hashes = conversation_repair.digests(mended.rows).withColumnRenamed("conv_id", "hashed")
    summary = mended.summary.withColumnRenamed("conv_id", "known")
    every = conversations.select("conv_id").distinct()
    got = every.join(summary, F.col("conv_id").eqNullSafe(F.col("known")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _broken_sql(rule: quality_rules.Rule) -> str:
    sides = [f"1000 * {rule.measure} < {rule.per} * {rule.least}"] if rule.least is not None else []
    sides += [f"1000 * {rule.measure} > {rule.per} * {rule.most}"] if rule.most is not None else []
    return f"CASE WHEN {rule.per} >= {rule.enough} AND ({' OR '.join(sides)}) THEN '{rule.name}' END"


_STOP_FORMS = sorted({form for w in quality_rules.STOP_WORDS for form in (w.lower(), w.capitalize(), w.upper())})


@query("op13_quality_rules", rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
places AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM places),
again AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS pos FROM twice WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{quality_rules.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in _STOP_FORMS)}))) AS n_stop_words,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_capitals
  FROM d LEFT JOIN again ON d.r = again.r),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    array_to_string(list_filter([{", ".join(map(_broken_sql, quality_rules.RULES))}], lambda x: x IS NOT NULL), ',') AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken
FROM v
""")
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents and the rules of the threshold table that they break."""
    got, _ = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken"),
    )
