"""Quality rules: a table of thresholds compiled into one projection of text measures, DataFrame functions only.

A rule bounds one measure by another (``per``): ``least <= 1000 * measure / per <= most``, in whole
thousandths, so that every engine decides alike. ``compiled`` turns a table of rules into columns over
``measures``; the text is read once, nothing is shuffled and no Python runs on the executors.

Repeated words are found within each text: the words and then the windows of 8 of them are hashed (64 bits; two
different windows of a text of n words collide with a chance of about n^2 / 2^64) and, only where a hash occurs twice, sorted with their
positions, so the time grows with n log n whatever repeats. Memory is some 100 bytes a word of the longest
text (200 more where windows repeat), in the task that holds the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm.columns import fresh, named

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus, lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "with", "for", "be", "by", "on", "as", "at", "this", "have",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "pour", "dans", "en", "sur", "par",
    "der", "die", "das", "und", "ein", "eine", "von", "mit", "zu", "den", "ist", "nicht", "sich", "auf", "für",
    "el", "los", "las", "una", "y", "del", "se", "por", "con", "para", "es", "su", "al",
)


@dataclass(frozen=True)
class Rule:
    """``least <= 1000 * measure / per <= most`` where ``per`` is at least ``enough``; an open side is None."""

    name: str
    measure: str
    per: str
    least: int | None = None
    most: int | None = None
    enough: int = 1


RULES = (
    Rule("word_length", "word_chars", "n_words", least=3000, most=10000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("letter_words", "n_letter_words", "n_words", least=700),
    Rule("stop_words", "n_stop_words", "n_words", least=20, enough=50),
    Rule("capitals", "n_capitals", "word_chars", most=500),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=300, enough=10),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900, enough=10),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=300, enough=10),
)


def _but(text: Column, cut: str) -> Column:
    return F.length(F.regexp_replace(text, cut, "")).cast("long")


def _pairs(column: str, fn) -> Column:
    """``fn`` of each two neighbours in an array column."""
    n = F.greatest(F.size(column) - 1, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, 2, n), fn)


def _count(items: str, holds) -> Column:
    return F.size(F.filter(items, holds)).cast("long")


def measures(docs: DataFrame, keep: Sequence[str] = (), text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Columns ``keep`` of ``docs`` as they are (as k0, k1, ...), then one long column per measure.

    Projections follow each other because a column that a lambda reads has to be computed first: inside the
    lambda it would be computed for every element.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    got = docs.select(*[named(c).alias(k) for c, k in zip(keep, kept)], F.coalesce(named(text), F.lit("")).alias("t"))
    got = got.select(
        *kept, "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+", -1), "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    spoken = {form for w in stop_words for form in (w.lower(), w.capitalize(), w.upper())}
    simple = [
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - _but(F.col("t"), f"[{SYMBOLS}]+")).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
        _count("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z")).alias("n_cut_lines"),
        _count("words", lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
        _count("words", lambda w: w.isin(*sorted(spoken))).alias("n_stop_words"),
        _but(F.col("t"), r"\P{Lu}+").alias("n_capitals"),
    ]
    names = [*kept, *_MEASURES[:-1]]
    got = got.select(*kept, *simple, F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("hashed"))
    starts = F.sequence(F.lit(0), F.size("hashed") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.col("hashed")[i + k] for k in range(WINDOW)]))
    got = got.select(*names, windows.alias("hashes"))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    got = got.select(*names, F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).alias("placed"))
    twice = F.flatten(_pairs("placed", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    got = got.select(*names, F.sort_array(F.array_distinct(twice)).alias("at"))
    covered = F.aggregate(_pairs("at", lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda total, n: total + n)
    return got.select(*names, F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))


_MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines",
    "n_letter_words", "n_stop_words", "n_capitals", "n_repeat_words",
)


def broken(rule: Rule) -> Column:
    """Whether a text breaks a rule; with too little to measure against, it does not."""
    value, per = F.col(rule.measure) * 1000, F.col(rule.per)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < per * rule.least)
    if rule.most is not None:
        out = out | (value > per * rule.most)
    return (per >= rule.enough) & out


def compiled(rules: Sequence[Rule]) -> Column:
    """Names of the broken rules, in the table's order, as one array expression."""
    unknown = {c for r in rules for c in (r.measure, r.per)} - set(_MEASURES)
    if unknown or any(r.enough < 1 for r in rules):
        raise ValueError(f"no such measure, or not enough to measure against: {', '.join(sorted(unknown))}")
    if not rules:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda name: name.isNotNull())


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with the measures, ``base_failed``, ``broken`` and ``kept``; and their names.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words lie in 8-word windows that occur twice or
    more in the text (first occurrence included). ``broken`` lists the rules of the table that the text
    breaks; ``kept`` is true if there is none and the base holds. Names that ``docs`` has already get
    underscores in front; the mapping gives the name in use.

    Words are runs of anything but space and the controls tab to carriage return. A null text has no words
    and fails, as an empty one does. Rows are judged one by one by their text, so repeated rows, null ids and
    other columns change nothing; no rows give no rows. A text is never cut, however long it is (see the
    module for its memory).
    """
    names = {name: fresh(docs, name) for name in (*_MEASURES, "base_failed", "broken", "kept")}
    got = measures(docs, docs.columns, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    got = got.select("*", failed.alias("base_failed"), compiled(rules).alias("broken"))
    got = got.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))
    # A later filter on these columns stops at the generator; pushed below the projections it would repeat them.
    kept = got.columns[: len(docs.columns)]
    got = got.select(*kept, F.inline(F.array(F.struct(*names))))
    return got.toDF(*docs.columns, *names.values()), names


def passing(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns."""
    got, names = quality_rules(docs, rules, text)
    return got.where(named(names["kept"])).select(*[named(c) for c in docs.columns])
