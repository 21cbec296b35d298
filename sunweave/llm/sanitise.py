"""Personal data and the terms that give it away, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern.
Each distinct value is a protected entity. How strongly a term of the same text reveals it is read
off the corpus: information content ``IC(e) = -log2 p(e)`` and pointwise mutual information
``PMI(e; t) = log2 p(e, t) / (p(e) p(t))`` over documents. A term with ``PMI / IC`` of at least
``GENERALISE`` narrows the entity down too much and is generalised, of at least ``REMOVE`` removed.
Both need ``SUPPORT`` different texts in which term and entity stand together: a single text proves no
association.

Text is scanned once for spans and once for the document frequencies of terms; only texts that hold
spans, and counts, are shuffled. Pairs are made of terms and entities in at least ``SUPPORT`` texts each
that are rare enough to reach the threshold if they never stood apart. Patterns are written so that matching takes linear time in any text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm.columns import checked_broadcast, fresh, named
from sunweave.session import stage

#: Kinds in output order. Possessive loops and look-behinds only spare attempts that cannot match:
#: an address starts where its run of local-part characters does or where the last match ended, and a
#: card number is a whole run of 13 to 19 digits with single separators.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}'’-]+"
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end, value) of all matches, or of those whose value ``keep`` holds for, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("all"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        more = F.concat(acc["all"], F.array(span))
        return F.struct(end.alias("at"), (F.when(keep(pair["value"]), more).otherwise(acc["all"]) if keep else more).alias("all"))

    whole = F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), start, step, lambda acc: acc["all"])
    return F.when(F.size(found) > 0, whole).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _of_kind(kind: str, spans: Column) -> Column:
    spans = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value): kinds in order, each from left to right; null text has none."""
    text = F.coalesce(text, F.lit(""))
    kinds = []
    for kind, pattern in PATTERNS.items():
        spans = _of_kind(kind, located(text, pattern))
        sign = {"email": "@", "phone": "+"}.get(kind)
        kinds.append(F.when(F.contains(text, F.lit(sign)), spans).otherwise(F.array().cast(_SPAN)) if sign else spans)
    return F.concat(*kinds)


def entity(span: Column) -> Column:
    """The value behind a span, however written: lower case, or its digits."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with every character of ``spans`` replaced by a space."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, span: Column) -> Column:
        begin, end = F.greatest(span["start"], acc["at"]), F.greatest(span["end"], acc["at"])
        parts = F.concat(acc["parts"], F.array(text.substr(acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), end - begin)))
        return F.struct(end.alias("at"), parts.alias("parts"))

    places = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(places, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text))))


def spoken(text: Column) -> Column:
    """The distinct terms of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(texts: DataFrame, docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """``text_hash, term, ratio`` of the terms of each text whose PMI with one of its entities is at least
    ``threshold`` of the entity's information content (the largest such ratio).

    ``texts`` has ``text_hash, n, entities, terms`` of each distinct text with spans; n is the rows that have it.
    """
    n = float(docs.count())
    held = texts.select("text_hash", "n", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("n").alias("holds"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    held = stage(held.join(entities.select("entity", "holds"), "entity"), "entities")
    # A term in more documents than this cannot reach the threshold with any entity of the text.
    limit = F.lit(n) * F.pow(F.col("holds") / n, F.lit(threshold)) * (1 + 1e-9) if threshold > 0 else F.lit(n)
    most = held.groupBy("text_hash").agg(F.max(limit).alias("limit"))
    said = texts.join(most, "text_hash").select("text_hash", "limit", F.explode("terms").alias("term"))
    said = stage(said, "terms")
    known = said.groupBy("term").agg(F.count("*").alias("texts"), F.max("limit").alias("most")).where(F.col("texts") >= support)
    counts = docs.select(F.explode(spoken(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("says"))
    counts = counts.join(known, "term").where("says <= most").select("term", "says")
    rare = said.join(counts, "term").where("says <= limit").select("text_hash", "term", "says")
    pairs = stage(held.join(rare, "text_hash").where(F.col("says") <= limit), "term-pairs")
    joint = pairs.groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.count("*").alias("texts"), F.max("holds").alias("holds"), F.max("says").alias("says")
    ).where(F.col("texts") >= support)
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("holds") * F.col("says")))
    content = -F.log2(F.col("holds") / F.lit(n))
    ratio = F.when(content > 0, pmi / content).otherwise(0.0)
    telling = joint.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= threshold)
    return pairs.join(telling, ["entity", "term"]).groupBy("text_hash", "term").agg(F.max("ratio").alias("ratio"))


def personal_data(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, spans, terms``.

    ``spans`` are the base spans (kind, start, end, value; kinds in order of ``PATTERNS``, then by start; code
    points, ends exclusive); ``terms`` every occurrence of a disclosing term in a text that holds its
    entity, at any distance, outside the spans (start, end, ratio; by start).

    A null text counts as empty; it has no spans. Results depend on the text alone, so rows that repeat a
    doc_id, or have none, are judged by their own text. Repeated
    texts add to document counts but count once as support. Other columns are ignored, whatever their
    names. No rows give no rows.
    """
    text = F.coalesce(named("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("spans"))
    found = stage(rows.select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "spans")
    texts = found.where(F.size("spans") > 0).groupBy("text_hash").agg(F.count("*").alias("n"), F.first(F.struct("text", "spans")).alias("t"))
    texts = texts.select("text_hash", "n", F.array_distinct(F.transform("t.spans", entity)).alias("entities"), blanked(F.col("t.text"), F.col("t.spans")).alias("rest"))
    texts = stage(texts.withColumn("terms", spoken(F.col("rest"))), "span-texts")
    telling = disclosing(texts.drop("rest"), rows.select("text"), support, threshold)
    telling = telling.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("ratios"))
    hits = telling.join(texts.select("text_hash", "rest"), "text_hash")
    marked = located(F.col("rest"), TERM, lambda value: F.map_contains_key("ratios", F.lower(value)))
    marked = F.transform(marked, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.col("ratios")[F.lower(t["value"])].alias("ratio")))
    hits = checked_broadcast(hits.select("text_hash", marked.alias("terms")))
    none = F.array().cast("array<struct<start:int,end:int,ratio:double>>")
    return found.join(hits, "text_hash", "left").select("doc_id", "text_hash", "spans", F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten: spans become ``[kind]``, telling terms ``[term]`` or nothing."""
    found = personal_data(docs, support, threshold).select(
        F.col("doc_id").alias(fresh(docs, "found_id")), F.col("text_hash").alias(fresh(docs, "found_hash")),
        F.concat(
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("new"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["ratio"] >= REMOVE, "").otherwise("[term]").alias("new"))),
        ).alias(fresh(docs, "found_cuts")),
    ).distinct()
    i, h, cuts = (named(c) for c in found.columns)
    text = named("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, cut: Column) -> Column:
        fits = cut["start"] >= acc["at"]
        gap = text.substr(acc["at"] + 1, cut["start"] - acc["at"])
        parts = F.when(fits, F.concat(acc["parts"], F.array(gap, cut["new"]))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], cut["end"]).alias("at"), parts.alias("parts"))

    clean = F.aggregate(F.sort_array(cuts), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text))))
    same = named("doc_id").eqNullSafe(i) & (F.xxhash64(F.coalesce(text, F.lit(""))) == h)
    joined = docs.join(found, same, "left")
    return joined.select(*[F.when(F.size(cuts) > 0, clean).otherwise(text).alias("text") if c == "text" else named(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
