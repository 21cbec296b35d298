"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's target repetition rate,
so that in expectation every source contributes its target share of the characters. The number comes
from inverting the Poisson distribution at a uniform drawn from a hash of seed and doc_id: the same
corpus and seed give the same mixture on any cluster, without state and after any retry. Copies are
then spread over all partitions by a hash of their own and sorted by it, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm.columns import checked_broadcast, columns, fresh, named
from sunweave.session import stage

#: A larger mean is drawn as a sum of several equal parts, for exp(-mean) must not underflow.
PART = 50.0
#: Terms of the distribution function of one part: beyond, less than 2^-52 of the mass is left.
TERMS = 160


def _size(text: Column) -> Column:
    return F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")


def _source(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, repeat: float = 1.0) -> DataFrame:
    """``key, rate`` of each source: weight share x all characters x repeat / the source's characters.

    Without ``weights`` all sources weigh the same. Sources that ``weights`` leaves out weigh nothing.
    An empty or null text counts as one character, so every source has a size.
    """
    sizes = stage(docs.groupBy(_source(named("source")).alias("key")).agg(F.sum(_size(named("text"))).alias("size")), "source-sizes")
    weight = F.lit(1.0)
    if weights is not None:
        given = [x for k, w in weights.items() for x in (F.lit("" if k is None else "=" + k), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*given)[F.col("key")], F.lit(0.0)) if given else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total.weight:
        return sizes.select("key", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(total.weight)
    return sizes.select("key", (share * F.lit(total.size) * F.lit(repeat) / F.col("size")).alias("rate"))


def uniform(seed: int, part: Column, doc_id: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed, part and doc_id."""
    name = F.concat_ws(":", F.lit(str(seed)), part.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow, lambda acc: acc["cdf"])


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, repeat: float = 1.0, seed: int = 17) -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` for each copy, the copy's number from 1 and its shuffle key; then their names.

    ``repeat`` is the wanted total size relative to the corpus. Rows come in random order (by shuffle
    key within partitions that are themselves random). Documents drawn zero times are absent: that is
    the operator's purpose.

    A null source is a source of its own; null and empty texts count as one character; a null doc_id
    is drawn by the word "null", rows repeating a doc_id are drawn alike. Names that clash are avoided.
    No rows, or no positive weight, give no rows.
    """
    copy_no, key = fresh(docs, "copy_no"), fresh(docs, "shuffle_key")
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = rates(docs, weights, repeat).select(F.col("key").alias("_key"), parts.alias("_parts"), _distribution(F.col("rate") / parts).alias("_cdf"))
    clash = {c: fresh(docs, c) for c in table.columns}
    source_key, parts, cdf = clash.values()
    table = checked_broadcast(table.withColumnsRenamed(clash))
    joined = docs.join(table, _source(named("source")) == named(source_key))
    # The numbers are drawn before they are compared: within the comparison they would be hashed once per term.
    draws = F.transform(F.sequence(F.lit(1), named(parts)), lambda i: uniform(seed, i, named("doc_id")))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(named(cdf), lambda c: c <= u)))
    many = fresh(joined, "many")
    counted = joined.select(*columns(docs), drawn.alias(many))
    copies = F.when(named(many) > 0, F.sequence(F.lit(1), named(many))).otherwise(F.array().cast("array<int>"))
    out = counted.select(*columns(docs), F.explode(copies).alias(copy_no))
    name = F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(named("doc_id").cast("string"), F.lit("null")), named(copy_no).cast("string"))
    out = out.withColumn(key, F.md5(name))
    return out.repartition(named(key)).sortWithinPartitions(named(key)), copy_no, key
