"""From bucket members to confirmed components, without emitting all pairs of a bucket.

Members of a bucket are candidates for links. First each is compared with one pivot of its bucket.
Confirmed links join members into components; only members of different components of a bucket still
need comparing. They are compared in full: small buckets pair by pair, large ones in blocks of bounded
size, each block pair as a group of its own that gives out only links that join components not joined
yet within it. Every pair of a bucket ends up compared or joined by links, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunweave.llm.graph import components
from sunweave.session import stage

#: Members up to which a bucket's pairs are compared as rows, and members of a block beyond.
SMALL, BLOCK = 32, 256
#: Shingles compared at once in a block pair.
COLUMNS = 1 << 14

PAIR = ["a", "b", "n_a", "n_b"]


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """Rows ``bucket, id, n`` of buckets with more than one row; an id is in a bucket once."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("rows"))
    return buckets.join(sizes.where("rows > 1").select("bucket"), "bucket", "left_semi")


def _stars(members: DataFrame) -> DataFrame:
    """Each member with the smallest id of its bucket."""
    pivot = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("p"))
    both = members.join(pivot, "bucket").where(F.col("id") != F.col("p.id"))
    return both.select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("n_a"), F.col("n").alias("n_b"))


def _across(placed: DataFrame) -> DataFrame:
    one, two = placed.toDF("bucket", "a", "n_a", "root_a"), placed.toDF("bucket", "b", "n_b", "root_b")
    return one.join(two, "bucket").where("a < b and root_a != root_b").select(*PAIR)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    return values, np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def _matrix(values: np.ndarray, rows: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(known)), dtype=np.float32)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    hit = known[at] == values
    out[rows[hit], at[hit]] = 1
    return out


def _spanning(pairs: tuple[np.ndarray, np.ndarray], one: np.ndarray, two: np.ndarray) -> list[int]:
    """Positions of linked pairs that join what earlier ones have not, ``one`` and ``two`` being their ends' roots."""
    above: dict = {}

    def top(x):
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    kept = []
    for at, (i, j) in enumerate(zip(*(p.tolist() for p in pairs))):
        a, b = top(one[i]), top(two[j])
        if a != b:
            above[a] = b
            kept.append(at)
    return kept


def _compare(share: int):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        one, two = df[df["block"] == key[1]].reset_index(drop=True), df[df["block"] == key[2]].reset_index(drop=True)
        (va, ra), (vb, rb) = (_flat(list(side["shingles"])) for side in (one, two))
        known = np.intersect1d(va, vb)
        shared = np.zeros((len(one), len(two)), dtype=np.float32)
        for at in range(0, len(known), COLUMNS):
            part = known[at : at + COLUMNS]
            shared += _matrix(va, ra, len(one), part) @ _matrix(vb, rb, len(two), part).T
        n_a, n_b = one["n"].to_numpy(np.int64)[:, None], two["n"].to_numpy(np.int64)[None, :]
        shared = shared.astype(np.int64)
        good = 100 * shared >= share * (n_a + n_b - shared)
        roots = one["root"].to_numpy(object), two["root"].to_numpy(object)
        good &= roots[0][:, None] != roots[1][None, :]
        if key[1] == key[2]:
            good &= np.arange(len(one))[:, None] < np.arange(len(two))[None, :]
        i, j = np.nonzero(good)
        kept = _spanning((i, j), *roots)
        return pd.DataFrame({"a": one["id"].to_numpy(object)[i[kept]], "b": two["id"].to_numpy(object)[j[kept]]})

    return run


def _blocks(placed: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links that join the members of large buckets, compared block by block on full shingle sets."""
    pieces = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = placed.withColumn("pieces", pieces).withColumn("block", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rows = cut.select("bucket", "lo", "hi", "block", "id", "n", "root").join(sets.select("id", "shingles"), "id")
    kind = placed.schema["id"].dataType.simpleString()
    return rows.groupBy("bucket", "lo", "hi").applyInPandas(_compare(share), f"a {kind}, b {kind}")


def joined(members: DataFrame, sets: DataFrame, share: int, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, root`` of all members with a confirmed link.

    ``members`` has ``bucket, id, n`` (n: set size) and ``sets`` the ``id, shingles`` of all of them. Links
    need ``100 * shared >= share * all``; ``confirm`` turns pairs ``a, b, n_a, n_b`` into the links ``a, b``
    among them.
    """
    possible = f"100 * least(n_a, n_b) >= {share} * greatest(n_a, n_b)"
    stars = stage(_stars(members).where(possible).distinct(), "stars")
    links = stage(confirm(stars), "links")
    found = stage(components(links), "components")
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = stage(placed.select("bucket", "id", "n", F.coalesce("root", "id").alias("root")), "placed")
    ends = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    open_ = stage(placed.join(ends.where("lo != hi").select("bucket", "size"), "bucket"), "open-buckets")
    if not open_.limit(1).count():
        return found
    pairs = _across(open_.where(F.col("size") <= SMALL).drop("size")).where(possible).distinct()
    pairs = stage(pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti").select(*PAIR), "pairs")
    more = stage(confirm(pairs).unionByName(_blocks(open_.where(F.col("size") > SMALL), sets, share)), "links")
    if not more.limit(1).count():
        return found
    return stage(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "components")
