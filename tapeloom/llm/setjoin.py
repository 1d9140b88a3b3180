"""Building blocks of the exact set-similarity joins: token sets, rarity order, prefixes, candidates, verification.

A set's tokens are hashed five-word shingles in one global order, common ones last. Two sets with
Jaccard of at least 3/4 share a token within their first n - ceil(3n/4) + 1 tokens, so
only these are indexed. All comparisons of sizes are done in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import sized
from tapeloom.session import discard, materialize

SHINGLE = 5
#: Similarity, as a fraction.
NUM, DEN = 3, 4
#: Tokens in more lists than this are common and go last, by magnitude. The order only steers work: any order gives the same links.
FREQUENT = 24
#: Documents: the RANKED most frequent are told apart through RARITY_SLOTS hashed slots.
RANKED, RARITY_SLOTS = 200_000, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH_BITS = 57


def words(text: Column) -> Column:
    """Words with A-Z lowered. Text of ASCII only takes the faster ``lower``, which is the same there; white space becomes spaces, as a split at one character needs no pattern."""
    plain = F.length(text) == F.octet_length(text)
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\n\v\f\r"])
    spaced = F.when(other, F.translate(text, "\t\n\v\f\r", " " * 5)).otherwise(text)
    return F.array_remove(F.split(F.when(plain, F.lower(spaced)).otherwise(F.translate(spaced, UPPER, LOWER)), " "), "")


def with_hashes(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``hashes``: distinct shingle hashes of ``text`` (57 bits each); fewer words than a shingle make one, none make none.

    Hashes are built by pairs of neighbours, each step one pass over the array. Every array that a lambda
    reads is a column of its own, so that nothing is evaluated once per element. Do not filter on what comes
    of it before it is written: the filter would be pushed below with all expressions in it.
    """
    most = F.lit(1 << 30)
    df = df.withColumn("_h1", F.transform(words(text), lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", F.zip_with("_h1", F.slice("_h1", F.lit(2), most), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h4", F.zip_with("_h2", F.slice("_h2", F.lit(3), most), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h5", F.zip_with("_h4", F.slice("_h1", F.lit(SHINGLE), most), lambda a, b: F.shiftrightunsigned(F.xxhash64(a, b), 64 - _HASH_BITS)))
    short = F.when(F.size("_h1") > 0, F.array(F.shiftrightunsigned(F.xxhash64("_h1"), 64 - _HASH_BITS))).otherwise(F.array().cast("array<bigint>"))
    full = F.slice("_h5", F.lit(1), F.greatest(F.size("_h1") - (SHINGLE - 1), F.lit(0)))
    df = df.withColumn("hashes", F.array_distinct(F.when(F.size("_h1") >= SHINGLE, full).otherwise(short)))
    return df.drop("_h1", "_h2", "_h4", "_h5")


def prefix_size(n: Column) -> Column:
    """n - ceil(3n/4) + 1."""
    return n - F.floor((n * NUM + (DEN - 1)) / DEN).cast("int") + 1


def prefix(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, F.lit(1), prefix_size(n))


def postings(heads: DataFrame, tokens_of: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(id, n, pos, token), written: the prefix tokens that more than one of ``heads`` has, in one rarity order.

    ``heads``, written: id, n, prefix in the order of the hashes. ``tokens_of(ids, count)``: id and all tokens of those sets.
    All prefix tokens are counted. Sets with a common one are read again and all of their tokens counted, as others move up; then
    common tokens go last, by magnitude, in every set whose prefix holds one. So a list is long only where its sets have too few rare tokens.
    """
    tokens = heads.select("id", F.explode("prefix").alias("token"))
    number = F.count(F.lit(1)).alias("c")
    often = materialize(tokens.groupBy("token").agg(number).where(F.col("c") > FREQUENT), "often")
    done, count = [often], often.count()
    if count:
        hit, size = distinct_ids(tokens.join(sized(often, count), "token", "left_semi"))
        full = materialize(tokens_of(hit, size).select("id", "tokens").distinct().withColumn("key", F.monotonically_increasing_id()), "full-sets")
        among = full.select(F.explode("tokens").alias("token")).groupBy("token").agg(number).where(F.col("c") > FREQUENT)
        common = often.unionByName(among).groupBy("token").agg(F.floor(F.log2(F.max("c"))).cast("int").alias("m"))
        common = materialize(common, "common")
        count = common.count()
        done += [hit, full, common]
        late, more = distinct_ids(tokens.join(sized(common, count), "token", "left_semi").join(sized(hit, size), "id", "left_anti"))
        if more:
            rest = tokens_of(late, more).select("id", "tokens").distinct().withColumn("key", -1 - F.monotonically_increasing_id())
            rest = materialize(rest, "full-sets")
            done.append(rest)
            full = full.unionByName(rest)
        each = full.select("key", "id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(sized(common, count), "token", "left")
        sets = each.groupBy("key", "id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "token"))).alias("all"))
        done.append(late)
        moved = hit.unionByName(late)
        heads = heads.join(sized(moved, size + more), "id", "left_anti").unionByName(sets.select("id", "n", prefix(F.col("all.token"), F.col("n")).alias("prefix")))
    posts = heads.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    posts = posts.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("_k > 1").drop("_k")
    posts = materialize(posts, "postings")
    discard(*done)
    return posts


def distinct_ids(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct ids of ``rows``, written, and how many."""
    ids = materialize(rows.select("id").distinct(), "ids")
    return ids, ids.count()


#: Prefixes of a quarter lie in the lowest 3/10 of the hash range, unless common tokens are passed over; frequencies are counted there first.
LOW = int((1 << _HASH_BITS) * 0.3)


def rarity(tokens: DataFrame) -> np.ndarray:
    """Slot table of token frequency (magnitude of the count, 0 if rare).

    Counts of ``tokens`` (t, c) are exact and combine map-side; what comes back is bounded by RANKED.
    """
    often = tokens.groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT).orderBy(F.desc("c"), "t").limit(RANKED)
    found = materialize(often.select("t", F.least(F.floor(F.log2("c")), F.lit(31)).cast("byte").alias("m")), "rarity").toArrow()
    table = np.zeros(RARITY_SLOTS, np.int8)
    np.maximum.at(table, found["t"].to_numpy() & (RARITY_SLOTS - 1), found["m"].to_numpy())
    return table


def overlap_needed(a: Column, b: Column) -> Column:
    """Least common tokens of sets of a and b tokens at the similarity: ceil(3 (a + b) / 7)."""
    s = (a + b).cast("long") * NUM
    return F.ceil(s / F.lit(NUM + DEN)).cast("long")


def may_match(na: Column, nb: Column, pa: Column, pb: Column) -> Column:
    """Length and positional filter for one common token at places pa and pb (from 0)."""
    length = (F.least(na, nb) * DEN) >= (F.greatest(na, nb) * NUM)
    most = F.least(pa, pb) + 1 + F.least(na - pa - 1, nb - pb - 1)
    return length & (most >= overlap_needed(na, nb))


def shared_needed(na: Column, nb: Column) -> Column:
    """Least common tokens inside the prefixes of sets of na and nb tokens.

    Of the two prefixes take the one that ends earlier in the order: each of its tokens that the
    other set has lies in the other prefix, and at most (size - overlap) are missing there.
    """
    need = overlap_needed(na, nb)
    return F.greatest(F.lit(1).cast("long"), F.least(prefix_size(na) - (na - need), prefix_size(nb) - (nb - need)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (a, b, ...) whose sets (id, tokens) reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_i", F.size(F.array_intersect("_ta", "_tb")))
    union = F.size("_ta") + F.size("_tb") - F.col("_i")
    return both.where((F.col("_i") > 0) & (F.col("_i") * DEN >= union * NUM)).drop("_ta", "_tb", "_i")


def members(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Distinct ids of written ``pairs`` and how many."""
    return distinct_ids(pairs.select(F.explode(F.array("a", "b")).alias("id")))


def only(df: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows of ``df`` with an ``id`` in ``ids``; broadcast if few, shuffled otherwise."""
    return df.join(sized(ids, count), "id", "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable over written ``links`` (a, b).

    Least neighbour and pointer jumping in turn, so rounds grow with the logarithm of the longest
    chain; every round is written, which cuts lineage. Loops until nothing changes.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("_far"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").join(jump, "root")
        step = step.select("id", F.least("root", "_near", "_far").alias("root"), (F.least("_near", "_far") < F.col("root")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("id", "root")
        if not step.where("moved").limit(1).count():
            return labels
