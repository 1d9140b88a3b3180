"""N-gram Jaccard join by grouped prefixes, and the classes of linked documents."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import setjoin, shingles
from tapeloom.llm.common import whole
from tapeloom.session import discard, materialize

#: Rounds in which the documents of a token's list only meet one of them.
STAR_ROUNDS = 2
#: Then lists of more than LONG documents meet STARS of them in each round, as long as their pairs of different classes are many and get fewer.
LONG, STARS = 64, 8
#: Rows without a doc_id are numbered from here.
NO_ID = 1 << 62


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A-Z is lowered, words are runs without ASCII white space, a set holds the distinct five-word shingles (fewer
    words: the whole sequence as one; no words or null: empty). Two documents link when 4 * common >= 3 *
    union; ``component_id`` is the smallest doc_id reachable, its own for an empty or unlinked one. A null doc_id sorts
    last and is replaced by a linked document's; rows without one are documents of their own (other ids are then below 2^62); rows that repeat a doc_id get that document's class, and their
    texts link like any others. Shingles are compared by 57-bit hashes. An empty table gives no rows.

    Grouped prefix join: documents with the same prefix and size are one group; postings and group
    pairs are made per group. Groups are expanded to their different sets only for verification, so thousands
    of copies cost one set. A token's list first meets one of its members only (a row per member, not per
    pair); what these links connect is not compared again, and the rest is paired in full, by length, place and
    number of common prefix tokens. So no link between different classes is lost, and a large class
    never becomes all its pairs.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    missing = src.where(F.col("doc_id").isNull()).limit(1).count() > 0
    if missing:  # the numbers are written, as several readers must see them alike
        src = materialize(src.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID) + F.monotonically_increasing_id())), "numbered")
    # low tokens are counted in all sets; the others only in sets whose rare low tokens do not fill the prefix, as no other prefix holds them
    heads = materialize(shingles.low_sets(src), "low-sets")
    low = setjoin.rarity(shingles.counts(heads.select("low")))
    rows = materialize(shingles.prefixes(heads, low), "sets")
    discard(heads)
    ids, count = setjoin.distinct_ids(rows.where("p1 IS NULL").select(F.col("doc_id").alias("id")))
    texts = setjoin.only(src.select(F.col("doc_id").alias("id"), "text"), ids, count)
    heads = materialize(shingles.open_sets(texts, low), "open-sets")
    high = setjoin.rarity(shingles.counts(heads.select("tokens"), setjoin.LOW))
    opened = materialize(shingles.settled(heads, np.concatenate([low, high])), "settled")
    discard(heads, ids)
    rows = rows.where("p1 IS NOT NULL").unionByName(opened.drop(*shingles.MARK))

    # a set is named by the smallest doc_id that has it, a group by the smallest of its sets
    key = F.col("doc_id")
    same_set, same_prefix = ["n", "p1", "p2", "s1", "s2"], ["n", "p1", "p2"]
    sets = rows.where("n > 0").groupBy(*same_set).agg(F.min(key).alias("id"))
    sets = materialize(sets.withColumn("group", F.min("id").over(Window.partitionBy(*same_prefix))), "representatives")

    def verify(pairs: DataFrame) -> DataFrame | None:
        pairs = materialize(pairs, "pairs")
        ids, count = setjoin.members(pairs)
        if not count:
            discard(pairs, ids)
            return None
        texts = setjoin.only(src.select(key.alias("id"), "text"), ids, count)
        found = materialize(setjoin.verified(pairs, shingles.token_sets(texts)).select("a", "b"), "links")
        discard(pairs, ids)
        return found

    # a set that is not linked to the first one of its group enters the lists by itself
    links = verify(sets.where("id != group").select(F.col("group").alias("a"), F.col("id").alias("b")))
    if links is None:
        entries = sets.withColumn("entry", F.col("id"))
    else:
        near = links.select(F.col("a").alias("group"), F.col("b").alias("id"), F.lit(True).alias("_near"))
        entries = sets.join(near, ["group", "id"], "left").withColumn("entry", F.when(F.col("_near") | (F.col("id") == F.col("group")), F.col("group")).otherwise(F.col("id")))
    entries = materialize(entries.select("id", "entry", *same_set), "entries")

    lists = rows.select(key.alias("id"), *same_set, "prefix").join(entries.where("id = entry").drop("entry"), ["id", *same_set], "left_semi")
    posts = lists.select("id", "n", F.posexplode_outer("prefix").alias("pos", "token"))
    posts = posts.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token")).cast("int"))
    posts = materialize(posts.where("size > 1").withColumn("h", F.count(F.lit(1)).over(Window.partitionBy("id")).cast("int")), "postings")

    def meet(found: DataFrame, share: int, part: DataFrame | None = None) -> DataFrame | None:
        """Links of the pairs (a, b, na, nb; a row per common token) that have 1 / ``share`` of the common prefix tokens they need."""
        need = F.greatest(F.lit(1), (setjoin.shared_needed(F.col("na"), F.col("nb")) / share).cast("long"))
        found = found.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= need).select("a", "b")
        new = verify(found if part is None else expand(found, part))
        return links if new is None else new if links is None else materialize(links.unionByName(new), "links")

    round_, before = 0, None
    while True:
        many = round_ >= STAR_ROUNDS
        at = posts.where(F.col("size") > LONG) if many else posts
        roots = None if links is None else setjoin.components(links)
        at = classed(at, roots)
        if many:
            left, rows_ = crossing(at)
            if left <= STARS * rows_ or before is not None and left > 0.9 * before:
                break
            before = left
        links = meet(stars(at, round_, STARS if many else 1), 5)  # a star sees some of the common tokens only; a fifth of them is worth a look
        round_ += 1
    # long lists hold sets of common tokens, whose marks tell most pairs apart; an id of several sets has none
    alone = entries.where("id = entry").groupBy("id").agg(F.count(F.lit(1)).alias("_s"), *(F.min(c).alias(c) for c in same_set)).where("_s = 1")
    marks = opened.withColumnRenamed("doc_id", "id").select("id", *same_set, *shingles.MARK).join(alone, ["id", *same_set], "left_semi").dropDuplicates(["id"])
    at = classed(posts, roots)
    found = paired(at.where(F.col("size") <= LONG)).unionByName(paired(at.where(F.col("size") > LONG).join(marks.drop(*same_set), "id", "left"), shingles.MARK))
    links = meet(found, 1, entries)

    discard(posts)
    if links is None:
        sets = sets.withColumn("root", F.col("id"))
    else:
        sets = sets.join(setjoin.components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rows.drop("prefix").join(sets.select(*same_set, "root"), same_set, "left")
    given = lambda c: F.when(c < NO_ID, c) if missing else c
    return named.select(given(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), given(F.coalesce("root", "doc_id")).alias("component_id"))


def may_meet(x: str, y: str) -> Column:
    """Whether the documents of two postings of a token can be linked; ``h`` postings are as many common ones as there can be."""
    (nx, px, hx), (ny, py, hy) = ([F.col(side + c) for c in ("n", "pos", "h")] for side in (x, y))
    return setjoin.may_match(nx, ny, px, py) & (F.least(hx, hy) >= setjoin.shared_needed(nx, ny))


def classed(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``posts`` with the class of their document, as far as it is known."""
    return posts.withColumn("root", F.col("id")) if roots is None else posts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def crossing(at: DataFrame) -> tuple[int, int]:
    """How many pairs of different classes the lists of ``at`` hold, and rows; of documents that can meet one of their size."""
    lists = at.where(F.col("h") >= setjoin.shared_needed(F.col("n"), F.col("n"))).groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"))
    found = lists.agg(F.sum((F.col("c") * F.col("c") - F.col("same")) / 2).alias("pairs"), F.sum("c").alias("rows")).first()
    return int(found["pairs"] or 0), int(found["rows"] or 0)


def stars(at: DataFrame, round_: int, count: int) -> DataFrame:
    """(a, b, na, nb): the documents of a list with the first ``count`` of it, in an order of the round, where classes differ.

    Of several stars those come first that are in most lists: they differ least from the others, as own tokens lead a prefix.
    """
    lot, size = F.struct(F.xxhash64("id", F.lit(round_)).alias("lot"), "id", "n", "pos", "h", "root"), Window.partitionBy("token")
    if count == 1:
        found = at.withColumn("_c", F.min(lot).over(size))
    else:
        first = at.select("token", lot.alias("_c")).withColumn("_r", F.row_number().over(size.orderBy(F.desc("_c.h"), "_c"))).where(F.col("_r") <= count)
        found = at.join(first.drop("_r"), "token")
    found = found.where((F.col("_c.root") != F.col("root")) & may_meet("", "_c."))
    below = F.col("id") < F.col("_c.id")
    return found.select(F.least("id", "_c.id").alias("a"), F.greatest("id", "_c.id").alias("b"),
                        F.when(below, F.col("n")).otherwise(F.col("_c.n")).alias("na"), F.when(below, F.col("_c.n")).otherwise(F.col("n")).alias("nb"))


def paired(at: DataFrame, mark: list[str] | None = None) -> DataFrame:
    """(a, b, na, nb): pairs of different classes that a list holds, a row per common token."""
    x, y = at.alias("x"), at.alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & may_meet("x.", "y.")
    if mark:
        na, nb = F.col("x.n"), F.col("y.n")
        apart = reduce(add, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in mark))
        meets = meets & (F.coalesce(apart, F.lit(0)) <= na + nb - 2 * setjoin.overlap_needed(na, nb))
    return x.join(y, meets).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def expand(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of list entries as pairs of the different sets they stand for."""
    a, b = (entries.select(F.col("entry").alias(c), F.col("id").alias(f"_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
