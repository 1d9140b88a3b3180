"""Line dedup: an exact set-similarity join over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import setjoin
from tapeloom.llm.common import free, keyed, sized, whole
from tapeloom.session import discard, materialize


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def flags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per line with a word: doc_id, line (from 0), n_shingles, removed.

    A line is removed when an earlier one (by doc_id, then place; null doc_id last) matches it: Jaccard of
    the distinct five-word shingles, A-Z lowered, of 3/4 or more; a line of fewer words is one shingle, so it
    matches only the same words. An earlier match counts even if it is removed itself, so the result does not depend on
    any order of work. Lines without a word, null and empty texts give no rows and are left alone. Rows that share a
    doc_id, or have none, are different documents in the order of their row numbers. ``row`` names a key of the rows, unique
    and not null, which is then a column of the result; without it rows are numbered as they are read. Shingles are compared by 57-bit hashes.

    Hash sets are made once; of each its size, its name (two hashes) and its first quarter in the order of the hashes are written. Equal sets
    are one, at their first place, and numbered in that order. Prefixes are indexed with common tokens last (``setjoin.postings``); whole sets are made again from the texts of the
    lines that need them. Each later line of a token's list first meets the list's first line only; those that
    match are decided. The others meet every earlier line of their lists that passes the length and
    positional filters and shares enough of the prefix. Lists are joined by token, never gathered.
    """
    at = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.col("doc_id").isNull().alias("none"), "row", "line", "source")
    number = F.col(row) if row else F.monotonically_increasing_id()
    body = whole(text)
    texts = docs.select(F.col(doc_id).alias("doc_id"), number.alias("row"), body.alias("body"))
    source = F.xxhash64("doc_id", "body").alias("source")  # finds the text again; rows may be numbered otherwise when they are read anew
    src = texts.select("doc_id", "row", source, F.posexplode_outer(_lines(F.col("body"))).alias("line", "body"))
    full = setjoin.with_hashes(src, F.col("body")).withColumn("n", F.size("hashes")).withColumn("tokens", F.sort_array("hashes"))
    prefix = F.when(F.col("n") > 0, setjoin.prefix(F.col("tokens"), F.col("n"))).alias("prefix")
    written = materialize(full.select("doc_id", "row", "line", "source", "n", F.xxhash64("n", "tokens").alias("s1"), F.hash("tokens").alias("s2"), prefix), "lines")
    rows = written.where("n > 0").withColumn("at", at)  # after the write: a filter would pull the whole set expression below it

    same = ["n", "s1", "s2"]
    first = rows.groupBy(*same).agg(F.min("at").alias("at"), F.first("prefix").alias("prefix"))
    first = materialize(first.orderBy("at").withColumn("id", F.monotonically_increasing_id()), "first-lines")

    def tokens_of(ids: DataFrame, count: int) -> DataFrame:
        wanted = setjoin.only(first, ids, count).select("id", F.col("at.source").alias("source"), F.col("at.line").alias("line"))
        wanted = materialize(wanted, "wanted")
        lines = texts.select(source, "body").join(sized(wanted.select("source").distinct(), count), "source", "left_semi")
        lines = lines.select("source", F.posexplode_outer(_lines(F.col("body"))).alias("line", "body")).join(sized(wanted, count), ["source", "line"])
        return setjoin.with_hashes(lines.select("id", "body"), F.col("body")).select("id", F.col("hashes").alias("tokens"))

    def verify(pairs: DataFrame) -> DataFrame:
        """Later lines (b) of the pairs that match."""
        pairs = materialize(pairs, "pairs")
        ids, count = setjoin.members(pairs)
        bodies = materialize(tokens_of(ids, count), "bodies")
        found = materialize(setjoin.verified(pairs, bodies).select(F.col("b").alias("id")).distinct(), "matched")
        discard(pairs, ids, bodies)
        return found

    posts = setjoin.postings(first.select("id", "n", "prefix"), tokens_of)
    lead = posts.withColumn("_c", F.min(F.struct("id", "n", "pos")).over(Window.partitionBy("token")))
    stars = lead.where((F.col("_c.id") < F.col("id")) & setjoin.may_match(F.col("n"), F.col("_c.n"), F.col("pos"), F.col("_c.pos")))
    decided = verify(stars.select(F.col("_c.id").alias("a"), F.col("id").alias("b")).distinct())
    x, y = posts.alias("x"), posts.join(decided, "id", "left_anti").alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id"))
    meets = meets & setjoin.may_match(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"))
    rest = x.join(y, meets).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    rest = rest.agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= setjoin.shared_needed(F.col("na"), F.col("nb")))
    matched = decided.unionByName(verify(rest.select("a", "b")))
    discard(posts)

    stays = first.join(matched, "id", "left_anti").select(*same, F.col("at").alias("_stays"))
    named = rows.drop("prefix").join(stays, same, "left")
    removed = ~F.coalesce(F.col("at") == F.col("_stays"), F.lit(False))
    named = named.withColumnRenamed("row", row) if row else named
    return named.select(*([row] if row else []), "doc_id", "line", F.col("n").cast("long").alias("n_shingles"), removed.alias("removed"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their removed lines, columns as given; a document that loses all its lines with words goes. Rows meet their cuts by a written row key."""
    keys, row = keyed(docs)
    cut_, gone = free("_cut", keys.columns), free("_gone", keys.columns)
    cut = flags(keys, doc_id, text, row).groupBy(row).agg(
        F.collect_set(F.when(F.col("removed"), F.col("line"))).alias(cut_), F.min("removed").alias(gone))
    rows = keys.join(cut, row, "left")
    rows = rows.where(~F.coalesce(gone, F.lit(False)))
    left = F.array_join(F.filter(_lines(F.col(text)), lambda x, i: ~F.array_contains(F.col(cut_), i)), "\n")
    put = F.when(F.size(cut_) > 0, left).otherwise(F.col(text))
    return rows.select(*[put.alias(c) if c == text else F.col(c) for c in docs.columns])
