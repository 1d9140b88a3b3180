"""Exact dedup: frequent digests by Misra-Gries, removed map-side; the rest shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import free, whole
from tapeloom.session import materialize

#: A digest with more than this share of all rows is frequent. At most 1 / SUPPORT such digests exist,
#: which bounds the Misra-Gries counters and the broadcast.
SUPPORT = 1e-3


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without any change; null counts as empty. Of equal texts the
    row with the largest doc_id stays (a null doc_id is smaller than any). Rows that also share
    their doc_id are told apart by their place, so exactly one row of a group is kept. An empty
    table gives no rows; further columns are not read.

    Text is read once. Its digests (one short row per document) are written to the shared
    folder; everything after works on them. The frequent-item sketch (Misra-Gries counters, one
    set per task, merged) names every digest above ``support``; an exact count confirms or drops
    each name. Rows of confirmed digests meet their group by broadcast and are never shuffled;
    no other group holds more than ``support`` of the rows.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(whole(text), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")
    )
    rows = materialize(rows, "digests")
    named = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256")).distinct()
    best = F.max(F.struct("doc_id", "_row")).alias("_best")
    size = F.count(F.lit(1)).alias("group_size")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    confirmed = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(best, size)
    winners = materialize(confirmed.where(F.col("group_size") > total * support), "winners")

    frequent = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    others = others.join(others.groupBy("text_sha256").agg(best, size), "text_sha256")
    return frequent.unionByName(others).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256",
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one per distinct text, as ``decisions`` says."""
    digest, stays, own = (free(n, docs.columns) for n in ("_sha256_of_text", "_stay", "_digest"))
    stay = decisions(docs, doc_id, text, support).where("kept").select(F.col("doc_id").alias(stays), F.col("text_sha256").alias(own))
    marked = docs.withColumn(digest, F.sha2(whole(text), 256))
    same = F.col(doc_id).eqNullSafe(F.col(stays)) & (F.col(digest) == F.col(own))
    return marked.join(stay, same, "left_semi").dropDuplicates([digest]).drop(digest)
