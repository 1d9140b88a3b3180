"""The corpus pipeline: language, lines, near copies, mix, packing. Each stage is written and read again.

Decisions meet their rows by a key that a stage writes for itself, so null and repeated doc_ids lose no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import langid, line_dedup, mixing, ngram_join, packing
from tapeloom.llm.common import documents, keyed
from tapeloom.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; those without a letter, or of no known language, go. Every row is judged by its own text."""
    rows, key = keyed(docs)
    model = langid.train(rows.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(rows, model, key).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.3))
    return rows.join(found.select(F.col("doc_id").alias(key)), key, "left_semi").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; so does a document that loses all its lines."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles the one with the smallest doc_id stays, a null doc_id last; of rows that tie, one."""
    rows, key = keyed(docs)
    found = ngram_join.classes(rows.select(F.col(key).alias("doc_id"), "text")).withColumnRenamed("doc_id", key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key))
    kept = found.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(first.alias("_first")).select(F.col(f"_first.{key}").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per draw of a document, cut documents with the words they give."""
    return mixing.mixed_documents(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language scores, shard draws and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
