"""Readers with explicit schemas: one directory is one table, never one job per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_SCHEMA = "instrument string, start_date date, end_date date"
PREDICTION_SCHEMA = "datetime string, instrument string, score string"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header. Only the listed columns are parsed."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*columns) if columns else df


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Tab file without header: instrument, start, end."""
    return spark.read.schema(SPAN_SCHEMA).csv(path, sep="\t")


def fields_of_lines(lines: DataFrame, names: Sequence[str], column: str = "value") -> DataFrame:
    """Lines split on whitespace; lines with fewer parts than names are dropped."""
    parts = lines.select(F.split(F.trim(F.col(column)), r"\s+").alias("_p")).where(F.size("_p") >= len(names))
    return parts.select(*[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def seed_and_step(name: Column) -> dict[str, Column]:
    """Seed and step from the number(s) at the end of a file name; step is -1 with one number."""
    s = stem(name)
    two, one = r"(?:^|_)(\d+)_(\d+)$", r"(?:^|_)(\d+)$"
    pair = s.rlike(two)
    return {
        "seed": F.when(pair, F.regexp_extract(s, two, 1)).otherwise(F.regexp_extract(s, one, 1)).try_cast("long"),
        "step": F.when(pair, F.regexp_extract(s, two, 2).try_cast("long")).when(s.rlike(one), F.lit(-1).cast("long")),
    }


def name_fields(name: Column) -> dict[str, Column]:
    """backday, universe, seed, step by place in the file name; missing places are null."""
    parts = F.split(stem(name), "_")
    enough = F.size(parts) >= 5
    return {
        k: F.when(enough, F.try_element_at(parts, F.lit(i)))
        for k, i in (("backday", 4), ("universe", 5), ("seed", 6), ("step", 7))
    }


def read_predictions(spark: SparkSession, path: str, pattern: str = "*predictions*.csv") -> DataFrame:
    """All prediction files below ``path``, in sub-folders too, as one table: datetime, instrument, score, seed, step.

    Seed and step come from the files' real names, ``folder`` is the last folder above a file. Rows without a number for a score go. A file
    whose name has no number at its end has no seed.
    """
    raw = spark.read.schema(PREDICTION_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path, header=True)
    named = raw.withColumns({**seed_and_step(F.col("_metadata.file_name")), "folder": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)})
    score = F.col("score").try_cast("double")
    return named.withColumn("score", F.when(~F.isnan(score), score)).na.drop(subset=["score"])


def parse_training_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Epoch lines of a training log to numbers; a full stop at the end of a number is cut."""
    number = r"([\d.\-]+)"
    pattern = (
        rf"Epoch\s+(\d+),\s*train_loss\s+{number},\s*valid ic\s+{number},\s*icir\s+{number},"
        rf"\s*rankic\s+{number},\s*rankicir\s+{number}"
    )
    c = F.col(column)
    names = ["train_loss", "ic", "icir", "rankic", "rankicir"]
    hit = lines.where(c.rlike(pattern))
    return hit.select(
        F.regexp_extract(c, pattern, 1).try_cast("long").alias("epoch"),
        *[F.rtrim(F.regexp_extract(c, pattern, i + 2), F.lit(".")).try_cast("double").alias(n) for i, n in enumerate(names)],
    )


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_training_log(spark.read.text(path))


def date_maps_to_rows(answers: DataFrame, body: str, maps: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Nested ``{name: {date: value}}`` JSON to one row per date with a column per map.

    Entries of all maps are exploded once and met in one aggregation, which gives the same
    rows as a chain of full outer joins. Answers whose status is not 1 are left out.
    """
    inner = ", ".join(f"{m}: map<string, double>" for m in maps)
    data = F.from_json(F.col(body), f"status int, data struct<{inner}>")
    rows = answers.select(*keep, data.alias("_j")).where(F.col("_j.status") == 1)
    entries = F.flatten(F.array(*[
        F.transform(F.map_entries(F.coalesce(F.col(f"_j.data.{m}"), F.create_map().cast("map<string,double>"))), _entry(m)) for m in maps
    ]))
    long = rows.select(*keep, F.explode(entries).alias("e")).select(*keep, F.col("e.date").try_cast("date").alias("date"), "e.name", "e.value")
    return long.groupBy(*keep, "date").agg(*[F.max(F.when(F.col("name") == m, F.col("value"))).alias(m) for m in maps])


def _entry(name: str):
    return lambda e: F.struct(e["key"].alias("date"), F.lit(name).alias("name"), e["value"].alias("value"))

