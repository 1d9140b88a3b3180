"""Caller functions on batches of rows, run by Spark in tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_map(
    df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk=None,
) -> DataFrame:
    """A caller's function per group, in two steps so that no task needs a whole group.

    ``partial`` turns the rows of one piece of a group (cut at the column ``chunk``) into a
    few rows, ``merge`` turns the pieces of a group into its result. Both get and return
    frames that include the keys.
    """
    pieces = [*keys, "_chunk"]
    cut = df.withColumn("_chunk", chunk if chunk is not None else F.lit(0))
    parts = cut.groupBy(*pieces).applyInPandas(lambda pdf: partial(pdf.drop(columns="_chunk")), partial_schema)
    return parts.groupBy(*keys).applyInPandas(merge, schema)


def score_rows(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str], keep: Sequence[str] = ("inst", "dt")) -> DataFrame:
    """Score with a function whose rows do not depend on each other.

    Batches follow the given partitions: no shuffle, and a wide day is no hot spot.
    """
    keep = list(keep)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", score double"

    def run(frames):
        for pdf in frames:
            out = pdf[keep].copy()
            out["score"] = predict(pdf[list(features)])
            yield out

    return df.select(*keep, *features).mapInPandas(run, schema)


def score_days(
    df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str],
    dt: str = "dt", inst: str = "inst",
) -> DataFrame:
    """Score with a function that needs all names of a day at once.

    Such a function takes its whole day by definition, so a day must fit a task; otherwise
    standardise by day in Spark and use ``score_rows``.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[inst, dt]].copy()
        out["score"] = predict(pdf[list(features)])
        return out

    return df.select(inst, dt, *features).groupBy(dt).applyInPandas(run, f"{inst} {kinds[inst]}, {dt} {kinds[dt]}, score double")
