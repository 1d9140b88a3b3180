"""Membership spans from daily snapshots, and joins against spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def min_max_spans(snapshots: DataFrame, keys: Sequence[str], dt: str = "dt") -> DataFrame:
    """First and last day per key; gaps are not split."""
    return snapshots.groupBy(*keys).agg(F.min(dt).alias("start_date"), F.max(dt).alias("end_date"))


def unbroken_spans(snapshots: DataFrame, keys: Sequence[str], dt: str = "dt", days: DataFrame | None = None) -> DataFrame:
    """One row per unbroken stay, over the days that have a snapshot at all.

    Day index minus row number is constant inside a stay. A single-day history gives
    its one-day span. ``days`` (dt, idx) may be passed when it is already known.
    """
    from tapeloom.operators.calendar import trade_calendar

    cal = days if days is not None else trade_calendar(snapshots.select(dt), dt)
    rows = snapshots.select(*keys, dt).distinct().join(F.broadcast(cal), dt)
    island = F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy(dt))
    rows = rows.withColumn("_island", island)
    return rows.groupBy(*keys, "_island").agg(F.min(dt).alias("start_date"), F.max(dt).alias("end_date")).drop("_island")


def day_over_day(snapshots: DataFrame, keys: Sequence[str], calendar: DataFrame, dt: str = "dt") -> DataFrame:
    """enter / hold / exit per key and trade day against the day before.

    Each presence is seen twice, as today and as yesterday of the next trade day, and
    the two marks meet in one aggregation: no self join. Days after the last trade day
    do not exist, so the newest presence makes no exit.
    """
    cal = F.broadcast(calendar)
    here = snapshots.select(*keys, dt).distinct().join(cal, dt).select(*keys, "idx")
    marks = here.select(*keys, F.explode(F.array(
        F.struct(F.col("idx").alias("idx"), F.lit(1).alias("today"), F.lit(0).alias("before")),
        F.struct((F.col("idx") + 1).alias("idx"), F.lit(0).alias("today"), F.lit(1).alias("before")),
    )).alias("m")).select(*keys, "m.*")
    seen = marks.groupBy(*keys, "idx").agg(F.max("today").alias("today"), F.max("before").alias("before"))
    state = F.when((F.col("today") == 1) & (F.col("before") == 1), "hold").when(F.col("today") == 1, "enter").otherwise("exit")
    return seen.join(cal, "idx").select(*keys, dt, state.alias("state"))


def inside_spans(panel: DataFrame, spans: DataFrame, inst: str = "inst", dt: str = "dt") -> DataFrame:
    """Rows whose day lies in a membership span of their instrument.

    An equi join on the instrument with the range as a residual test; a row inside two
    spans is kept once because it is a semi join.
    """
    s = spans.select(F.col(inst).alias("_inst"), "start_date", "end_date")
    cond = (F.col(inst) == F.col("_inst")) & F.col(dt).between(F.col("start_date"), F.col("end_date"))
    return panel.join(s, cond, "left_semi")


def overlapping(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Spans that meet [start, end]."""
    return spans.where((F.col("start_date") <= F.lit(end).cast("date")) & (F.col("end_date") >= F.lit(start).cast("date")))
