"""Trade calendar: build, align, look up, split. One row per day, so it is always small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trade_calendar(days: DataFrame, dt: str = "dt") -> DataFrame:
    """Sorted distinct union of all days with a 1-based ``idx``.

    The window has no partition, but it runs over calendar days only (about 250 rows a
    year) after a distinct that combines map-side.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(dt)
    return days.where(F.col(dt).isNotNull()).select(dt).distinct().withColumn("idx", F.row_number().over(w).cast("long"))


def align(panel: DataFrame, calendar: DataFrame, inst: str = "inst", dt: str = "dt") -> DataFrame:
    """Give each instrument one row per trade day between its first and last day.

    Each row is stretched over the trade days up to the instrument's next row, by day
    index; only the first copy keeps its values. One exchange by instrument, no join of the
    panel with itself and no range join. The calendar is small and broadcast. Rows whose day
    is not in the calendar stay as they are.
    """
    cal = calendar.select(dt, "idx")
    rows = panel.join(F.broadcast(cal.withColumnRenamed("idx", "_i")), dt, "left")
    following = F.lead("_i").over(Window.partitionBy(inst).orderBy("_i"))
    rows = rows.withColumn("_j", F.coalesce(following - 1, F.col("_i")))
    rows = rows.withColumn("idx", F.explode_outer(F.sequence("_i", "_j"))).withColumnRenamed(dt, "_dt")
    own = F.col("_i").isNull() | (F.col("idx") == F.col("_i"))
    values = [F.when(own, F.col(c)).alias(c) for c in panel.columns if c not in (inst, dt)]
    rows = rows.select(inst, "idx", "_dt", *values).join(F.broadcast(cal), "idx", "left")
    return rows.withColumn(dt, F.coalesce(dt, "_dt")).select(*panel.columns)


def next_trade_day(calendar: DataFrame, dt: str = "dt") -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy(dt)
    return calendar.withColumn("next_dt", F.lead(dt).over(w))


def align_start(calendar: DataFrame, day: Column, dt: str = "dt") -> DataFrame:
    """First trade day on or after ``day`` (a literal)."""
    return calendar.where(F.col(dt) >= day).agg(F.min(dt).alias(dt), F.min("idx").alias("idx"))


def align_end(calendar: DataFrame, day: Column, dt: str = "dt") -> DataFrame:
    """Last trade day on or before ``day`` (a literal)."""
    return calendar.where(F.col(dt) <= day).agg(F.max(dt).alias(dt), F.max("idx").alias("idx"))


def nearest_trade_days(days: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """For every distinct calendar ``day``: first trade day >= it and last trade day <= it.

    Days and calendar are merged and filled along one small ordered window.
    """
    both = days.select(F.col(day)).distinct().withColumn("_t", F.lit(None).cast("date")).unionByName(
        calendar.select(F.col("dt").alias(day), F.col("dt").alias("_t"))
    ).groupBy(day).agg(F.max("_t").alias("_t"), F.max(F.col("_t").isNull()).alias("_asked"))
    back = Window.partitionBy(F.lit(1)).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(F.lit(1)).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({
        "start_dt": F.last("_t", ignorenulls=True).over(ahead),
        "end_dt": F.last("_t", ignorenulls=True).over(back),
    }).where("_asked").drop("_t", "_asked")


def segment_with_lookback(
    panel: DataFrame, calendar: DataFrame, start: Column, end: Column, steps: int, dt: str = "dt"
) -> DataFrame:
    """Rows of [start, end] and of the ``steps`` trade days before it.

    ``in_segment`` marks the rows that belong to the segment; only those may be scored.
    """
    first = align_start(calendar, start, dt).select("idx").scalar()
    cal = F.broadcast(calendar.where((F.col("idx") >= first - steps) & (F.col(dt) <= end)))
    return panel.join(cal, dt).withColumn("in_segment", F.col(dt) >= start)


def roll_segments(calendar: DataFrame, segments: dict[str, tuple[str, str]], dt: str = "dt") -> DataFrame:
    """Move train / valid / test to the newest day, keeping lengths and gaps in trade days.

    ``segments`` maps the three names to (first, last) day texts. The result has one row
    per segment with old and new days.
    """
    names = ["train", "valid", "test"]
    marks = []
    for n in names:
        s, e = (F.lit(v).cast("date") for v in segments[n])
        marks += [
            F.min(F.when(F.col(dt) >= s, F.col("idx"))).alias(f"{n}_s"),
            F.max(F.when(F.col(dt) <= e, F.col("idx"))).alias(f"{n}_e"),
        ]
    at = calendar.agg(*marks, F.max("idx").alias("last"))
    shift = F.col("last") - F.col("test_e")
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("segment"), F.col(f"{n}_s").alias("old_s"), F.col(f"{n}_e").alias("old_e")) for n in names
    ]))
    moved = at.select(shift.alias("shift"), rows.alias("r")).select(
        "r.segment", (F.col("r.old_s") + F.col("shift")).alias("s"), (F.col("r.old_e") + F.col("shift")).alias("e"),
        (F.col("r.old_e") - F.col("r.old_s") + 1).alias("length"),
    )
    return moved.join(
        F.broadcast(calendar.select(F.col("idx").alias("s"), F.col(dt).alias("start_dt"))), "s", "left"
    ).join(F.broadcast(calendar.select(F.col("idx").alias("e"), F.col(dt).alias("end_dt"))), "e", "left").select(
        "segment", "length", "start_dt", "end_dt"
    )
