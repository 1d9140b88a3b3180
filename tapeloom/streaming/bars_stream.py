"""Intraday bars as a stream: tumbling days, late rows dropped by a watermark.

Only mergeable aggregates are kept in state (sums, counts, extremes, first and last), so
the state per (day, instrument) has a fixed size and partial aggregation runs before the
shuffle. Each closed day is one partition; a repeated batch writes the same partitions again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def utc_instant(local: Column) -> Column:
    """A zone-less time read as UTC, whatever the session zone; a watermark needs an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), local).cast("timestamp")


def utc_day(instant: Column) -> Column:
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")))


def daily_from_stream(bars: DataFrame, inst: str = "inst", time: str = "datetime", late: str = "1 hour") -> DataFrame:
    """Streaming daily bars over UTC days; rows later than the watermark are dropped."""
    v, tp = F.col("volume"), (F.col("high") + F.col("low") + F.col("close")) / 3
    day = F.window(F.col(time), "1 day")
    return bars.withWatermark(time, late).groupBy(day.alias("w"), inst).agg(
        F.min_by("open", time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", time).alias("close"),
        F.sum(v).alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("bars"),
        (F.sum(tp * v) / (F.sum(v) + 1e-12)).alias("vwap"), (F.sum(v * v) / F.pow(F.sum(v) + 1e-12, 2)).alias("hhi"),
    ).select(inst, utc_day(F.col("w.start")).alias("day"), "open", "high", "low", "close", "volume", "amount", "bars", "vwap", "hhi")


def run_to_days(daily: DataFrame, out: str, checkpoint: str, available_now: bool = True, seconds: int = 60, day: str = "day"):
    """Put closed days into the table at ``out``, one partition ``part=<day>`` each. Returns the query.

    A day closes for all instruments at once, so a batch holds whole days: it overwrites their
    partitions and no others, and a batch that is run again writes the same partitions again.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("part", F.date_format(day, "yyyy-MM-dd"))
        rows.repartitionByRange("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(out)

    w = daily.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")
    return w.start()


def late_rows(query) -> int:
    """Partial sums of closed days that ``query`` left out, over its kept progress: one per task, day and instrument of a batch, so 0 says none were late."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def stream_files(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
