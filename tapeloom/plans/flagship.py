"""The flagship: from raw rows to a judged feature, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import rolling as W
from tapeloom.operators import ranking
from tapeloom.plans.frames import Tables, with_frames


def label_rank_ic(spark: SparkSession, sf_dir: str, min_names: int = 10) -> DataFrame:
    """Daily bars -> 5-day mean and deviation over close -> label -> rank IC -> summary per factor."""
    t = Tables(spark, sf_dir)
    panel = t.daily().select(
        "inst", "dt",
        F.round(W.mean("close", 5) / F.col("close"), 8).alias("MA_5"),
        F.round(W.std("close", 5) / F.col("close"), 8).alias("STD_5"),
        F.round(W.ahead("close", 5) / W.ahead("close", 1) - 1, 8).alias("label"),
    )
    long = ranking.to_long(panel, ["MA_5", "STD_5"])
    daily = ranking.daily_rank_ic(long, min_names=min_names, split=t.wide_days())
    return daily.groupBy("factor").agg(
        F.round(F.avg("rank_ic"), 8).alias("rankic_mean"),
        F.round(F.stddev_samp("rank_ic"), 8).alias("rankic_std"),
        F.round(F.avg("rank_ic") / (F.stddev_samp("rank_ic") + 1e-6), 8).alias("rankic_ir"),
        F.count(F.lit(1)).alias("days"),
    )


RANKS = """SELECT *, rank() OVER (PARTITION BY dt, factor ORDER BY x) + (count(*) OVER (PARTITION BY dt, factor, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY dt, factor ORDER BY label) + (count(*) OVER (PARTITION BY dt, factor, label) - 1) / 2.0 AS ry
 FROM {src} WHERE x IS NOT NULL AND label IS NOT NULL"""

FLAGSHIP_SQL = with_frames(
    """SELECT factor, round(avg(rank_ic), 8) AS rankic_mean, round(stddev_samp(rank_ic), 8) AS rankic_std,
 round(avg(rank_ic) / (stddev_samp(rank_ic) + 1e-6), 8) AS rankic_ir, count(*) AS days FROM ic GROUP BY factor""",
    "daily",
    panel="""SELECT inst, dt, round(avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / close, 8) AS ma,
 round(stddev_samp(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / close, 8) AS sd,
 round(lead(close, 5) OVER w / lead(close, 1) OVER w - 1, 8) AS label FROM daily WINDOW w AS (PARTITION BY inst ORDER BY dt)""",
    long="SELECT inst, dt, label, unnest(['MA_5', 'STD_5']) AS factor, unnest([ma, sd]) AS x FROM panel",
    ranks=RANKS.format(src="long"),
    ic="""SELECT dt, factor, round(corr(rx, ry), 12) AS rank_ic FROM ranks GROUP BY dt, factor
 HAVING count(*) >= 10 AND min(rx) < max(rx) AND min(ry) < max(ry)""",
)
