"""Factor and model scores: daily correlations and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.stats import correlation
from tapeloom.scale import spread, with_ranks


def to_long(panel: DataFrame, factors: Sequence[str], keep: Sequence[str] = ("inst", "dt", "label")) -> DataFrame:
    """(keep..., factor, x). Multiplies rows by the factor count: pass at most about 50 at once."""
    return panel.select(*keep, *factors).unpivot(list(keep), list(factors), "factor", "x")


def daily_rank_ic(
    long: DataFrame, by: Sequence[str] = ("dt", "factor"), x: str = "x", y: str = "label",
    min_names: int = 10, split: bool = False,
) -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` per group, with the usable share of its rows.

    Groups need ``min_names`` pairs and more than one distinct value on both sides. The
    value is rounded to 12 places, so that a true zero has no stray sign.
    """
    by = list(by)
    usable = F.col(x).isNotNull() & F.col(y).isNotNull()
    pairs = long.where(usable)
    ranked = with_ranks(pairs, by, x, avg="_rx", split=split)
    ranked = with_ranks(ranked, by, y, avg="_ry", split=split, source=pairs)
    ic = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("names"), F.round(correlation("_rx", "_ry"), 12).alias("rank_ic"))
    ic = ic.where((F.col("names") >= min_names) & F.col("rank_ic").isNotNull())
    size = long.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    return ic.join(size, by).select(*by, "names", "rank_ic", (F.col("names") / F.col("_all")).alias("coverage"))


def _average_ranks(v: np.ndarray) -> np.ndarray:
    _, place, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[place]


def panel_rank_ic(
    panel: DataFrame, factors: Sequence[str], label: str = "label", dt: str = "dt", min_names: int = 10, split: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """``daily_rank_ic`` of every factor of a wide panel.

    A day's rows meet once in a task, which ranks all factors; the long form would shuffle and sort the panel twice per factor.
    ``split`` (a day too large for a task) takes the long form. ``rows``: those of the panel, if known, to deal the days by.
    """
    factors = list(factors)
    if split:
        return daily_rank_ic(to_long(panel, factors, [dt, label]), [dt, "factor"], y=label, min_names=min_names, split=True)
    kinds = dict(panel.dtypes)
    wide = panel.where(F.col(dt).isNotNull()).select(dt, F.col(label).cast("double"), *[F.col(f).cast("double") for f in factors])
    wide = spread(wide, rows or 0, dt)

    def day(table: pa.Table) -> pa.Table:
        def column(c):
            v = table.column(c)
            return v.is_valid().to_numpy(), v.to_numpy()

        y_there, y = column(label)
        found = []
        for f in factors:
            x_there, x = column(f)
            both = x_there & y_there
            n = int(both.sum())
            if n < min_names:
                continue
            # ranks are halves, so these sums are exact; the mean rank is always (n + 1) / 2
            rx, ry = (_average_ranks(v[both]) - (n + 1) / 2.0 for v in (x, y))
            xx, yy = float(rx @ rx), float(ry @ ry)
            if xx > 0 and yy > 0:
                found.append((f, n, float(rx @ ry) / (xx**0.5 * yy**0.5), n / table.num_rows))
        cols = list(zip(*found)) or [(), (), (), ()]
        return pa.table({
            dt: table.column(dt).slice(0, 1).take(pa.array([0] * len(found), pa.int32())), "factor": pa.array(cols[0], pa.string()), "names": pa.array(cols[1], pa.int64()),
            "rank_ic": pa.array(cols[2], pa.float64()), "coverage": pa.array(cols[3], pa.float64())})

    out = wide.groupBy(dt).applyInArrow(day, f"{dt} {kinds[dt]}, factor string, names long, rank_ic double, coverage double")
    return out.withColumn("rank_ic", F.round("rank_ic", 12))


def daily_ic(
    scored: DataFrame, by: Sequence[str] = ("dt",), pred: str = "score", label: str = "label", split: bool = False
) -> DataFrame:
    """Pearson ``ic`` and Spearman ``ric`` of a score per group; null where a side is constant."""
    by = list(by)
    pairs = scored.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    ranked = with_ranks(pairs, by, pred, avg="_rp", split=split)
    ranked = with_ranks(ranked, by, label, avg="_rl", split=split, source=pairs)
    return ranked.groupBy(*by).agg(correlation(pred, label).alias("ic"), correlation("_rp", "_rl").alias("ric"))


def model_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IC, ICIR, RIC, RICIR with the population deviation; null days are skipped."""

    def ir(c: str) -> Column:
        return F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0))

    return daily.groupBy(*by).agg(
        F.avg("ic").alias("IC"), ir("ic").alias("ICIR"), F.avg("ric").alias("RIC"), ir("ric").alias("RICIR")
    )


def sign_stability(ic: Column) -> Column:
    """Share of days whose sign is the sign of the mean: one of three shares, known after the sum."""
    mean = F.avg(ic)

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    return F.when(mean > 0, share(ic > 0)).when(mean < 0, share(ic < 0)).otherwise(share(ic == 0))


def rank_ic_summary(daily: DataFrame, by: Sequence[str] = ("factor",), ic: str = "rank_ic") -> DataFrame:
    """Mean, sample deviation, IR, quartiles, positive share, sign stability and mean coverage.

    The series has one row per day, so the percentile state is bounded by the calendar.
    """
    c = F.col(ic)
    return daily.groupBy(*by).agg(
        F.avg(c).alias("rankic_mean"),
        F.stddev_samp(c).alias("rankic_std"),
        (F.avg(c) / (F.stddev_samp(c) + 1e-6)).alias("rankic_ir"),
        F.percentile(c, F.lit(0.25)).alias("rankic_q25"),
        F.percentile(c, F.lit(0.5)).alias("rankic_q50"),
        F.percentile(c, F.lit(0.75)).alias("rankic_q75"),
        F.avg((c > 0).cast("double")).alias("positive_ratio"),
        sign_stability(c).alias("sign_stability"),
        F.avg("coverage").alias("coverage"),
    )


def ic_summary(daily: DataFrame, by: Sequence[str] = ("factor",), ic: str = "rank_ic") -> DataFrame:
    """Mean, deviation, IR (0 without deviation), mean of absolute values, days."""
    c = F.col(ic)
    sd = F.stddev_samp(c)
    return daily.groupBy(*by).agg(
        F.avg(c).alias("ic_mean"), sd.alias("ic_std"),
        F.when(sd > 0, F.avg(c) / F.nullif(sd, F.lit(0.0))).otherwise(0.0).alias("ic_ir"),
        F.avg(F.abs(c)).alias("ic_abs_mean"), F.count(c).alias("ic_obs"),
    )
