"""Same-day and whole-panel normalisation, labels, lookback tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as W
from tapeloom.operators.clean import finite
from tapeloom.scale import per_group, quantiles, row_numbers, with_ranks


def _clip(x: Column, bound: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def robust_fit(train: DataFrame, columns: Sequence[str], split: bool = False) -> DataFrame:
    """(factor, median, mad) over the train rows; mad is the median absolute deviation * 1.4826."""
    long = train.select(*columns).unpivot([], list(columns), "factor", "x")
    med = quantiles(long, ["factor"], "x", {"median": 0.5}, split)
    # one row per column name: broadcast
    dev = long.join(F.broadcast(med), "factor").select("factor", F.abs(F.col("x") - F.col("median")).alias("x"))
    mad = quantiles(dev, ["factor"], "x", {"mad": 0.5}, split)
    return med.join(F.broadcast(mad), "factor").withColumn("mad", F.col("mad") * 1.4826)


def apply_fit(df: DataFrame, fit: DataFrame, columns: Sequence[str], center: str, scale: str, floor: float, clip: float | None = None) -> DataFrame:
    """(x - center) / (scale + floor) per column, clipped.

    The fit has one row per column; it reaches the rows as one small map.
    """
    table = fit.agg(F.map_from_entries(F.collect_list(F.struct("factor", F.struct(center, scale))))).scalar()
    df = df.withColumn("_fit", table)
    out = {}
    for c in columns:
        f = F.col("_fit")[c]
        z = (F.col(c) - f[center]) / (f[scale] + floor)
        out[c] = _clip(z, clip) if clip else z
    return df.withColumns(out).drop("_fit")


def robust_zscore(df: DataFrame, train: DataFrame, columns: Sequence[str], clip: float = 3.0, split: bool = False) -> DataFrame:
    """Centre by the train median, scale by the train MAD, clip. Nothing after the train span is fitted."""
    return apply_fit(df, robust_fit(train, columns, split), columns, "median", "mad", 1e-12, clip)


def global_zscore(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One fit aggregate over the train rows; infinities are null before it."""
    clean = train.select(*[finite(F.col(c)).alias(c) for c in columns])
    long = clean.unpivot([], list(columns), "factor", "x")
    fit = long.groupBy("factor").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return apply_fit(df.withColumns({c: finite(F.col(c)) for c in columns}), fit, columns, "mean", "std", 1e-12)


def day_zscore(df: DataFrame, columns: Sequence[str], dt: str = "dt", population: bool = False, floor: float | None = None) -> DataFrame:
    """Per-day z-score. Days are few: their totals are broadcast, a wide day stays spread out."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = [a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), sd(c).alias(f"_s_{c}"))]
    rows = per_group(df, [dt], *aggs, bounded=True)
    out = {}
    for c in columns:
        s = F.greatest(F.col(f"_s_{c}"), F.lit(floor)) if floor else F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        out[c] = (F.col(c) - F.col(f"_m_{c}")) / s
    return rows.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def day_rank_norm(df: DataFrame, column: str, out: str, dt: str = "dt", split: bool = False) -> DataFrame:
    """(average percent rank - 0.5) * 3.46 inside the day."""
    rows = with_ranks(df, [dt], column, pct="_pct", split=split)
    return rows.withColumn(out, (F.col("_pct") - 0.5) * 3.46).drop("_pct")


def drop_extreme(df: DataFrame, label: str, dt: str = "dt", inst: str = "inst", share: float = 0.025, split: bool = False) -> DataFrame:
    """Per day, drop k = int(share * n) rows at each end of the label; keep all where k is 0."""
    rows = df.where(F.col(label).isNotNull())
    rows = per_group(rows, [dt], F.count(F.lit(1)).alias("_n"), bounded=True)
    rows = row_numbers(rows, [dt], label, inst, "_pos", split)
    k = F.floor(F.col("_n") * F.lit(share))
    keep = (k <= 0) | (2 * k >= F.col("_n")) | ((F.col("_pos") > k) & (F.col("_pos") <= F.col("_n") - k))
    return rows.where(keep).drop("_n", "_pos")


def daily_subsample(df: DataFrame, n: int, seed: int = 0, dt: str = "dt", inst: str = "inst") -> DataFrame:
    """At most ``n`` rows per day in a repeatable random order (a sampling operator).

    The limit is pushed before the shuffle by Spark's group limit.
    """
    order = F.xxhash64(F.col(inst), F.col(dt), F.lit(seed))
    w = Window.partitionBy(dt).orderBy(order, inst)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def daily_return(x="close") -> Column:
    return F.col(x) / F.nullif(W.ref(x, 1), F.lit(0.0)) - 1


def return_from_first(x="close") -> Column:
    return F.col(x) / F.nullif(F.first(x).over(W.own().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - 1


def running_max(x="close") -> Column:
    return F.max(x).over(W.own().rowsBetween(Window.unboundedPreceding, 0))


def previous_close(x="close") -> Column:
    return F.coalesce(W.ref(x, 1), F.col(x))


def lookback_tensor(df: DataFrame, features: Sequence[str], steps: int = 8, out: str = "tensor", pad: str = "zero") -> DataFrame:
    """Last ``steps`` rows of the features per (inst, dt) as an array of arrays.

    ``pad="zero"`` puts zero rows in front of a short history. ``pad="fill"`` fills gaps
    inside the window forward, then backward, so a short history repeats its first row.
    """
    w = W.last_rows(steps)
    if pad == "zero":
        seen = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(w)
        zero = F.array(*[F.lit(0.0)] * len(features))
        rows = df.withColumn("_seen", seen)
        missing = F.lit(steps) - F.size("_seen")
        return rows.withColumn(out, F.concat(F.array_repeat(zero, missing), F.col("_seen"))).drop("_seen")
    # step i of a feature: its own value, else the nearest earlier, else the nearest later
    steps_back = range(steps - 1, -1, -1)
    lags = {f"_{c}_{k}": F.col(c).cast("double") if k == 0 else W.ref(c, k).cast("double") for c in features for k in steps_back}

    def step(c: str, k: int) -> Column:
        nearest = [*range(k, steps), *range(k - 1, -1, -1)]
        return F.coalesce(*[F.col(f"_{c}_{n}") for n in nearest])

    row = F.array(*[F.array(*[step(c, k) for c in features]) for k in steps_back])
    return df.withColumns(lags).withColumn(out, row).drop(*lags)
