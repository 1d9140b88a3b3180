"""Health counts of tables and factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import ratio
from tapeloom.scale import group_limit, quantiles, ranked_values, stitched
from tapeloom.session import materialize

#: Instruments whose rows are added up in one task.
PIECE = 50_000


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values, nulls, zeros and their shares, from one aggregate over the table."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__nan"), F.count(F.when(F.col(c) == 0, 1)).alias(f"{c}__zero")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("total_values"), F.col(f"{c}__nan").alias("nan_count"),
                 F.col(f"{c}__zero").alias("zero_count")) for c in columns
    ]))
    return wide.select(rows.alias("r")).select("r.*").withColumns({
        "nan_ratio": F.col("nan_count") / F.nullif(F.col("total_values"), F.lit(0)),
        "zero_ratio": F.col("zero_count") / F.nullif(F.col("total_values"), F.lit(0)),
    })


def table_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole-table values, nulls, zeros and shares."""
    c = column_counts(df, columns)
    total, nan, zero = F.sum("total_values"), F.sum("nan_count"), F.sum("zero_count")
    return c.agg(total.alias("total_values"), nan.alias("nan_count"), (nan / total).alias("nan_ratio"),
                 zero.alias("zero_count"), (zero / total).alias("zero_ratio"))


def factor_health(long: DataFrame, split: bool = False) -> DataFrame:
    """Null share, zero share, mean, sample deviation, p01 and p99 per factor."""
    x = F.col("x")
    n = F.count(F.lit(1))
    base = long.groupBy("factor").agg(
        (F.sum(x.isNull().cast("long")) / n).alias("nan_ratio"), (F.count(F.when(x == 0, 1)) / n).alias("zero_ratio"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
    )
    return base.join(F.broadcast(quantiles(long, ["factor"], "x", {"p01": 0.01, "p99": 0.99}, split)), "factor")


def entropy(long: DataFrame, bins: int = 20) -> DataFrame:
    """Entropy of an equal-width histogram on [min, max], natural log; 0 with one distinct value."""
    known = long.where(F.col("x").isNotNull())
    # one row per factor: broadcast
    ends = known.groupBy("factor").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    place = F.least(F.floor((F.col("x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    counts = known.join(F.broadcast(ends), "factor").groupBy("factor", F.coalesce(place, F.lit(0)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"))
    # sum(-p ln p) = ln N - sum(n ln n) / N
    total = F.sum("_n")
    return counts.groupBy("factor").agg((F.ln(total) - F.sum(F.col("_n") * F.ln("_n")) / total).alias("entropy"))


def extreme_share(long: DataFrame, low: float = 0.01, high: float = 0.99, split: bool = False) -> DataFrame:
    """Share of rows outside the two quantiles; null rows count as inside."""
    q = quantiles(long, ["factor"], "x", {"_lo": low, "_hi": high}, split)
    out = (F.col("x") < F.col("_lo")) | (F.col("x") > F.col("_hi"))
    rows = long.join(F.broadcast(q), "factor")
    return rows.groupBy("factor").agg((F.count(F.when(out, 1)) / F.count(F.lit(1))).alias("extreme_ratio"))


def shape(long: DataFrame) -> DataFrame:
    """Population skew and excess kurtosis per factor; 0 for a constant."""
    x = F.col("x")
    moves = F.min(x) < F.max(x)
    return long.groupBy("factor").agg(
        F.when(moves, F.skewness(x)).otherwise(0.0).alias("skew"), F.when(moves, F.kurtosis(x)).otherwise(0.0).alias("kurtosis"))


def panel_health(panel: DataFrame, factors: Sequence[str], bins: int = 20, low: float = 0.01, high: float = 0.99, split: bool = False) -> DataFrame:
    """Null and zero share, ``shape``, ``entropy`` and ``extreme_share`` of a written wide panel, in four reads.

    A factor without a known value has no entropy.
    """
    n, structs = F.count(F.lit(1)), []
    for f in factors:
        x = F.col(f).cast("double")
        moves = F.min(x) < F.max(x)
        structs.append(F.struct(
            F.lit(f).alias("factor"), n.alias("_rows"), ratio(F.sum(x.isNull().cast("long")), n).alias("nan_ratio"),
            ratio(F.count(F.when(x == 0, 1)), n).alias("zero_ratio"), F.when(moves, F.skewness(x)).otherwise(0.0).alias("skew"),
            F.when(moves, F.kurtosis(x)).otherwise(0.0).alias("kurtosis"), F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    base = panel.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("_rows > 0")
    long = panel.select(*factors).unpivot([], list(factors), "factor", "x")
    base = base.join(F.broadcast(quantiles(long, ["factor"], "x", {"_low": low, "_high": high}, split)), "factor")
    base = materialize(base, "health")
    x = F.col("x")
    place = F.least(F.floor((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    known = long.where(x.isNotNull()).join(F.broadcast(base.select("factor", "_lo", "_hi", "_low", "_high")), "factor")
    counts = known.groupBy("factor", F.coalesce(place, F.lit(0)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when((x < F.col("_low")) | (x > F.col("_high")), 1)).alias("_out"))
    # sum(-p ln p) = ln N - sum(n ln n) / N
    total = F.sum("_n")
    binned = counts.groupBy("factor").agg((F.ln(total) - F.sum(F.col("_n") * F.ln("_n")) / total).alias("entropy"), F.sum("_out").alias("_out"))
    rows = base.join(F.broadcast(binned), "factor", "left")
    return rows.select("factor", "nan_ratio", "zero_ratio", "entropy", "skew", "kurtosis",
                       (F.coalesce("_out", F.lit(0)) / F.col("_rows")).alias("extreme_ratio"))


def with_null_gaps(panel: DataFrame, factors: Sequence[str], inst: str = "inst", dt: str = "dt") -> DataFrame:
    """``_pos``, the row's place in its instrument, and per factor the nulls between a known value and the one before it there."""
    own = Window.partitionBy(inst).orderBy(dt)
    rows = panel.withColumn("_pos", F.row_number().over(own))
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    seen = {f: F.when(F.col(f).isNotNull(), F.col("_pos")) for f in factors}
    rows = rows.withColumns({f"_gap_{f}": F.last(c, ignorenulls=True).over(upto) for f, c in seen.items()})
    return rows.withColumns({f"_gap_{f}": F.when(F.col(f).isNotNull(), F.col("_pos") - F.col(f"_gap_{f}") - 1) for f in factors})


def longest_null_run(panel: DataFrame, factors: Sequence[str], inst: str = "inst", dt: str = "dt", split: bool = False) -> DataFrame:
    """Longest run of nulls over the rows ordered by (inst, dt), as a share of all rows.

    A run lies between two known values of one instrument (see ``with_null_gaps``, whose columns are used if there), or it
    crosses instruments. For those, each instrument gives the places of its first and last known value, so one row per
    instrument and factor is ordered, in chunks of places on large tables, instead of every known value.
    """
    factors = list(factors)
    if "_pos" not in panel.columns:
        panel = with_null_gaps(panel.select(inst, dt, *factors), factors, inst, dt)
    sides = {f: F.when(F.col(f).isNotNull(), F.col("_pos")) for f in factors}
    ends = panel.groupBy(inst).agg(F.count(F.lit(1)).alias("_n"), F.array(*[
        F.struct(F.lit(f).alias("factor"), F.min(p).alias("first"), F.max(p).alias("last"), F.max(f"_gap_{f}").alias("gap"))
        for f, p in sides.items()]).alias("_f"))
    ends = materialize(ends, "ends")
    if split:
        before = Window.partitionBy("_b").orderBy(inst).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.join(ranked_values(ends.select(inst), [], inst).select(inst, F.floor((F.col("dense") - 1) / PIECE).alias("_b")), inst)
        along = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        heads = ends.groupBy("_b").agg(F.sum("_n").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_head"))
        ends = ends.join(F.broadcast(heads), "_b").withColumn("_off", F.col("_head") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        before = Window.partitionBy(F.lit(1)).orderBy(inst).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = ends.select("_n", "_off", F.explode("_f").alias("_f")).select("_n", "_off", "_f.*")
    sizes = rows.groupBy("factor").agg(F.sum("_n").alias("_all"))
    known = rows.where(F.col("first").isNotNull()).select(
        "factor", "gap", (F.col("_off") + F.col("first")).alias("first"), (F.col("_off") + F.col("last")).alias("last"))
    chunk = None
    if split:
        chunk = "_chunk"
        known = known.withColumn(chunk, F.floor(F.col("first") / F.lit(group_limit(panel.sparkSession))))
    known = stitched(known, ["factor"], ["first"], chunk, previous={"prev": "last"})
    between = F.col("first") - F.coalesce("prev", F.lit(0)) - 1
    gaps = known.groupBy("factor").agg(F.max(F.greatest(between, F.coalesce("gap", F.lit(0)))).alias("_gap"), F.max("last").alias("_last"))
    run = F.greatest(F.coalesce("_gap", F.lit(0)), F.col("_all") - F.coalesce("_last", F.lit(0)))
    return sizes.join(F.broadcast(gaps), "factor", "left").select("factor", ratio(run, F.col("_all")).alias("max_nan_streak_ratio"))
