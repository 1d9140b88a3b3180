"""Intraday bars to one row per (day, instrument), and daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import correlation
from tapeloom.scale import per_group, stitched

EPS = 1e-12

# The 24 output columns, in their published order (fixed names).
INTRADAY_COLUMNS = [
    "d_vol", "d_ret_skew", "d_ret_kurt", "d_realized_vol",
    "d_hhi", "d_vol_skew", "d_vol_kurt", "d_vol_cv",
    "d_corr", "d_dwr", "d_trades_vol_corr", "d_trades_close_corr", "d_volatility_of_volume",
    "d_vwap", "d_open_vwap", "d_close_vwap", "d_am_vwap", "d_pm_vwap",
    "d_cntp", "d_cntn", "d_intraday_trend", "d_high_time_frac", "d_low_time_frac", "d_close_rank",
]


def sample_skew(x: Column) -> Column:
    """Bias-corrected skew: null below 3 values, 0 for a constant."""
    n = F.count(x)
    return (
        F.when(n < 3, None)
        .when(F.max(x) == F.min(x), 0.0)
        .otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
    )


def sample_kurt(x: Column) -> Column:
    """Bias-corrected excess kurtosis: null below 4 values, 0 for a constant."""
    n = F.count(x)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    return (
        F.when(n < 4, None)
        .when(F.max(x) == F.min(x), 0.0)
        .otherwise(scale * ((n + 1) * F.kurtosis(x) + 6))
    )


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null when either side is constant."""
    return correlation(x, y)


def clean_bars(bars: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Numbers cast with bad text to null; rows without keys or time dropped."""
    numeric = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in bars.columns]
    kinds = dict(bars.dtypes)
    casts = {c: F.col(c).try_cast("double") for c in numeric if kinds[c] != "double"}
    return (bars.withColumns(casts) if casts else bars).na.drop(subset=[*keys, time])


def chunk_of(time: str, minutes: int | None) -> Column:
    """Minute-of-day bucket; grows with time inside a day."""
    return F.floor((F.hour(time) * 60 + F.minute(time)) / F.lit(minutes)).cast("int")


def intraday_features(
    bars: DataFrame, keys: Sequence[str] = ("day", "inst"), time: str = "datetime",
    chunk_minutes: int | None = None, weight: str = "amount", columns: Sequence[str] | None = None,
) -> DataFrame:
    """The 24 intraday columns per (day, instrument).

    One exchange orders the bars, a second carries aggregate partials. With
    ``chunk_minutes`` a day of one instrument is ordered in pieces (see ``scale.stitched``)
    so that a hot group is spread over tasks; all sums combine map-side either way.
    """
    keys = list(keys)
    want = list(columns or INTRADAY_COLUMNS)
    rows = clean_bars(bars, keys, time)
    chunk = None
    if chunk_minutes:
        chunk = "_chunk"
        rows = rows.withColumn(chunk, chunk_of(time, chunk_minutes))
    rows = stitched(rows, keys, [time], chunk, number="bar_no", previous={"prev_close": "close"})
    if chunk:
        rows = per_group(rows, keys, F.min(time).alias("t0"), F.max(time).alias("t1"), F.min_by("open", time).alias("open0"))
    else:
        day = Window.partitionBy(*keys)
        rows = rows.withColumns({
            "t0": F.min(time).over(day), "t1": F.max(time).over(day),
            "open0": F.first("open").over(day.orderBy(time)),
        })
    close, volume, w, no = F.col("close"), F.col("volume"), F.col(weight), F.col("bar_no")
    prev = F.col("prev_close")
    ret = F.when((prev > 0) & (close > 0), F.ln(close / prev))
    rows = rows.withColumns({
        "r": ret,
        "pv": (F.col("high") + F.col("low") + close) / 3 * volume,
        "ref": F.coalesce(prev, F.col("open0")),
    })
    r, pv = F.col("r"), F.col("pv")

    def vwap(cond: Column | None = None) -> Column:
        if cond is None:
            return F.sum(pv) / (F.sum(volume) + EPS)
        inside = F.sum(F.when(cond, pv)) / (F.sum(F.when(cond, volume)) + EPS)
        return F.when(F.count(F.when(cond, 1)) > 0, inside)

    half_hour = F.expr("INTERVAL 30 MINUTES")
    n = F.count(F.lit(1))
    later = no > 1
    aggs = {
        "d_vol": F.stddev_samp(r),
        "d_ret_skew": sample_skew(r),
        "d_ret_kurt": sample_kurt(r),
        "d_realized_vol": F.sqrt(F.coalesce(F.sum(r * r), F.lit(0.0))),
        "d_hhi": F.sum(volume * volume) / F.pow(F.sum(volume) + EPS, 2),
        "d_vol_skew": sample_skew(volume),
        "d_vol_kurt": sample_kurt(volume),
        "d_vol_cv": F.stddev_samp(volume) / (F.avg(volume) + EPS),
        "d_corr": guarded_corr(close, volume),
        "d_dwr": F.when(F.count(r) > 1, F.sum(F.when(later, w * r)) / (F.sum(F.when(later, w)) + EPS)),
        "d_trades_vol_corr": guarded_corr(F.col("num_trades"), volume),
        "d_trades_close_corr": guarded_corr(F.col("num_trades"), close),
        "d_volatility_of_volume": F.stddev_samp(volume),
        "d_vwap": vwap(),
        "d_open_vwap": vwap(F.col(time) < F.col("t0") + half_hour),
        "d_close_vwap": vwap(F.col(time) > F.col("t1") - half_hour),
        "d_am_vwap": vwap(F.hour(time) < 12),
        "d_pm_vwap": vwap(F.hour(time) >= 12),
        "d_cntp": F.avg(F.when(close > F.col("ref"), 1.0).otherwise(0.0)),
        "d_cntn": F.avg(F.when(close < F.col("ref"), 1.0).otherwise(0.0)),
        "d_intraday_trend": F.when(F.count(close) > 2, F.regr_slope(close, (no - 1).cast("double"))),
        "d_high_time_frac": (F.max_by(no, F.struct(F.col("high"), -no)) - 1) / n,
        "d_low_time_frac": (F.max_by(no, F.struct(-F.col("low"), -no)) - 1) / n,
        "d_close_rank": (F.max_by(close, F.col(time)) - F.min(close)) / (F.max(close) - F.min(close) + EPS),
        # names of the older form
        "d_trades_skew": sample_skew(F.col("num_trades")),
        "d_trades_corr": guarded_corr(F.col("num_trades"), volume),
    }
    return rows.groupBy(*keys).agg(*[aggs[c].alias(c) for c in want])


def daily_bars(
    ticks: DataFrame, keys: Sequence[str], order: Sequence[str], *, price: str | None = None, open: str | None = None,
    high: str | None = None, low: str | None = None, close: str | None = None, volume: str, amount: str,
    open_interest: str | None = None, dominant: str | None = None,
) -> DataFrame:
    """First / max / min / last / sum per key. Give ``price`` for ticks or the four bar columns.

    First and last are the first and last known values: bars without one are passed over.
    All parts are mergeable, so partial aggregation runs before the only exchange.
    """
    o, h, lo, c = (x or price for x in (open, high, low, close))
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    def known(x: str) -> Column:
        return F.when(F.col(x).isNotNull(), key)

    aggs = [
        F.min_by(o, known(o)).alias("open"), F.max(h).alias("high"), F.min(lo).alias("low"), F.max_by(c, known(c)).alias("close"),
        F.sum(volume).alias("volume"), F.round(F.sum(amount), 2).alias("amount"),
    ]
    if open_interest:
        aggs.append(F.max_by(open_interest, known(open_interest)).alias("open_interest"))
    if dominant:
        aggs.append(F.max_by(dominant, known(dominant)).alias("dominant_id"))
    return ticks.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("num_trades"))


def roll_counts(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], dominant: str, chunk: str | None = None) -> DataFrame:
    """Switches of the dominant id inside a day; the first bar is not a switch."""
    rows = stitched(ticks, keys, order, chunk, number="_no", previous={"_prev": dominant})
    changed = (F.col("_no") > 1) & ~F.col(dominant).eqNullSafe(F.col("_prev"))
    return rows.groupBy(*keys).agg(F.sum(changed.cast("long")).alias("roll_count"))


def roll_flags(daily: DataFrame, inst: str = "inst", dt: str = "dt", dominant: str = "dominant_id") -> DataFrame:
    """1 where the last dominant id of the day differs from the day before; first day 0."""
    w = Window.partitionBy(inst).orderBy(dt)
    changed = ~F.col(dominant).eqNullSafe(F.lag(dominant).over(w))
    return daily.withColumn("roll_flag", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(changed.cast("int")))


def multiplier_table(info: DataFrame, inst: str, value: str, order: Sequence[str]) -> DataFrame:
    """Last stated multiplier per upper-cased id (by ``order``); rows without a number are skipped."""
    rows = info.withColumns({inst: F.upper(F.col(inst).cast("string")), value: F.col(value).try_cast("double")})
    rows = rows.na.drop(subset=[inst, value])
    return rows.groupBy(inst).agg(F.max_by(value, F.struct(*order)).alias(value))


def with_multiplier(panel: DataFrame, table: DataFrame, inst: str = "inst", value: str = "contract_multiplier") -> DataFrame:
    """Multiplier per row; 1 where none is known or it is not positive."""
    found = F.when(F.col(value) > 0, F.col(value))
    return panel.join(table, inst, "left").withColumn(value, F.coalesce(found, F.lit(1.0)))


def futures_vwap(amount: Column, volume: Column, multiplier: Column) -> Column:
    return F.when(volume > 0, amount / (volume * multiplier + EPS))


def base_close(panel: DataFrame, inst: str = "inst", dt: str = "dt", close: str = "close", window: int = 30) -> DataFrame:
    """Median of the first ``window`` positive closes, else the first one, else 1.

    The cut to ``window`` rows comes before the median, so its input is bounded.
    """
    ok = F.col(close).isNotNull() & (F.col(close) > 0) & (F.abs(F.col(close)) < float("inf"))
    first = panel.where(ok).withColumn("_n", F.row_number().over(Window.partitionBy(inst).orderBy(dt)))
    first = first.where(F.col("_n") <= window).groupBy(inst).agg(
        F.when(F.count(F.lit(1)) >= window, F.median(close)).otherwise(F.min_by(close, dt)).alias("_base")
    )
    names = panel.select(inst).distinct()
    return names.join(first, inst, "left").select(inst, F.coalesce("_base", F.lit(1.0)).alias("base_close"))


def with_base_close(panel: DataFrame, inst: str = "inst", dt: str = "dt", close: str = "close", window: int = 30) -> DataFrame:
    """``base_close`` on every row, inside the instrument's own partition: no join.

    At most ``window`` closes are gathered per instrument.
    """
    c = F.col(close)
    ok = F.coalesce((c > 0) & (F.abs(c) < float("inf")), F.lit(False))
    own = Window.partitionBy(inst)
    rows = panel.withColumn("_n", F.sum(ok.cast("int")).over(own.orderBy(dt)))
    first = F.sort_array(F.collect_list(F.when(ok & (F.col("_n") <= window), c)).over(own))
    rows = rows.withColumns({"_first": first, "_one": F.min(F.when(ok & (F.col("_n") == 1), c)).over(own)})
    lo, hi = (window - 1) // 2, window // 2
    median = (F.get("_first", F.lit(lo)) + F.get("_first", F.lit(hi))) / 2
    base = F.when(F.size("_first") >= window, median).otherwise(F.coalesce("_one", F.lit(1.0)))
    return rows.withColumn("base_close", base).drop("_n", "_first", "_one")


def normalize_panel(
    panel: DataFrame, calendar: DataFrame, multipliers: DataFrame, inst: str = "inst", dt: str = "dt", window: int = 30
) -> DataFrame:
    """Scale by the base price, align to the calendar, blank bad values and fill gaps.

    Prices are divided by the base, volume is multiplied by base and multiplier;
    ``adjclose`` keeps the raw close. Exchanges: one per key ``inst`` for everything.
    """
    from tapeloom.operators.calendar import align
    from tapeloom.operators.clean import fill_both_ways, positive_or_null

    rows = with_multiplier(with_base_close(panel, inst, dt, window=window), multipliers, inst)
    b = F.col("base_close")
    prices = [c for c in ("open", "high", "low", "close", "vwap") if c in panel.columns]
    rows = rows.withColumn("adjclose", F.col("close")).withColumns({c: F.col(c) / (b + EPS) for c in prices})
    rows = rows.withColumn("volume", F.col("volume") * b * F.col("contract_multiplier")).drop("base_close", "contract_multiplier")
    rows = align(rows, calendar, inst, dt)
    check = [c for c in (*prices, "volume", "amount", "open_interest", "adjclose") if c in rows.columns]
    rows = rows.withColumns({c: positive_or_null(F.col(c)) for c in check})
    fixed = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (("factor", 1.0), ("roll_count", 0), ("roll_flag", 0)) if c in rows.columns}
    rows = rows.withColumns(fixed) if fixed else rows
    return fill_both_ways(rows, check, inst, dt, default=EPS)
