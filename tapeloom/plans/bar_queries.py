"""Queries for intraday bars, daily bars, normalisation and spans (A01-A34, X09-X11, J10, J14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import calendar as C
from tapeloom.operators import clean, spans
from tapeloom.plans.frames import BAR_ORDER, Tables, with_frames
from tapeloom.plans.registry import columns_of, query


def day(c="dt"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def rnd(c: str, n: int = 6, name: str | None = None):
    return F.round(F.col(c), n).alias(name or c)


# --- A01-A25 -------------------------------------------------------------------------
def intraday(t: Tables, column: str) -> DataFrame:
    out = B.intraday_features(t.bars(), chunk_minutes=t.bar_chunk_minutes(), columns=[column])
    return out.select(day("day"), "inst", rnd(column))


_ORDERED = """SELECT *, row_number() OVER w AS no, lag(close) OVER w AS prev, min(datetime) OVER g AS t0, max(datetime) OVER g AS t1,
 first_value(open) OVER w AS open0, max(high) OVER g AS hi, min(low) OVER g AS lo, (high + low + close) / 3 * volume AS pv
 FROM bars WINDOW w AS (PARTITION BY day, inst ORDER BY datetime), g AS (PARTITION BY day, inst)"""
_RET = "SELECT *, CASE WHEN prev > 0 AND close > 0 THEN ln(close / prev) END AS r FROM ordered"


def _skew(x: str) -> str:
    return f"CASE WHEN count({x}) >= 3 THEN CASE WHEN max({x}) = min({x}) THEN 0 ELSE skewness({x}) END END"


def _kurt(x: str) -> str:
    return f"CASE WHEN count({x}) >= 4 THEN CASE WHEN max({x}) = min({x}) THEN 0 ELSE kurtosis({x}) END END"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN corr({x}, {y}) END"


def _vwap(cond: str) -> str:
    return f"CASE WHEN count(*) FILTER ({cond}) > 0 THEN sum(pv) FILTER ({cond}) / (sum(volume) FILTER ({cond}) + 1e-12) END"


INTRADAY_SQL = {
    "d_vol": "stddev_samp(r)",
    "d_ret_skew": _skew("r"),
    "d_ret_kurt": _kurt("r"),
    "d_realized_vol": "sqrt(coalesce(sum(r * r), 0))",
    "d_hhi": "sum(volume * volume) / pow(sum(volume) + 1e-12, 2)",
    "d_vol_skew": _skew("volume"),
    "d_vol_kurt": _kurt("volume"),
    "d_vol_cv": "stddev_samp(volume) / (avg(volume) + 1e-12)",
    "d_corr": _corr("close", "volume"),
    "d_dwr": "CASE WHEN count(r) > 1 THEN sum(amount * r) FILTER (no > 1) / (sum(amount) FILTER (no > 1) + 1e-12) END",
    "d_trades_vol_corr": _corr("num_trades", "volume"),
    "d_trades_close_corr": _corr("num_trades", "close"),
    "d_volatility_of_volume": "stddev_samp(volume)",
    "d_vwap": "sum(pv) / (sum(volume) + 1e-12)",
    "d_open_vwap": _vwap("datetime < t0 + INTERVAL 30 MINUTE"),
    "d_close_vwap": _vwap("datetime > t1 - INTERVAL 30 MINUTE"),
    "d_am_vwap": _vwap("hour(datetime) < 12"),
    "d_pm_vwap": _vwap("hour(datetime) >= 12"),
    "d_cntp": "avg(CASE WHEN close > coalesce(prev, open0) THEN 1.0::DOUBLE ELSE 0.0 END)",
    "d_cntn": "avg(CASE WHEN close < coalesce(prev, open0) THEN 1.0::DOUBLE ELSE 0.0 END)",
    "d_intraday_trend": "CASE WHEN count(close) > 2 THEN regr_slope(close, no - 1) END",
    "d_high_time_frac": "(min(no) FILTER (high = hi) - 1) / count(*)::DOUBLE",
    "d_low_time_frac": "(min(no) FILTER (low = lo) - 1) / count(*)::DOUBLE",
    "d_close_rank": "(max(close) FILTER (datetime = t1) - min(close)) / (max(close) - min(close) + 1e-12)",
    "d_trades_skew": _skew("num_trades"),
    "d_trades_corr": _corr("num_trades", "volume"),
}


def intraday_sql(column: str) -> str:
    return with_frames(
        f"SELECT CAST(day AS VARCHAR) AS day, inst, round({INTRADAY_SQL[column]}, 6) AS {column} FROM rets GROUP BY day, inst",
        "bars", ordered=_ORDERED, rets=_RET,
    )


columns_of("a", {f"{i + 1:02d}_{c}": c for i, c in enumerate(B.INTRADAY_COLUMNS)}, intraday, intraday_sql)
columns_of("a25_", {"d_trades_skew": "d_trades_skew", "d_trades_corr": "d_trades_corr"}, intraday, intraday_sql)


@query("a00_intraday_all", with_frames(
    "SELECT CAST(day AS VARCHAR) AS day, inst, " + ", ".join(f"round({INTRADAY_SQL[c]}, 6) AS {c}" for c in B.INTRADAY_COLUMNS)
    + " FROM rets GROUP BY day, inst", "bars", ordered=_ORDERED, rets=_RET))
def _(t):
    out = B.intraday_features(t.bars(), chunk_minutes=t.bar_chunk_minutes())
    return out.select(day("day"), "inst", *[rnd(c) for c in B.INTRADAY_COLUMNS])


# --- A26-A34 -------------------------------------------------------------------------
@query("a26_daily_bar", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low,
 round(close, 9) AS close, volume, amount, open_interest FROM daily""", "daily"))
def _(t):
    return t.daily().select("inst", day(), *[rnd(c, 9) for c in ("open", "high", "low", "close")], "volume", "amount", "open_interest")


def tick_chunk(t: Tables, ticks: DataFrame) -> tuple[DataFrame, str | None]:
    """Cut hot (inst, dt) groups along the first order column."""
    from tapeloom.scale import group_limit

    top, limit = t.size("lineitem", "l_suppkey", "l_shipdate"), group_limit(t.spark)
    if top <= limit:
        return ticks, None
    width = max(1, t.size("orders") * limit // top)
    return ticks.withColumn("_chunk", F.floor(F.col(BAR_ORDER[0]) / F.lit(width))), "_chunk"


@query("a27_roll_count", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, CAST(sum(CASE WHEN rn > 1 AND dominant_id <> prev THEN 1 ELSE 0 END) AS BIGINT) AS roll_count
 FROM (SELECT *, lag(dominant_id) OVER (PARTITION BY inst, dt ORDER BY rn) AS prev FROM ticks) GROUP BY inst, dt""", "ticks"))
def _(t):
    ticks, chunk = tick_chunk(t, t.ticks())
    return B.roll_counts(ticks, ["inst", "dt"], BAR_ORDER, "dominant_id", chunk).select("inst", day(), "roll_count")


@query("a28_roll_flag", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, CASE WHEN lag(dominant_id) OVER w IS NULL THEN 0 WHEN dominant_id <> lag(dominant_id) OVER w THEN 1 ELSE 0 END AS roll_flag
 FROM daily WINDOW w AS (PARTITION BY inst ORDER BY dt)""", "daily"))
def _(t):
    return B.roll_flags(t.daily()).select("inst", day(), "roll_flag")


_MULT = "SELECT d.*, coalesce(contract_multiplier, 1.0) AS mult FROM daily d LEFT JOIN multiplier USING (inst)"


@query("a29_futures_vwap", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round(CASE WHEN volume > 0 THEN amount / (volume * mult + 1e-12) END, 6) AS vwap FROM m",
    "daily", "multiplier", m=_MULT))
def _(t):
    rows = B.with_multiplier(t.daily().select("inst", "dt", "volume", "amount"), t.multiplier())
    return rows.select("inst", day(), F.round(
        B.futures_vwap(F.col("amount"), F.col("volume"), F.col("contract_multiplier")), 6).alias("vwap"))


@query("a30_contract_multiplier", with_frames(
    """SELECT s_name AS inst, CASE WHEN v > 0 THEN v ELSE 1.0::DOUBLE END AS contract_multiplier FROM supplier LEFT JOIN
 (SELECT upper(c_name) AS c_name, c_acctbal AS v FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS c_name, c_acctbal,
 row_number() OVER (PARTITION BY upper(c_name) ORDER BY c_custkey DESC) AS rn FROM customer) WHERE rn = 1) ON upper(s_name) = c_name"""))
def _(t):
    info = t.read("customer").select(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")).alias("key"),
                                     F.col("c_acctbal").alias("contract_multiplier"), "c_custkey")
    table = B.multiplier_table(info, "key", "contract_multiplier", ["c_custkey"])
    names = t.read("supplier").select(F.col("s_name").alias("inst"), F.upper("s_name").alias("key"))
    return B.with_multiplier(names, table, "key").select("inst", "contract_multiplier")


_BASE = """SELECT inst, CASE WHEN count(*) >= 30 THEN median(close) ELSE min(close) FILTER (n = 1) END AS base FROM
 (SELECT inst, close, row_number() OVER (PARTITION BY inst ORDER BY dt) AS n FROM daily WHERE close > 0) WHERE n <= 30 GROUP BY inst"""


@query("a31_base_close", with_frames("SELECT inst, round(base, 6) AS base_close FROM b", "daily", b=_BASE))
def _(t):
    return B.base_close(t.daily()).select("inst", rnd("base_close"))


@query("a32_trade_calendar", with_frames("SELECT CAST(dt AS VARCHAR) AS dt, idx FROM calendar", "calendar"))
def _(t):
    return t.calendar().select(day(), "idx")


@query("a33_industry_spans", with_frames(
    """SELECT inst, industry, CAST(min(dt) AS VARCHAR) AS start_date, CAST(max(dt) AS VARCHAR) AS end_date
 FROM keys JOIN industry USING (inst) GROUP BY inst, industry""", "keys", "industry"))
def _(t):
    # spans first: one row per instrument meets the industry table
    own = spans.min_max_spans(t.ticks(), ["inst"]).join(t.industry(), "inst")
    return own.select("inst", "industry", day("start_date"), day("end_date"))


_MONTHS = """SELECT DISTINCT inst, CAST(date_trunc('week', dt) AS DATE) AS dt FROM ticks"""


@query("a34_unbroken_spans", with_frames(
    """SELECT inst, CAST(min(dt) AS VARCHAR) AS start_date, CAST(max(dt) AS VARCHAR) AS end_date FROM
 (SELECT *, idx - row_number() OVER (PARTITION BY inst ORDER BY dt) AS island FROM weeks JOIN
 (SELECT dt, row_number() OVER (ORDER BY dt) AS idx FROM (SELECT DISTINCT dt FROM weeks)) USING (dt)) GROUP BY inst, island""",
    "ticks", weeks=_MONTHS))
def _(t):
    weeks = t.ticks().select("inst", F.to_date(F.date_trunc("week", "dt")).alias("dt"))
    return spans.unbroken_spans(weeks, ["inst"]).select("inst", day("start_date"), day("end_date"))


# --- J10, J14, X09-X11 ---------------------------------------------------------------
_ALIGNED = """SELECT s.inst, c.dt, d.close, d.volume FROM (SELECT inst, min(dt) AS a, max(dt) AS b FROM daily GROUP BY inst) s
 JOIN calendar c ON c.dt BETWEEN s.a AND s.b LEFT JOIN daily d ON d.inst = s.inst AND d.dt = c.dt"""


@query("j10_calendar_alignment", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round(close, 9) AS close, volume FROM al", "daily", "calendar", al=_ALIGNED))
def _(t):
    return C.align(t.daily().select("inst", "dt", "close", "volume"), t.calendar()).select("inst", day(), rnd("close", 9), "volume")


@query("j14_day_over_day", with_frames(
    """SELECT coalesce(a.inst, b.inst) AS inst, CAST(c.dt AS VARCHAR) AS dt,
 CASE WHEN a.inst IS NULL THEN 'exit' WHEN b.inst IS NULL THEN 'enter' ELSE 'hold' END AS state
 FROM keys a FULL JOIN (SELECT inst, day_idx + 1 AS day_idx FROM keys) b ON a.inst = b.inst AND a.day_idx = b.day_idx
 JOIN calendar c ON c.idx = coalesce(a.day_idx, b.day_idx)""", "keys"))
def _(t):
    return spans.day_over_day(t.ticks(), ["inst"], t.calendar()).select("inst", day(), "state")


_FILL = """SELECT inst, dt, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(close IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e-12) AS close FROM al"""


@query("x09_fill_both_ways", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round(close, 9) AS close FROM f",
    "daily", "calendar", al=_ALIGNED.replace("d.close,", "CASE WHEN d.num_trades > 1 THEN d.close END AS close,"), f=_FILL))
def _(t):
    gaps = t.daily().select("inst", "dt", F.when(F.col("num_trades") > 1, F.col("close")).alias("close"))
    rows = C.align(gaps, t.calendar())
    return clean.fill_both_ways(rows, ["close"], default=B.EPS).select("inst", day(), rnd("close", 9))


@query("x10_fill_one_zero", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, coalesce(CASE WHEN num_trades > 1 THEN 2.0::DOUBLE END, 1.0) AS factor,
 coalesce(CASE WHEN num_trades > 1 THEN CAST(num_trades AS BIGINT) END, 0) AS roll_count FROM daily""", "daily"))
def _(t):
    gaps = t.daily().select("inst", "dt", F.when(F.col("num_trades") > 1, 2.0).alias("factor"),
                            F.when(F.col("num_trades") > 1, F.col("num_trades")).alias("roll_count"))
    return gaps.fillna(1.0, ["factor"]).fillna(0, ["roll_count"]).select("inst", day(), "factor", "roll_count")


@query("x11_base_price_scaling", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, round(v_open, 6) AS open, round(v_close, 6) AS close, round(v_volume, 6) AS volume, round(v_adj, 9) AS adjclose FROM (
 SELECT inst, dt, """ + ", ".join(
        f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value({c} IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e-12) AS v_{c}"""
        for c in ("open", "close", "volume", "adj")) + """ FROM (
 SELECT s.inst, c.dt, CASE WHEN open > 0 THEN open / (base + 1e-12) END AS open, CASE WHEN close > 0 THEN close / (base + 1e-12) END AS close,
 volume * base * mult AS volume, close AS adj
 FROM (SELECT inst, min(dt) AS a, max(dt) AS b FROM daily GROUP BY inst) s JOIN calendar c ON c.dt BETWEEN s.a AND s.b
 LEFT JOIN (SELECT m.*, base FROM m JOIN b USING (inst)) d ON d.inst = s.inst AND d.dt = c.dt))""",
    "daily", "calendar", "multiplier", m=_MULT, b=_BASE))
def _(t):
    panel = t.daily().select("inst", "dt", "open", "high", "low", "close", "volume", "amount", "open_interest")
    out = B.normalize_panel(panel, t.calendar(), t.multiplier())
    return out.select("inst", day(), rnd("open"), rnd("close"), rnd("volume"), rnd("adjclose", 9))
