"""Queries for the rolling operators (W01-W19) and the feature families (F01-F22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import features as X
from tapeloom.functions import rolling as W
from tapeloom.functions.batches import means
from tapeloom.operators import bars as B
from tapeloom.operators import selection
from tapeloom.plans.bar_queries import INTRADAY_SQL, _ORDERED, _RET, day
from tapeloom.plans.frames import with_frames
from tapeloom.plans.registry import query

W5 = "(w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def over(d: int) -> str:
    return f"OVER (w ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


_T = """SELECT *, CAST(row_number() OVER w AS DOUBLE) AS t, lag(close) OVER w AS c1, lag(volume) OVER w AS v1, lag(open_interest) OVER w AS oi1,
 lag(turn) OVER w AS turn1 FROM daily_plus WINDOW w AS (PARTITION BY inst ORDER BY dt)"""
_P = """SELECT *, close / c1 AS rel, close / c1 - 1 AS ret, ln(volume + 1) AS lv, ln(volume / v1 + 1) AS lrv,
 CASE WHEN close > c1 THEN 1.0::DOUBLE ELSE 0.0 END AS up, CASE WHEN close < c1 THEN 1.0::DOUBLE ELSE 0.0 END AS down,
 CASE WHEN close > c1 THEN close - c1 WHEN c1 IS NOT NULL THEN 0.0 END AS gain, CASE WHEN close < c1 THEN c1 - close WHEN c1 IS NOT NULL THEN 0.0 END AS loss,
 abs(close - c1) AS move, CASE WHEN volume > v1 THEN volume - v1 WHEN v1 IS NOT NULL THEN 0.0 END AS vgain,
 CASE WHEN volume < v1 THEN v1 - volume WHEN v1 IS NOT NULL THEN 0.0 END AS vloss, abs(volume - v1) AS vmove,
 abs(close / c1 - 1) * volume AS retvol, abs(close / c1 - 1) / (amount + 1e-12) AS illiq, ln(open_interest + 1) AS loi,
 ln(open_interest / oi1 + 1) AS lroi, turn / (turn1 + 1e-12) - 1 AS dturn, ln(pe_ttm + 1e-12) AS log_pe_ttm, ln(pb + 1e-12) AS log_pb,
 1.0 / (pe_ttm + 1e-12) AS inv_pe_ttm, 1.0 / (pb + 1e-12) AS inv_pb, (buy_volume * 2 - volume) / (volume + 1e-12) AS flow_volume,
 (buy_amount * 2 - amount) * 10000 / (market_cap + 1e-12) AS flow_amount,
 volume * 10000 / (num_trades + 1e-12) / (market_cap / (close + 1e-12)) AS trade_size FROM tt"""
WIN = "WINDOW w AS (PARTITION BY inst ORDER BY dt)"


def pframes(body: str, **extra: str) -> str:
    return with_frames(body, "daily_plus", tt=_T, p=_P, **extra)


def corr_sql(x: str, y: str, d: int) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    xs, ys = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    o = over(d)
    return f"CASE WHEN max({xs}) {o} > min({xs}) {o} AND max({ys}) {o} > min({ys}) {o} THEN corr({x}, {y}) {o} END"


def fit_sql(fn: str, x: str, d: int) -> str:
    return f"CASE WHEN count({x}) {over(d)} >= 2 THEN {fn}({x}, t) {over(d)} END"


def resi_sql(x: str, d: int) -> str:
    o = over(d)
    return f"CASE WHEN count({x}) {o} >= 2 THEN {x} - (regr_slope({x}, t) {o} * t + regr_intercept({x}, t) {o}) END"


def rank_sql(x: str, d: int) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (len(list_filter(list({x}) {over(d)}, lambda v: v < {x})) + (len(list_filter(list({x}) {over(d)}, lambda v: v = {x})) + 1) / 2.0)"
            f" / len(list_filter(list({x}) {over(d)}, lambda v: v IS NOT NULL)) END")


def idx_sql(x: str, d: int) -> str:
    """1-based place of the highest x, earliest on ties. Window values are exact, so equality works."""
    o = over(d)
    return f"CAST(list_position(list({x}) {o}, max({x}) {o}) AS DOUBLE)"


def prepared(t) -> DataFrame:
    return X.prepare(t.daily_plus())


def one(name: str, column, sql: str, digits: int = 6, need_t: bool = False):
    """A per-row rolling query: ``column`` is built lazily, ``sql`` reads frame ``p``."""

    def run(t):
        out = prepared(t).select("inst", "dt", column().alias("v"))
        return out.select("inst", day(), F.round("v", digits).alias("v"))

    body = f"SELECT inst, CAST(dt AS VARCHAR) AS dt, round(v, {digits}) AS v FROM (SELECT inst, dt, {sql} AS v FROM p {WIN})"
    query(name, pframes(body))(run)


one("w01_ref_back", lambda: W.ref("close", 5), "lag(close, 5) OVER w", 9)
one("w02_ref_ahead_label", lambda: X.label("adjclose"), "lead(adjclose, 5) OVER w / lead(adjclose, 1) OVER w - 1")
one("w03_mean", lambda: W.mean("close", 5), f"avg(close) {over(5)}")
one("w03_mean_of_condition", lambda: W.mean("_up", 10), f"avg(up) {over(10)}")
one("w04_std", lambda: W.std("close", 5), f"stddev_samp(close) {over(5)}", 5)
one("w05_sum", lambda: W.total("_gain", 10), f"sum(gain) {over(10)}", 5)
one("w06_max", lambda: W.highest("high", 20), f"max(high) {over(20)}", 9)
one("w06_min", lambda: W.lowest("low", 20), f"min(low) {over(20)}", 9)
one("w07_quantile", lambda: W.quantile("close", 20, 0.8), f"quantile_cont(close, 0.8) {over(20)}")
one("w08_rank", lambda: W.rank("volume", 10), rank_sql("volume", 10))
one("w09_idx_max", lambda: W.idx_max("high", 20, "_t"), idx_sql("high", 20))
one("w09_idx_min", lambda: W.idx_min("volume", 20, "_t"), idx_sql("-volume", 20))
one("w10_slope", lambda: W.slope("close", 10, "_t"), fit_sql("regr_slope", "close", 10))
one("w11_rsquare", lambda: W.rsquare("close", 10, "_t"), fit_sql("regr_r2", "close", 10))
one("w12_resi", lambda: W.resi("close", 10, "_t") / F.col("close"), resi_sql("close", 10) + " / close")
one("w13_corr", lambda: W.corr("_rel", "_lrv", 10), corr_sql("rel", "lrv", 10))
one("w14_greater", lambda: W.greater("open", "_c1"), "CASE WHEN c1 IS NOT NULL THEN greatest(open, c1) END", 9)
one("w14_less", lambda: W.less("open", "_c1"), "CASE WHEN c1 IS NOT NULL THEN least(open, c1) END", 9)
one("w15_log_abs_arithmetic", lambda: F.ln(F.abs(F.col("close") - F.col("_c1")) + 1) / (F.col("volume") + 1e-12) * W.is_true(F.col("close") > F.col("open")),
    "ln(abs(close - c1) + 1) / (volume + 1e-12) * CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0.0 END")
one("w19_scaled_label", lambda: X.scaled_label(None), f"(lead(adjclose, 5) OVER w / lead(adjclose, 1) OVER w - 1) / (1 + stddev_samp(ret) {over(5)})")

_IDX = """SELECT dt, close / lag(close) OVER (ORDER BY dt) - 1 AS m_ret, volume AS mv FROM index_bars"""


@query("w16_mask", with_frames("SELECT inst, CAST(dt AS VARCHAR) AS dt, round(m_ret, 6) AS v FROM daily JOIN m USING (dt)", "daily", "index_bars", m=_IDX))
def _(t):
    market = X.market_block(t.index(), "IDX", windows=()).select("dt", F.col("IDX_RET").alias("v"))
    return X.mask(t.ticks().select("inst", "dt").distinct(), market).select("inst", day(), F.round("v", 6).alias("v"))


@query("w17_group_mean", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round(close / avg(close) OVER (PARTITION BY dt, industry), 6) AS v FROM daily JOIN industry USING (inst)",
    "daily", "industry"))
def _(t):
    rows = t.daily().select("inst", "dt", "close").join(t.industry(), "inst")
    return X.group_mean(rows, "close", "v", ["dt", "industry"]).select("inst", day(), F.round(F.col("close") / F.col("v"), 6).alias("v"))


# --- families ------------------------------------------------------------------------
def family_sql(exprs: dict[str, str], digits: int, summary: bool, **extra: str) -> str:
    src = extra.pop("src", "p")
    inner = f"SELECT inst, dt, " + ", ".join(f'{e} AS "{n}"' for n, e in exprs.items()) + f" FROM {src} {WIN}"
    if summary:
        cols = ", ".join(f'round(avg("{n}"), {digits}) AS "{n}", count("{n}") AS "n_{n}"' for n in exprs)
        return pframes(f"SELECT inst, {cols} FROM ({inner}) GROUP BY inst", **extra)
    cols = ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in exprs)
    return pframes(f"SELECT inst, CAST(dt AS VARCHAR) AS dt, {cols} FROM ({inner})", **extra)


def finish(df: DataFrame, names, digits: int, summary: bool) -> DataFrame:
    """Every row, or for the wide families the mean and count of each feature per instrument."""
    if summary:
        out = means(df, ["inst"], list(names))
        return out.select("inst", *[c for n in names for c in (F.round(n, digits).alias(n), f"n_{n}")])
    return df.select("inst", day(), *[F.round(n, digits).alias(n) for n in names])


def family(name: str, make, exprs: dict[str, str], digits: int = 6, summary: bool = False, **extra: str) -> None:
    def run(t):
        s = X.Stage()
        out = X.build(prepared(t), make(s), s)
        return finish(out, list(exprs), digits, summary)

    query(name, family_sql(exprs, digits, summary, **extra))(run)


KBAR_SQL = {
    "KBAR_RET": "(close - open) / open", "KBAR_RANGE": "(high - low) / open", "KBAR_BODY_RATIO": "(close - open) / (high - low + 1e-12)",
    "KBAR_UPPER_SHADOW": "(high - greatest(open, close)) / open", "KBAR_UPPER_SHADOW_RATIO": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KBAR_LOWER_SHADOW": "(least(open, close) - low) / open", "KBAR_LOWER_SHADOW_RATIO": "(least(open, close) - low) / (high - low + 1e-12)",
    "KBAR_CLV": "(2 * close - high - low) / open", "KBAR_CLV_RATIO": "(2 * close - high - low) / (high - low + 1e-12)"}
family("f01_kbar", X.kbar, KBAR_SQL)
family("f02_price_and_size", X.price_and_size, {
    "OPEN": "open / close", "HIGH": "high / close", "LOW": "low / close", "VWAP": "vwap / close", "LOG_VOLUME": "ln(volume + 1)", "LOG_AMOUNT": "ln(amount + 1)"})


def rolling_close_sql(windows) -> dict[str, str]:
    out = {}
    for d in windows:
        o = over(d)
        out |= {
            f"ROC_{d}": f"lag(close, {d}) OVER w / close", f"MA_{d}": f"avg(close) {o} / close", f"STD_{d}": f"stddev_samp(close) {o} / close",
            f"BETA_{d}": fit_sql("regr_slope", "close", d) + " / close", f"RSQR_{d}": fit_sql("regr_r2", "close", d),
            f"RESI_{d}": resi_sql("close", d) + " / close", f"RANK_{d}": rank_sql("close", d), f"CORR_{d}": corr_sql("close", "lv", d),
            f"CORD_{d}": corr_sql("rel", "lrv", d), f"CNTP_{d}": f"avg(up) {o}", f"CNTN_{d}": f"avg(down) {o}", f"CNTD_{d}": f"avg(up) {o} - avg(down) {o}",
            f"SUMP_{d}": f"sum(gain) {o} / (sum(move) {o} + 1e-12)", f"SUMN_{d}": f"sum(loss) {o} / (sum(move) {o} + 1e-12)",
            f"SUMD_{d}": f"(sum(gain) {o} - sum(loss) {o}) / (sum(move) {o} + 1e-12)",
            f"VMA_{d}": f"avg(volume) {o} / (volume + 1e-12)", f"VSTD_{d}": f"stddev_samp(volume) {o} / (volume + 1e-12)"}
    return out


family("f03_rolling_close", X.rolling_close, rolling_close_sql(X.WINDOWS), summary=True)
CHANNEL_SQL = {k: v for d in (20, 30, 60) for k, v in {
    f"MAX_{d}": f"max(high) {over(d)} / close", f"MIN_{d}": f"min(low) {over(d)} / close", f"QTLU_{d}": f"quantile_cont(close, 0.8) {over(d)} / close",
    f"QTLD_{d}": f"quantile_cont(close, 0.2) {over(d)} / close", f"IMAX_{d}": f"{idx_sql('high', d)} / {d}", f"IMIN_{d}": f"{idx_sql('-low', d)} / {d}",
    f"IMXD_{d}": f"({idx_sql('high', d)} - {idx_sql('-low', d)}) / {d}"}.items()}
family("f04_channel", X.channel, CHANNEL_SQL, summary=True)
RSV_SQL = {f"RSV_{d}": f"(close - min(low) {over(d)}) / (max(high) {over(d)} - min(low) {over(d)} + 1e-12)" for d in (10, 20, 30)}
family("f05_rsv", X.rsv, RSV_SQL)
family("f06_open_interest", X.open_interest, {"OI_LOG": "ln(open_interest + 1)", "OI_CHG1": "open_interest / (oi1 + 1e-12) - 1"} | {
    k: v for d in X.WINDOWS for k, v in {f"OI_LOG_MA_{d}": f"avg(loi) {over(d)}", f"OI_LOG_STD_{d}": f"stddev_samp(loi) {over(d)}",
                                         f"OI_CORD_{d}": corr_sql("rel", "lroi", d)}.items()}, summary=True)
family("f07_roll", X.roll, {"ROLL_FLAG": "roll_flag", "ROLL_COUNT": "roll_count"} | {
    k: v for d in X.WINDOWS for k, v in {f"ROLL_FLAG_MEAN_{d}": f"avg(roll_flag) {over(d)}", f"ROLL_FLAG_SUM_{d}": f"sum(roll_flag) {over(d)}",
                                         f"ROLL_COUNT_MEAN_{d}": f"avg(roll_count) {over(d)}", f"ROLL_COUNT_MAX_{d}": f"max(roll_count) {over(d)}"}.items()}, summary=True)
family("f08_gates", X.gates, {
    "GATE_LOG_VOLUME": "ln(volume + 1)", "GATE_LOG_AMOUNT": "ln(amount + 1)", "GATE_OI_LOG": "ln(open_interest + 1)", "GATE_OI_CHG1": "open_interest / (oi1 + 1e-12) - 1",
    "GATE_ROLL_FLAG": "roll_flag", "GATE_ROLL_COUNT": "roll_count", "GATE_RET1": "ret", "GATE_RET_STD5": f"stddev_samp(ret) {over(5)}"})
family("f10_volume_weighted_move", X.volume_weighted_move, {f"WVMA_{d}": f"stddev_samp(retvol) {over(d)} / (avg(retvol) {over(d)} + 1e-12)" for d in X.WINDOWS})
family("f11_volume_moves", X.volume_moves, {k: v for d in X.WINDOWS for k, v in {
    f"VSUMP_{d}": f"sum(vgain) {over(d)} / (sum(vmove) {over(d)} + 1e-12)", f"VSUMN_{d}": f"sum(vloss) {over(d)} / (sum(vmove) {over(d)} + 1e-12)",
    f"VSUMD_{d}": f"(sum(vgain) {over(d)} - sum(vloss) {over(d)}) / (sum(vmove) {over(d)} + 1e-12)"}.items()}, summary=True)
_LAGGED = ("CLOSE", "OPEN", "HIGH", "LOW", "VWAP", "VOLUME")


@query("f12_lag_block", with_frames(
    """SELECT a.inst, lag, count(*) AS n, """ + ", ".join(
        f"round(avg(b.{f.lower()} / " + ("(a.volume + 1e-12)" if f == "VOLUME" else "a.close") + f'), 6) AS "{f}"' for f in _LAGGED)
    + """ FROM (SELECT *, unnest(range(60)) AS lag FROM r) a JOIN r b ON a.inst = b.inst AND b.rn = a.rn - a.lag GROUP BY a.inst, lag""",
    "daily_plus", r="SELECT inst, close, open, high, low, vwap, volume, row_number() OVER (PARTITION BY inst ORDER BY dt) AS rn FROM daily_plus"))
def _(t):
    arrays = X.lag_arrays(X.by_instrument(t.daily_plus()))
    long = arrays.select("inst", F.posexplode(F.arrays_zip(*[f"{f}_LAGS" for f in _LAGGED])).alias("lag", "v"))
    return long.groupBy("inst", "lag").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col("v")[f"{f}_LAGS"]), 6).alias(f) for f in _LAGGED])


family("f13_turnover", X.turnover, {k: v for d in X.WINDOWS for k, v in {f"TO_MEAN_{d}d": f"avg(turn) {over(d)}", f"TO_STD_{d}d": f"stddev_samp(turn) {over(d)}"}.items()} | {
    k: v for b in (20, 60) for d in X.WINDOWS for k, v in {
        f"TO_REL_{d}d_over_{b}d": f"avg(turn) {over(d)} / (avg(turn) {over(b)} + 1e-12)",
        f"TO_ZSCORE_{d}d_over_{b}d": f"(avg(turn) {over(d)} - avg(turn) {over(b)}) / (stddev_samp(turn) {over(b)} + 1e-12)"}.items()} | {
    f"TO_CHG_RATE_over_{b}d": f"turn / (avg(turn) {over(b)} + 1e-12) - 1" for b in (20, 60)} | {
    "TO_DELTA_1d": "dturn", "TO_DELTA_MEAN_5d": f"avg(dturn) {over(5)}"}, digits=4, summary=True)


def related_sql(name: str, x: str) -> dict[str, str]:
    m20, m60 = f"avg({x}) {over(20)}", f"avg({x}) {over(60)}"
    return {f"{name}_MEAN_20d": m20, f"{name}_STD_20d": f"stddev_samp({x}) {over(20)}", f"{name}_MEAN_60d": m60, f"{name}_STD_60d": f"stddev_samp({x}) {over(60)}",
            f"{name}_REL_20d_over_60d": f"{m20} / ({m60} + 1e-12)", f"{name}_ZSCORE_20d_over_60d": f"({m20} - {m60}) / (stddev_samp({x}) {over(60)} + 1e-12)",
            f"{name}_CHG_RATE_over_60d": f"{x} / ({m60} + 1e-12) - 1"}


family("f14_valuation", X.valuation, related_sql("LOG_PE_TTM", "log_pe_ttm") | related_sql("LOG_PB", "log_pb") | related_sql("EP", "inv_pe_ttm")
       | related_sql("BM", "inv_pb") | {
    "EP_MKT_REL_60": f"inv_pe_ttm / (avg(inv_pe_ttm) {over(60)} + 1e-12)",
    "EXPN_MOM_RISK_MKT": f"(log_pe_ttm - avg(log_pe_ttm) {over(60)}) * least(avg(ret) {over(5)}, 0.0)"}, digits=5, summary=True)
# an unknown momentum must not turn into 0: the SQL twin's least() would skip it, so the first row is null on both sides
family("f15_turnover_momentum", X.turnover_momentum, {
    "LOCK_MOM_5": f"avg(ret) {over(5)} * (1 - {rank_sql('turn', 20)})", "DELTA_TO_MOM_5": f"dturn * avg(ret) {over(5)}"})


@query("f09_market_block", with_frames(
    "SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS names, " + ", ".join(
        f'round(max({e}), 8) AS "{n}"' for n, e in ({"IDX_RET": "r0"} | {
            k: v for d in X.WINDOWS for k, v in {f"IDX_RET_MEAN_{d}": f"rm{d}", f"IDX_RET_STD_{d}": f"rs{d}", f"IDX_VOL_MEAN_{d}": f"ln(vm{d})", f"IDX_VOL_STD_{d}": f"vs{d}"}.items()}).items())
    + " FROM daily JOIN m USING (dt) GROUP BY dt", "daily", "index_bars", m0=_IDX,
    m="SELECT dt, m_ret AS r0, " + ", ".join(
        f"avg(m_ret) {o} AS rm{d}, stddev_samp(m_ret) {o} AS rs{d}, avg(mv) {o} / mv AS vm{d}, stddev_samp(mv) {o} / mv AS vs{d}"
        for d in X.WINDOWS for o in [over(d)]) + " FROM m0 WINDOW w AS (ORDER BY dt)"))
def _(t):
    rows = X.mask(t.ticks().select("inst", "dt").distinct(), X.market_block(t.index(), "IDX"))
    names = [c for c in rows.columns if c.startswith("IDX")]
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("names"), *[F.round(F.max(F.ln(c) if "VOL_MEAN" in c else c), 8).alias(c) for c in names]).select(day(), "names", *names)


@query("f16_illiquidity", family_sql(
    {"AMIH_5": "AMIH_5 * 1e6", "AMIH_20": "AMIH_20 * 1e6", "IMPACT_PENALTY_5": rank_sql("AMIH_5", 20), "IMPACT_PENALTY_20": rank_sql("AMIH_20", 60)}, 6, True,
    src="q", q=f"SELECT inst, dt, avg(illiq) {over(5)} AS AMIH_5, avg(illiq) {over(20)} AS AMIH_20 FROM p {WIN}"))
def _(t):
    s = X.Stage()
    df, fam = X.illiquidity(s, prepared(t))
    out = X.build(df, fam, s).withColumns({"AMIH_5": F.col("AMIH_5") * 1e6, "AMIH_20": F.col("AMIH_20") * 1e6})
    return finish(out, list(fam), 6, True)


@query("f17_industry_relative", family_sql(
    {"TO_IND_Q": "turn / (g1 + 1e-12)", "EP_IND": "inv_pe_ttm / (g2 + 1e-12)", "EXPN_MOM_RISK": "(log_pe_ttm - g3) * CASE WHEN mom5 < 0 THEN mom5 ELSE 0.0 END"}, 6, True, src="g",
    q=f"SELECT *, avg(turn) {over(20)} AS to20, avg(inv_pe_ttm) {over(60)} AS ep60, avg(log_pe_ttm) {over(60)} AS lpe60, avg(ret) {over(5)} AS mom5 FROM p {WIN}",
    ind="SELECT s_suppkey AS inst, n_nationkey AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    g="SELECT *, avg(to20) OVER i AS g1, avg(ep60) OVER i AS g2, avg(lpe60) OVER i AS g3 FROM q JOIN ind USING (inst) WINDOW i AS (PARTITION BY dt, industry)"))
def _(t):
    s = X.Stage()
    df, fam = X.industry_relative(s, prepared(t).join(t.industry(), "inst"))
    return finish(X.build(df, fam, s), list(fam), 6, True)


def rollup_sql(c: str, d: int, forms) -> dict[str, str]:
    now = f"nullif({c} + 1e-12, 0.0)"
    o = over(d)
    up, down = f"avg(CASE WHEN {c} > {c}_1 THEN 1.0::DOUBLE ELSE 0.0 END) {o}", f"avg(CASE WHEN {c} < {c}_1 THEN 1.0::DOUBLE ELSE 0.0 END) {o}"
    made = {"mean": f"avg({c}) {o} / {now}", "std": f"stddev_samp({c}) {o} / {now}", "slope": fit_sql("regr_slope", c, d) + f" / {now}",
            "rsquare": fit_sql("regr_r2", c, d), "resi": resi_sql(c, d) + f" / {now}", "ref": f"lag({c}, {d}) OVER w / {now}", "rank": rank_sql(c, d),
            "qtlu": f"quantile_cont({c}, 0.8) {o} / {now}", "qtld": f"quantile_cont({c}, 0.2) {o} / {now}", "cntp": up, "cntn": down, "cntd": f"{up} - {down}"}
    return {f"{f}_{c}_{d}": made[f] for f in forms}


_FLOW_FORMS = ["mean", "std", "slope", "ref", "rank", "cntp", "cntn", "cntd"]


@query("f18_order_flow", family_sql(
    {"FLOW_VOLUME": "flow_volume", "FLOW_AMOUNT": "flow_amount", "TRADE_SIZE": "trade_size"} | rollup_sql("trade_size", 11, _FLOW_FORMS), 4, True, src="q",
    q=f"SELECT *, lag(trade_size) OVER w AS trade_size_1 FROM p {WIN}"))
def _(t):
    s = X.Stage()
    df, fam = X.rollup(s, prepared(t), ["trade_size"], [11], _FLOW_FORMS)
    fam = X.order_flow(s) | fam
    return finish(X.build(df, fam, s), list(fam), 4, True)


_DCOLS = ["d_vol", "d_hhi", "d_cntp", "d_vol_cv"]
_DFORMS = ["mean", "std", "slope", "ref", "rank", "qtld", "cntp"]


@query("f19_intraday_rollups", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, " + ", ".join(f'round({e}, 5) AS "{n}"' for c in _DCOLS for n, e in rollup_sql(c, 5, _DFORMS).items())
    + f" FROM q {WIN}", "bars", ordered=_ORDERED, rets=_RET,
    feats="SELECT inst, day AS dt, " + ", ".join(f"{INTRADAY_SQL[c]} AS {c}" for c in _DCOLS) + " FROM rets GROUP BY inst, day",
    q="SELECT *, CAST(row_number() OVER w AS DOUBLE) AS t, " + ", ".join(f"lag({c}) OVER w AS {c}_1" for c in _DCOLS) + f" FROM feats {WIN}"))
def _(t):
    feats = B.intraday_features(t.bars(), chunk_minutes=t.bar_chunk_minutes(), columns=_DCOLS).withColumnRenamed("day", "dt")
    s = X.Stage()
    df, fam = X.rollup(s, feats.withColumn("_t", W.position()), _DCOLS, [5], _DFORMS)
    return finish(X.build(df, fam, s), list(fam), 5, False)


@query("f20_fundamental_pass_through", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round(pe_ttm, 9) AS pe_ttm, round(pb / 2, 9) AS pb_ratio_lf, round(close / 3, 9) AS eps_lyr FROM daily_plus", "daily_plus"))
def _(t):
    wide = t.daily_plus().withColumns({"pb_ratio_lf": F.col("pb") / 2, "eps_lyr": F.col("close") / 3})
    return wide.select("inst", day(), *[F.round(c, 9).alias(c) for c in X.fundamental_columns(wide)])




@query("f22_valuation_over_volume", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round(ln(pb / volume), 8) AS pb_log, round(ln(pe_ttm / volume), 8) AS pe_log FROM daily_plus", "daily_plus"))
def _(t):
    out = X.build(t.daily_plus(), X.valuation_over_volume(X.Stage()))
    return out.select("inst", day(), F.round(F.ln("PB_OVER_VOLUME"), 8).alias("pb_log"), F.round(F.ln("PE_OVER_VOLUME"), 8).alias("pe_log"))



@query("f00_futures_set", None)
def _(t):
    """All 163 futures features in one pass, summarised per instrument."""
    s = X.Stage()
    fam = X.futures_set(s)
    return finish(X.build(prepared(t), fam, s), list(fam), 6, True)


# all pairs of 33 features: more than one aggregate is made for
_WIDE = KBAR_SQL | CHANNEL_SQL | RSV_SQL
_WIDE_PAIRS = " UNION ALL ".join(f"""SELECT '{a}' AS f1, '{b}' AS f2, corr("{a}", "{b}") AS corr FROM wide""" for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE) if i < j)


@query("d01_wide_correlations", pframes(
    "SELECT f1, f2, round(corr, 6) AS corr FROM pr", wide="SELECT inst, dt, " + ", ".join(f'{e} AS "{n}"' for n, e in _WIDE.items()) + f" FROM p {WIN}", pr=_WIDE_PAIRS))
def _(t):
    s = X.Stage()
    made = X.kbar(s) | X.channel(s) | X.rsv(s)
    pairs = selection.pair_correlations(X.build(prepared(t), {n: made[n] for n in _WIDE}, s), list(_WIDE))
    return pairs.select("f1", "f2", F.round("corr", 6).alias("corr"))
