"""Feature families as expression sets over the daily panel.

``prepare`` names the inner expressions once (yesterday's close, up and down moves, log
volume ...), because window expressions do not nest and because a shared column is
cheaper than a repeated expression. Each family then is a plain dictionary from feature
name to column, to be used in one ``select``. Unused inner columns are pruned.

Panel columns used: inst, dt, open, high, low, close, volume, amount, vwap, and per family
open_interest, roll_flag, roll_count, turn, pe_ttm, pb, buy_volume, buy_amount,
market_cap, num_trades.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling as W
from tapeloom.functions.batches import Figures
from tapeloom.functions.stats import ratio

EPS = 1e-12
WINDOWS = (5, 10, 20, 30, 60)
Family = dict[str, Column]


class Stage:
    """Window columns shared by the features of one ``build``.

    ``s(name, column)`` computes a window once under a name; features then are plain
    arithmetic on names. Spark would otherwise evaluate a repeated window each time. Means, deviations, sums, lines,
    correlations, ranks, extremes and quantiles of all windows come from one pass over batches of ordered rows.
    """

    def __init__(self):
        self.columns: Family = {}
        self.figures = Figures()

    def __call__(self, name: str, column: Column) -> Column:
        self.columns.setdefault(name, column)
        return F.col(name)

    def mean(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_mean_{x}_{d}", "mean", x, d)

    def share(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_share_{x}_{d}", "share", x, d)

    def std(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_std_{x}_{d}", "std", x, d)

    def total(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_sum_{x}_{d}", "total", x, d)

    def corr(self, x: str, y: str, d: int) -> Column:
        return self.figures.ask(f"_corr_{x}_{y}_{d}", "corr", x, d, y)

    def highest(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_max_{x}_{d}", "max", x, d)

    def lowest(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_min_{x}_{d}", "min", x, d)

    def highest_at(self, x: str, d: int) -> Column:
        """As ``rolling.idx_max``."""
        return self.figures.ask(f"_at_high_{x}_{d}", "high", x, d)

    def lowest_at(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_at_low_{x}_{d}", "low", x, d)

    def rank(self, x: str, d: int) -> Column:
        return self.figures.ask(f"_rank_{x}_{d}", "rank", x, d)

    def quantile(self, x: str, d: int, q: float) -> Column:
        """Of finite values, linear between neighbours."""
        return self.figures.ask(f"_q{q}_{x}_{d}", "quantile", x, d, q)

    def line(self, x: str, d: int) -> Family:
        """Slope, R2 and last residual of the least-squares line, from shared moments."""
        return {k: self.figures.ask(f"_{k}_{x}_{d}", "line", x, d, k) for k in ("slope", "rsquare", "resi")}

    def ref(self, x: str, d: int) -> Column:
        """As ``rolling.ref``, of a number."""
        return self.figures.ask(f"_lag_{x}_{d}", "lag", x, d)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with every column asked for."""
        return self.figures.add(df.withColumns(self.columns) if self.columns else df)


def by_instrument(df: DataFrame, inst: str = "inst") -> DataFrame:
    """The one exchange of the rolling work, at the session's full partition count.

    Rolling features cost far more time than bytes, so the stage must not be merged into
    few tasks by size; an explicit count keeps the adaptive planner from doing that.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, inst)


def _c(name: str) -> Column:
    return F.col(name)


def prepare(panel: DataFrame) -> DataFrame:
    have = set(panel.columns)
    first: Family = {"_t": W.position(), "_c1": W.ref("close", 1), "_v1": W.ref("volume", 1)}
    if "open_interest" in have:
        first["_oi1"] = W.ref("open_interest", 1)
    if "turn" in have:
        first["_turn1"] = W.ref("turn", 1)
    df = by_instrument(panel).withColumns(first)
    close, volume, c1, v1 = _c("close"), _c("volume"), _c("_c1"), _c("_v1")
    inner: Family = {
        "_rel": ratio(close, c1),
        "_ret": ratio(close, c1) - 1,
        "_lv": W.log1("volume"),
        "_lrv": F.ln(ratio(volume, v1) + 1),
        "_up": W.is_true(close > c1),
        "_down": W.is_true(close < c1),
        "_gain": W.greater(close - c1, F.lit(0.0)),
        "_loss": W.greater(c1 - close, F.lit(0.0)),
        "_move": F.abs(close - c1),
        "_vgain": W.greater(volume - v1, F.lit(0.0)),
        "_vloss": W.greater(v1 - volume, F.lit(0.0)),
        "_vmove": F.abs(volume - v1),
        "_retvol": F.abs(ratio(close, c1) - 1) * volume,
    }
    if "amount" in have:
        inner["_illiq"] = F.abs(ratio(close, c1) - 1) / (_c("amount") + EPS)
    if "open_interest" in have:
        inner["_loi"] = W.log1("open_interest")
        inner["_lroi"] = F.ln(ratio(_c("open_interest"), _c("_oi1")) + 1)
    if "turn" in have:
        inner["_dturn"] = _c("turn") / (_c("_turn1") + EPS) - 1
    for name in ("pe_ttm", "pb"):
        if name in have:
            inner[f"_log_{name}"] = F.ln(F.when(_c(name) + EPS > 0, _c(name) + EPS))
            inner[f"_inv_{name}"] = ratio(F.lit(1.0), _c(name) + EPS)
    if {"buy_volume", "buy_amount", "market_cap", "num_trades"} <= have:
        inner["flow_volume"] = (_c("buy_volume") * 2 - volume) / (volume + EPS)
        inner["flow_amount"] = (_c("buy_amount") * 2 - _c("amount")) * 10000 / (_c("market_cap") + EPS)
        inner["trade_size"] = volume * 10000 / (_c("num_trades") + EPS) / (_c("market_cap") / (close + EPS))
    return df.withColumns(inner)


def kbar(s: Stage) -> Family:
    o, h, lo, c = (_c(x) for x in ("open", "high", "low", "close"))
    span = h - lo + EPS
    top, bottom = h - W.greater("open", "close"), W.less("open", "close") - lo
    mid = 2 * c - h - lo
    return {
        "KBAR_RET": (c - o) / o, "KBAR_RANGE": (h - lo) / o, "KBAR_BODY_RATIO": (c - o) / span,
        "KBAR_UPPER_SHADOW": top / o, "KBAR_UPPER_SHADOW_RATIO": top / span,
        "KBAR_LOWER_SHADOW": bottom / o, "KBAR_LOWER_SHADOW_RATIO": bottom / span,
        "KBAR_CLV": mid / o, "KBAR_CLV_RATIO": mid / span,
    }


def price_and_size(s: Stage) -> Family:
    c = _c("close")
    out = {x.upper(): _c(x) / c for x in ("open", "high", "low", "vwap")}
    return out | {"LOG_VOLUME": W.log1("volume"), "LOG_AMOUNT": W.log1("amount")}


def rolling_close(s: Stage, windows: Iterable[int] = WINDOWS) -> Family:
    c, v = _c("close"), _c("volume") + EPS
    out: Family = {}
    for d in windows:
        up, down, line = s.share("_up", d), s.share("_down", d), s.line("close", d)
        gain, loss, move = s.total("_gain", d), s.total("_loss", d), s.total("_move", d) + EPS
        out |= {
            f"ROC_{d}": s.ref("close", d) / c,
            f"MA_{d}": s.mean("close", d) / c,
            f"STD_{d}": s.std("close", d) / c,
            f"BETA_{d}": line["slope"] / c,
            f"RSQR_{d}": line["rsquare"],
            f"RESI_{d}": line["resi"] / c,
            f"RANK_{d}": s.rank("close", d),
            f"CORR_{d}": s.corr("close", "_lv", d),
            f"CORD_{d}": s.corr("_rel", "_lrv", d),
            f"CNTP_{d}": up, f"CNTN_{d}": down, f"CNTD_{d}": up - down,
            f"SUMP_{d}": gain / move, f"SUMN_{d}": loss / move, f"SUMD_{d}": (gain - loss) / move,
            f"VMA_{d}": s.mean("volume", d) / v, f"VSTD_{d}": s.std("volume", d) / v,
        }
    return out


def channel(s: Stage, windows: Iterable[int] = (20, 30, 60)) -> Family:
    c = _c("close")
    out: Family = {}
    for d in windows:
        at_high, at_low = s.highest_at("high", d), s.lowest_at("low", d)
        out |= {
            f"MAX_{d}": s.highest("high", d) / c, f"MIN_{d}": s.lowest("low", d) / c,
            f"QTLU_{d}": s.quantile("close", d, 0.8) / c, f"QTLD_{d}": s.quantile("close", d, 0.2) / c,
            f"IMAX_{d}": at_high / d, f"IMIN_{d}": at_low / d, f"IMXD_{d}": (at_high - at_low) / d,
        }
    return out


def rsv(s: Stage, windows: Iterable[int] = (10, 20, 30)) -> Family:
    out: Family = {}
    for d in windows:
        lo = s.lowest("low", d)
        out[f"RSV_{d}"] = (_c("close") - lo) / (s.highest("high", d) - lo + EPS)
    return out


def open_interest(s: Stage, windows: Iterable[int] = WINDOWS) -> Family:
    out = {"OI_LOG": W.log1("open_interest"), "OI_CHG1": _c("open_interest") / (_c("_oi1") + EPS) - 1}
    for d in windows:
        out |= {
            f"OI_LOG_MA_{d}": s.mean("_loi", d), f"OI_LOG_STD_{d}": s.std("_loi", d),
            f"OI_CORD_{d}": s.corr("_rel", "_lroi", d),
        }
    return out


def roll(s: Stage, windows: Iterable[int] = WINDOWS) -> Family:
    out = {"ROLL_FLAG": _c("roll_flag"), "ROLL_COUNT": _c("roll_count")}
    for d in windows:
        out |= {
            f"ROLL_FLAG_MEAN_{d}": s.share("roll_flag", d), f"ROLL_FLAG_SUM_{d}": s.total("roll_flag", d),
            f"ROLL_COUNT_MEAN_{d}": s.share("roll_count", d), f"ROLL_COUNT_MAX_{d}": s.highest("roll_count", d),
        }
    return out


def gates(s: Stage) -> Family:
    return {
        "GATE_LOG_VOLUME": W.log1("volume"), "GATE_LOG_AMOUNT": W.log1("amount"), "GATE_OI_LOG": W.log1("open_interest"),
        "GATE_OI_CHG1": _c("open_interest") / (_c("_oi1") + EPS) - 1,
        "GATE_ROLL_FLAG": _c("roll_flag"), "GATE_ROLL_COUNT": _c("roll_count"),
        "GATE_RET1": _c("_ret"), "GATE_RET_STD5": s.std("_ret", 5),
    }


def futures_set(s: Stage) -> Family:
    """The 163 features for continuous contracts."""
    return kbar(s) | price_and_size(s) | rolling_close(s) | channel(s) | rsv(s) | open_interest(s) | roll(s)


def market_block(index: DataFrame, name: str, windows: Iterable[int] = WINDOWS) -> DataFrame:
    """Index return, and rolling mean / deviation of return and of volume over volume, per day.

    ``index`` has (dt, close, volume), one row per day, so its window is small.
    """
    df = prepare(index.withColumn("inst", F.lit(name)))
    v = F.nullif(_c("volume"), F.lit(0.0))
    s = Stage()
    out: Family = {f"{name}_RET": _c("_ret")}
    for d in windows:
        out |= {
            f"{name}_RET_MEAN_{d}": s.mean("_ret", d), f"{name}_RET_STD_{d}": s.std("_ret", d),
            f"{name}_VOL_MEAN_{d}": s.mean("volume", d) / v, f"{name}_VOL_STD_{d}": s.std("volume", d) / v,
        }
    return build(df, out, s, keep=["dt"])


def mask(panel: DataFrame, daily_values: DataFrame, dt: str = "dt") -> DataFrame:
    """Give every instrument the values of another one, by day.

    ``daily_values`` has one row per trade day, so it is broadcast whatever the panel's size.
    """
    return panel.join(F.broadcast(daily_values), dt, "left")


def volume_weighted_move(s: Stage, windows: Iterable[int] = WINDOWS) -> Family:
    return {f"WVMA_{d}": s.std("_retvol", d) / (s.mean("_retvol", d) + EPS) for d in windows}


def volume_moves(s: Stage, windows: Iterable[int] = WINDOWS) -> Family:
    out: Family = {}
    for d in windows:
        gain, loss, move = s.total("_vgain", d), s.total("_vloss", d), s.total("_vmove", d) + EPS
        out |= {f"VSUMP_{d}": gain / move, f"VSUMN_{d}": loss / move, f"VSUMD_{d}": (gain - loss) / move}
    return out


def lag_block(s: Stage, lags: int = 60) -> Family:
    """Six fields at lags ``lags - 1`` .. 0 over today's close (volume over today's volume)."""
    out: Family = {}
    for f in ("close", "open", "high", "low", "vwap", "volume"):
        base = _c("volume") + EPS if f == "volume" else _c("close")
        for i in range(lags - 1, -1, -1):
            out[f"{f.upper()}{i}"] = (W.ref(f, i) if i else _c(f)) / base
    return out


def lag_arrays(panel: DataFrame, lags: int = 60) -> DataFrame:
    """The lag block as one array per field: place i holds lag i, as many as there are rows.

    Six gathered windows instead of ``6 * lags`` columns; the form to keep for long blocks.
    """
    w = W.last_rows(lags)
    fields = ("close", "open", "high", "low", "vwap", "volume")
    rows = panel.withColumns({f"_{f}": F.collect_list(F.struct(F.col(f).alias("x"))).over(w) for f in fields})
    out = {f"{f.upper()}_LAGS": F.transform(F.reverse(F.col(f"_{f}")), _over(_c("volume") + EPS if f == "volume" else _c("close"))) for f in fields}
    return rows.select("inst", "dt", *[c.alias(n) for n, c in out.items()])


def _over(base: Column):
    return lambda r: r["x"] / base


def turnover(s: Stage, windows: Iterable[int] = WINDOWS, bases: Iterable[int] = (20, 60)) -> Family:
    x = _c("turn")
    out: Family = {}
    for d in windows:
        out |= {f"TO_MEAN_{d}d": s.mean("turn", d), f"TO_STD_{d}d": s.std("turn", d)}
    for b in bases:
        base = s.mean("turn", b)
        for d in windows:
            out[f"TO_REL_{d}d_over_{b}d"] = s.mean("turn", d) / (base + EPS)
            out[f"TO_ZSCORE_{d}d_over_{b}d"] = (s.mean("turn", d) - base) / (s.std("turn", b) + EPS)
        out[f"TO_CHG_RATE_over_{b}d"] = x / (base + EPS) - 1
    return out | {"TO_DELTA_1d": _c("_dturn"), "TO_DELTA_MEAN_5d": s.mean("_dturn", 5)}


def _related(s: Stage, name: str, x: str) -> Family:
    m20, m60 = s.mean(x, 20), s.mean(x, 60)
    return {
        f"{name}_MEAN_20d": m20, f"{name}_STD_20d": s.std(x, 20), f"{name}_MEAN_60d": m60, f"{name}_STD_60d": s.std(x, 60),
        f"{name}_REL_20d_over_60d": m20 / (m60 + EPS),
        f"{name}_ZSCORE_20d_over_60d": (m20 - m60) / (s.std(x, 60) + EPS),
        f"{name}_CHG_RATE_over_60d": _c(x) / (m60 + EPS) - 1,
    }


def valuation(s: Stage) -> Family:
    """Log and inverse of PE and PB, rolled and related to the 60-day base."""
    return (
        _related(s, "LOG_PE_TTM", "_log_pe_ttm") | _related(s, "LOG_PB", "_log_pb")
        | _related(s, "EP", "_inv_pe_ttm") | _related(s, "BM", "_inv_pb")
        | {
            "EP_MKT_REL_60": _c("_inv_pe_ttm") / (s.mean("_inv_pe_ttm", 60) + EPS),
            "EXPN_MOM_RISK_MKT": (_c("_log_pe_ttm") - s.mean("_log_pe_ttm", 60)) * F.least(s.mean("_ret", 5), F.lit(0.0)),
        }
    )


def turnover_momentum(s: Stage) -> Family:
    mom = s.mean("_ret", 5)
    return {"LOCK_MOM_5": mom * (1 - s.rank("turn", 20)), "DELTA_TO_MOM_5": _c("_dturn") * mom}


def illiquidity(s: Stage, prepared: DataFrame) -> tuple[DataFrame, Family]:
    """Mean of |return| / amount and its rank. The mean is named first: its rank rolls over it."""
    df = prepared.withColumns({"AMIH_5": W.mean("_illiq", 5), "AMIH_20": W.mean("_illiq", 20)})
    return df, {
        "AMIH_5": _c("AMIH_5"), "AMIH_20": _c("AMIH_20"),
        "IMPACT_PENALTY_5": s.rank("AMIH_5", 20), "IMPACT_PENALTY_20": s.rank("AMIH_20", 60),
    }


def group_mean(df: DataFrame, x: str, out: str, by: Sequence[str]) -> DataFrame:
    """Same-day mean inside a group. An aggregate and an equi join: a wide day is no hot window."""
    means = df.groupBy(*by).agg(F.avg(x).alias(out))
    return df.join(means, list(by), "left")


def industry_relative(s: Stage, prepared: DataFrame, industry: str = "industry", dt: str = "dt") -> tuple[DataFrame, Family]:
    """Turnover, EP and log PE against their industry means of the day.

    The three rolling means are named first and averaged in one pass.
    """
    df = prepared.withColumns({
        "_to20": W.mean("turn", 20), "_ep60": W.mean("_inv_pe_ttm", 60), "_lpe60": W.mean("_log_pe_ttm", 60),
        "_mom5": W.mean("_ret", 5),
    })
    means = df.groupBy(dt, industry).agg(*[F.avg(c).alias(f"_g{c}") for c in ("_to20", "_ep60", "_lpe60")])
    df = df.join(means, [dt, industry], "left")
    # the last one takes the negative part of the momentum
    return df, {
        "TO_IND_Q": _c("turn") / (_c("_g_to20") + EPS),
        "EP_IND": _c("_inv_pe_ttm") / (_c("_g_ep60") + EPS),
        "EXPN_MOM_RISK": (_c("_log_pe_ttm") - _c("_g_lpe60")) * F.least(_c("_mom5"), F.lit(0.0)),
    }


# Rolling forms of one column, each over its current value where the scale matters.
ROLLUPS = ["mean", "std", "slope", "rsquare", "resi", "ref", "rank", "qtlu", "qtld", "cntp", "cntn", "cntd"]


def rollup(s: Stage, prepared: DataFrame, columns: Sequence[str], windows: Iterable[int], forms: Sequence[str] = ROLLUPS) -> tuple[DataFrame, Family]:
    """Rolling forms of any columns: order-flow ratios, intraday columns, turnover ..."""
    df = prepared.withColumns({f"_prev_{c}": W.ref(c, 1) for c in columns})
    df = df.withColumns({f"_u_{c}": W.is_true(_c(c) > _c(f"_prev_{c}")) for c in columns})
    df = df.withColumns({f"_d_{c}": W.is_true(_c(c) < _c(f"_prev_{c}")) for c in columns})
    out: Family = {}
    for c in columns:
        now = F.nullif(_c(c) + EPS, F.lit(0.0))
        for d in windows:
            up, down = s.share(f"_u_{c}", d), s.share(f"_d_{c}", d)
            line = s.line(c, d)
            made = {
                "mean": s.mean(c, d) / now, "std": s.std(c, d) / now, "slope": line["slope"] / now,
                "rsquare": line["rsquare"], "resi": line["resi"] / now, "ref": s(f"_ref_{c}_{d}", W.ref(c, d)) / now,
                "rank": s.rank(c, d), "qtlu": s.quantile(c, d, 0.8) / now, "qtld": s.quantile(c, d, 0.2) / now,
                "cntp": up, "cntn": down, "cntd": up - down,
            }
            out |= {f"{f}_{c}_{d}": made[f] for f in forms}
    return df, out


def order_flow(s: Stage) -> Family:
    return {"FLOW_VOLUME": _c("flow_volume"), "FLOW_AMOUNT": _c("flow_amount"), "TRADE_SIZE": _c("trade_size")}


def fundamental_columns(df: DataFrame, suffixes: Sequence[str] = ("_ttm", "_lyr", "_lf")) -> list[str]:
    """Pass-through ratios are known by their suffix, so no list of names is kept."""
    return [c for c in df.columns if c.endswith(tuple(suffixes))]


def valuation_over_volume(s: Stage) -> Family:
    v = F.nullif(_c("volume"), F.lit(0.0))
    return {"PB_OVER_VOLUME": _c("pb") / v, "PE_OVER_VOLUME": _c("pe_ttm") / v}


def label(price: str = "adjclose", far: int = 5, near: int = 1) -> Column:
    """Return from ``near`` to ``far`` rows ahead."""
    return ratio(W.ahead(price, far), W.ahead(price, near)) - 1


def scaled_label(prepared: DataFrame, price: str = "adjclose", d: int = 5) -> Column:
    """The label over one plus the rolling deviation of the daily return."""
    return label(price) / (1 + W.std("_ret", d))


def build(prepared: DataFrame, features: Family, stage: Stage | None = None, keep: Sequence[str] = ("inst", "dt")) -> DataFrame:
    if stage:
        prepared = stage.apply(prepared)
    return prepared.select(*keep, *[c.alias(n) for n, c in features.items()])
