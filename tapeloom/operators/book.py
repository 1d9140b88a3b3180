"""Top-k books, cost, return and risk, all set-based.

Every day's book is the k best tradable names at equal weight. Holding periods and
partial replacement depend on the path and are not modelled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import ratio

YEAR = 252


def top_n(scores: DataFrame, n: int, by: Sequence[str] = ("dt",), score: str = "score", tie: str = "inst") -> DataFrame:
    """Best ``n`` rows per group by score, ties by name.

    The rank limit is applied before the shuffle too (group limit), so at most ``n`` rows
    per group leave a task and a wide day is no hot spot.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return scores.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= n)


def intersection(scores: DataFrame, seeds: Sequence[int], n: int, by: Sequence[str] = ("dt", "inst")) -> DataFrame:
    """Names in every seed's daily top-n, seed scores side by side and their mean.

    One aggregation with a having-count, instead of a join per seed.
    """
    top = top_n(scores.where(F.col("seed").isin(list(seeds))), n, by=["seed", by[0]])
    side = [F.max(F.when(F.col("seed") == s, F.col("score"))).alias(f"seed{i + 1}_score") for i, s in enumerate(seeds)]
    both = top.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *side, F.avg("score").alias("score"))
    return both.where(F.col("_n") == len(seeds)).drop("_n")


def intersection_stats(days: DataFrame, common: DataFrame, dt: str = "dt") -> DataFrame:
    """Days, total, mean, min and max size of the intersection, and days without any."""
    per_day = days.select(dt).distinct().join(common.groupBy(dt).agg(F.count(F.lit(1)).alias("n")), dt, "left").fillna(0, ["n"])
    n = F.col("n")
    return per_day.agg(
        F.count(F.lit(1)).alias("total_days"), F.sum(n).alias("total_intersections"), F.avg(n).alias("avg_size"),
        F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.count(F.when(n == 0, 1)).alias("empty_days"))


def tradable(rows: DataFrame, change: str = "change", limit: str = "max_change", close: str = "close", side: str = "buy") -> DataFrame:
    """Drop rows without a close, buys above the up-limit, sells below the down-limit."""
    ok = F.col(close).isNotNull()
    move = F.col(change) <= F.col(limit) if side == "buy" else F.col(change) >= -F.col(limit)
    return rows.where(ok & move)


def book_returns(scored: DataFrame, k: int, by: Sequence[str] = ("dt",), score: str = "score", fwd: str = "fwd") -> DataFrame:
    """Equal-weight return to the next row of the k best names per day."""
    return top_n(scored, k, by, score).groupBy(*by).agg(F.avg(fwd).alias("ret"), F.count(F.lit(1)).alias("names"))


def book_grid(scored: DataFrame, ks: Sequence[int], by: Sequence[str] = ("seed",), dt: str = "dt", fwd: str = "fwd") -> DataFrame:
    """Books for all k at once: ranks are computed once for the largest k and reused."""
    top = top_n(scored, max(ks), [*by, dt])
    k = F.explode(F.filter(F.array(*[F.lit(x) for x in sorted(ks)]), lambda x: x >= F.col("rn"))).alias("top_k")
    return top.select(*by, dt, fwd, k).groupBy(*by, "top_k", dt).agg(F.avg(fwd).alias("ret"))


def lot_size(cash: Column, names: Column, close: Column) -> Column:
    """Whole lots of 100 for an equal share of 99% of the cash."""
    return (F.floor(cash * 0.99 / names / close / 100) * 100).cast("long")


def affordable(candidates: DataFrame, cash: float, dt: str = "dt", close: str = "close", score: str = "score", tie: str = "inst", by: Sequence[str] = ()) -> DataFrame:
    """Largest number x of best names per day (and ``by``, as the seed of a run) for which each gets at least one lot, with sizes.

    A book of x names works when its dearest close is at most cash * .99 / x / 100, so the
    running maximum of the close along the ranks decides it, without trying each x.
    ``candidates`` is already cut to the book size (see ``top_n``).
    """
    w = Window.partitionBy(*by, dt).orderBy(F.desc(score), tie)
    rows = candidates.withColumns({
        "_x": F.row_number().over(w),
        "_dearest": F.max(close).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    fits = F.floor(F.lit(cash) * 0.99 / F.col("_x") / F.col("_dearest") / 100) >= 1
    best = F.max(F.when(fits, F.col("_x"))).over(Window.partitionBy(*by, dt))
    rows = rows.withColumn("names", best).where(F.col("_x") <= F.col("names"))
    return rows.withColumn("lots", lot_size(F.lit(cash), F.col("names"), F.col(close))).drop("_x", "_dearest")


def cost(value: Column, rate: float, minimum: float) -> Column:
    return F.round(F.greatest(value * rate, F.lit(minimum)), 2)


def stop_flag(close: Column, buy: Column, loss: float = -0.05, profit: float = 0.1) -> Column:
    """True where the move since the buy calls for a stop-loss or take-profit."""
    move = close / buy - 1
    return (move <= loss) | (move >= profit)


def trade_profit(buy: Column, sell: Column, volume: Column, buy_cost: Column, sell_cost: Column, held: Column) -> dict[str, Column]:
    """Profit after both costs, its rate on the paid amount, and the rate per day held."""
    profit = (sell - buy) * volume - buy_cost - sell_cost
    rate = profit / (buy * volume + buy_cost)
    return {"sell_profit": profit, "sell_profit_rate": rate, "sell_profit_rate_daily": rate / F.nullif(held, F.lit(0))}


def win_rates(trades: DataFrame, rate: str = "sell_profit_rate", dt: str = "dt") -> DataFrame:
    """Orders, wins and win rate per day and running. The running window has one row per day."""
    day = trades.groupBy(dt).agg(F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col(rate) > 0, 1)).alias("wins"))
    run = Window.partitionBy(F.lit(1)).orderBy(dt).rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumns({
        "win_rate": F.col("wins") / F.col("orders"),
        "orders_total": F.sum("orders").over(run), "wins_total": F.sum("wins").over(run),
        "win_rate_total": F.sum("wins").over(run) / F.sum("orders").over(run),
    })


def daily_risk_free(year_rate: float) -> float:
    return (1 + year_rate) ** (1 / YEAR) - 1


def annual(ret: Column) -> Column:
    """Compound annual return of a daily series; a day of -100% or worse gives null."""
    safe = F.when(ret > -1, F.ln(1 + ret))
    return F.when(F.count(F.when(ret <= -1, 1)) == 0, F.exp(F.sum(safe) * YEAR / F.nullif(F.count(ret), F.lit(0))) - 1)


def with_assets(daily: DataFrame, by: Sequence[str] = (), ret: str = "ret", dt: str = "dt") -> DataFrame:
    """Asset path from 1, its running maximum (the start counts) and drawdown.

    One row per day and book, so the window is bounded by the calendar.
    """
    path = Window.partitionBy(*by, F.lit(1)).orderBy(dt).rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("assets", F.exp(F.sum(F.ln(1 + F.col(ret))).over(path)))
    rows = rows.withColumn("top", F.greatest(F.lit(1.0), F.max("assets").over(path)))
    return rows.withColumn("drawdown", (F.col("assets") - F.col("top")) / F.col("top"))


def risk_figures(daily: DataFrame, by: Sequence[str] = (), ret: str = "ret", bench: str = "bench", year_rate: float = 0.02) -> DataFrame:
    """Annual return, volatility, Sharpe, alpha, beta, information ratio, drawdown per book."""
    rf = daily_risk_free(year_rate)
    rows = with_assets(daily.where(F.col(ret).isNotNull() & F.col(bench).isNotNull()), by, ret)
    r, b = F.col(ret), F.col(bench)
    excess, year = r - b, F.sqrt(F.lit(float(YEAR)))
    beta = ratio(F.covar_pop(r - rf, b - rf), F.var_pop(b - rf))
    return rows.groupBy(*by).agg(
        annual(r).alias("annual_return"), annual(b).alias("annual_benchmark_return"),
        (F.stddev_samp(r) * year).alias("volatility"), (ratio(F.avg(r - rf), F.stddev_samp(r - rf)) * year).alias("sharpe"),
        ((F.avg(r - rf) - beta * F.avg(b - rf)) * YEAR).alias("alpha"), beta.alias("beta"),
        (ratio(F.avg(excess), F.stddev_samp(excess)) * year).alias("information_ratio"), F.min("drawdown").alias("max_drawdown"),
    )


def annual_turnover(buy: Column, sell: Column, assets: Column) -> Column:
    return F.avg((buy + sell) / assets) * YEAR


def equal_weight_benchmark(panel: DataFrame, spans: DataFrame, start: str, end: str, ret: str = "ret", inst: str = "inst", dt: str = "dt") -> DataFrame:
    """Mean return per day over all contracts whose span meets [start, end]."""
    from tapeloom.operators.spans import overlapping

    members = overlapping(spans, start, end).select(inst).distinct()
    rows = panel.where(F.col(dt).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(members, inst, "left_semi")
    return rows.groupBy(dt).agg(F.avg(ret).alias("bench"))


def simple_figures(rows: DataFrame, by: Sequence[str], series: dict[str, str], periods: int = YEAR, dt: str = "dt") -> DataFrame:
    """Mean-based yearly return, ratio and drawdown of summed returns, for each prefix: column.

    All series share one window and one aggregation.
    """
    run = Window.partitionBy(*by, F.lit(1)).orderBy(dt).rowsBetween(Window.unboundedPreceding, 0)
    path = rows.withColumns({f"_{p}sum": F.sum(x).over(run) for p, x in series.items()})
    path = path.withColumns({f"_{p}top": F.max(f"_{p}sum").over(run) for p in series})
    aggs = []
    for p, x in series.items():
        c = F.col(x)
        aggs += [
            (F.avg(c) * periods).alias(f"{p}annual"),
            (ratio(F.avg(c), F.stddev_samp(c)) * F.sqrt(F.lit(float(periods)))).alias(f"{p}ratio"),
            F.min(F.col(f"_{p}sum") - F.col(f"_{p}top")).alias(f"{p}drawdown"),
        ]
    return path.groupBy(*by).agg(*aggs)


def net_and_excess(report: DataFrame, by: Sequence[str] = (), periods: int = YEAR, dt: str = "dt") -> DataFrame:
    """Six figures of (return - cost) and (return - bench - cost); the last three are null without a bench."""
    bench = F.col("bench") if "bench" in report.columns else F.lit(None).cast("double")
    rows = report.withColumns({"_net": F.col("ret") - F.col("cost"), "_ex": F.col("ret") - bench - F.col("cost")})
    out = simple_figures(rows, by, {"n_": "_net", "e_": "_ex"}, periods, dt)
    return out.select(
        *by, F.col("n_ratio").alias("sharpe"), F.col("n_annual").alias("annual_return"), F.col("n_drawdown").alias("max_drawdown"),
        F.col("e_ratio").alias("information_ratio"), F.col("e_annual").alias("annual_excess_return"), F.col("e_drawdown").alias("excess_max_drawdown"))


def parameter_grid(runs: DataFrame, ks: Sequence[int] = (80, 50, 30, 20, 10), ratios: Sequence[float] = (1.0, 0.1), holds: Sequence[int] = (10, 5, 1)) -> DataFrame:
    """Each run with every (top_k, n_drop, hold_p); n_drop = max(1, int(k * ratio)), at most k.

    The grid is a short literal array, exploded per row.
    """
    grid = [(k, max(1, int(k * r)), h) for k in ks for r in ratios for h in holds]
    cells = F.array(*[F.struct(F.lit(k).alias("top_k"), F.lit(d).alias("n_drop"), F.lit(h).alias("hold_p")) for k, d, h in grid if d <= k])
    return runs.select("*", F.explode(cells).alias("_g")).select(*runs.columns, "_g.*")


def simple_annual_return(total: Column, first: Column, last: Column) -> Column:
    """Total return times 365 over calendar days held (older form)."""
    return total * 365 / F.nullif(F.datediff(last, first), F.lit(0))
