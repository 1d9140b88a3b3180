"""Queries for factor health, rank IC, seeds, cross-sections and factor selection (A35-A64, X*, D*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as W
from tapeloom.operators import calendar as C
from tapeloom.operators import crosssection as S
from tapeloom.operators import health, ranking, runs, selection
from tapeloom.plans.bar_queries import day, rnd
from tapeloom.plans.flagship import RANKS
from tapeloom.plans.frames import FACTORS, with_frames
from tapeloom.plans.registry import query
from tapeloom.scale import group_limit, quantiles, with_ranks
from tapeloom.session import materialize

L = {"ranks": RANKS.format(src="factor_long"),
     "ic": """SELECT dt, factor, round(corr(rx, ry), 12) AS rank_ic, count(*) AS names, count(*) / any_value(n_all)::DOUBLE AS coverage FROM ranks
 JOIN (SELECT dt, factor, count(*) AS n_all FROM factor_long GROUP BY dt, factor) USING (dt, factor) GROUP BY dt, factor
 HAVING count(*) >= 10 AND min(rx) < max(rx) AND min(ry) < max(ry)"""}


def fl(body: str, **extra: str) -> str:
    return with_frames(body, "factor_long", **extra)


def long(t):
    return ranking.to_long(t.factors(), FACTORS)


def rank_ic(t):
    return ranking.panel_rank_ic(t.factors(), FACTORS, split=t.wide_days(), rows=t.size("lineitem"))


def rnds(df, keys, *cols, n=6):
    return df.select(*keys, *[F.round(c, n).alias(c) for c in cols])


# --- A35-A42 -------------------------------------------------------------------------
_COUNTS = """SELECT factor AS "column", count(*) AS total_values, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nan_count,
 CAST(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_count FROM factor_long GROUP BY factor"""


@query("a35_table_null_zero_share", fl(
    """SELECT CAST(sum(total_values) AS BIGINT) AS total_values, CAST(sum(nan_count) AS BIGINT) AS nan_count, round(sum(nan_count) / sum(total_values)::DOUBLE, 8) AS nan_ratio,
 CAST(sum(zero_count) AS BIGINT) AS zero_count, round(sum(zero_count) / sum(total_values)::DOUBLE, 8) AS zero_ratio FROM c""", c=_COUNTS))
def _(t):
    return rnds(health.table_counts(t.factors(), FACTORS), ["total_values", "nan_count", "zero_count"], "nan_ratio", "zero_ratio", n=8)


@query("a36_column_null_zero_share", fl(
    """SELECT "column", total_values, nan_count, zero_count, round(nan_count / total_values::DOUBLE, 8) AS nan_ratio,
 round(zero_count / total_values::DOUBLE, 8) AS zero_ratio FROM c""", c=_COUNTS))
def _(t):
    return rnds(health.column_counts(t.factors(), FACTORS), ["column", "total_values", "nan_count", "zero_count"], "nan_ratio", "zero_ratio", n=8)


@query("a37_factor_health", fl(
    """SELECT factor, round(avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS nan_ratio, round(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS zero_ratio,
 round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.99), 6) AS p99
 FROM factor_long GROUP BY factor"""))
def _(t):
    return rnds(health.factor_health(long(t), t.big("lineitem")), ["factor"], "nan_ratio", "zero_ratio", "mean", "std", "p01", "p99")


@query("a38_entropy", fl(
    """SELECT factor, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM (SELECT factor, least(floor((x - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS n
 FROM factor_long JOIN (SELECT factor, min(x) AS lo, max(x) AS hi FROM factor_long GROUP BY factor) USING (factor) WHERE x IS NOT NULL GROUP BY factor, bin) GROUP BY factor"""))
def _(t):
    return rnds(health.entropy(long(t)), ["factor"], "entropy")


@query("a39_extreme_share", fl(
    """SELECT factor, round(sum(CASE WHEN x < lo OR x > hi THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS extreme_ratio FROM factor_long
 JOIN (SELECT factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM factor_long GROUP BY factor) USING (factor) GROUP BY factor"""))
def _(t):
    return rnds(health.extreme_share(long(t), split=t.big("lineitem")), ["factor"], "extreme_ratio")


@query("a40_longest_null_run", fl(
    """SELECT factor, round(greatest(coalesce(max(gap), 0), max(n) - coalesce(max(last), 0)) / max(n)::DOUBLE, 8) AS max_nan_streak_ratio FROM
 (SELECT factor, pos - coalesce(lag(pos) OVER (PARTITION BY factor ORDER BY pos), 0) - 1 AS gap, pos AS last FROM p WHERE x IS NOT NULL)
 RIGHT JOIN (SELECT factor, count(*) AS n FROM factor_long GROUP BY factor) USING (factor) GROUP BY factor""",
    p="SELECT factor, x, row_number() OVER (PARTITION BY factor ORDER BY inst, dt) AS pos FROM factor_long"))
def _(t):
    return rnds(health.longest_null_run(t.factors(), FACTORS, split=t.big("lineitem")), ["factor"], "max_nan_streak_ratio", n=8)


@query("a41_population_shape", fl(
    """SELECT factor, round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 5) AS skew, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 4) AS kurtosis
 FROM factor_long JOIN (SELECT factor, avg(x) AS m FROM factor_long GROUP BY factor) USING (factor) GROUP BY factor"""))
def _(t):
    return health.shape(long(t)).select("factor", rnd("skew", 5), rnd("kurtosis", 4))


@query("a42_coverage", fl("SELECT factor, round(avg(coverage), 6) AS coverage, count(*) AS days FROM ic GROUP BY factor", **L))
def _(t):
    return rank_ic(t).groupBy("factor").agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.count(F.lit(1)).alias("days"))


# --- A43-A49 -------------------------------------------------------------------------
@query("a43_daily_rank_ic", fl("SELECT CAST(dt AS VARCHAR) AS dt, factor, names, round(rank_ic, 6) AS rank_ic, round(coverage, 6) AS coverage FROM ic", **L))
def _(t):
    return rnds(rank_ic(t), [day(), "factor", "names"], "rank_ic", "coverage")


_IC = {"s": "SELECT seed, dt, score, fwd AS label FROM scores JOIN rets USING (inst, dt) WHERE fwd IS NOT NULL",
       "r": """SELECT *, rank() OVER (PARTITION BY seed, dt ORDER BY score) + (count(*) OVER (PARTITION BY seed, dt, score) - 1) / 2.0 AS rp,
 rank() OVER (PARTITION BY seed, dt ORDER BY label) + (count(*) OVER (PARTITION BY seed, dt, label) - 1) / 2.0 AS rl FROM s""",
       "d": """SELECT seed, dt, CASE WHEN min(score) < max(score) AND min(label) < max(label) THEN corr(score, label) END AS ic,
 CASE WHEN min(score) < max(score) AND min(label) < max(label) THEN corr(rp, rl) END AS ric FROM r GROUP BY seed, dt"""}


def scored(t):
    return t.scored_returns()


def score_ic(t):
    return ranking.daily_ic(scored(t), ["seed", "dt"], "score", "fwd", t.wide_days())


@query("a44_daily_ic", with_frames("SELECT seed, CAST(dt AS VARCHAR) AS dt, round(ic, 6) AS ic, round(ric, 6) AS ric FROM d", "scores", "rets", **_IC))
def _(t):
    return rnds(score_ic(t), ["seed", day()], "ic", "ric")


@query("a45_model_summary", with_frames(
    """SELECT seed, round(avg(ic), 6) AS "IC", round(avg(ic) / stddev_pop(ic), 6) AS "ICIR", round(avg(ric), 6) AS "RIC", round(avg(ric) / stddev_pop(ric), 6) AS "RICIR"
 FROM d GROUP BY seed""", "scores", "rets", **_IC))
def _(t):
    return rnds(ranking.model_summary(score_ic(t), ["seed"]), ["seed"], "IC", "ICIR", "RIC", "RICIR")


@query("a46_rank_ic_summary", fl(
    """SELECT factor, round(avg(rank_ic), 6) AS rankic_mean, round(stddev_samp(rank_ic), 6) AS rankic_std,
 round(avg(rank_ic) / (stddev_samp(rank_ic) + 1e-6), 6) AS rankic_ir FROM ic GROUP BY factor""", **L))
def _(t):
    return rnds(ranking.rank_ic_summary(rank_ic(t)), ["factor"], "rankic_mean", "rankic_std", "rankic_ir")


@query("a47_rank_ic_quartiles", fl(
    """SELECT factor, round(quantile_cont(rank_ic, 0.25), 6) AS rankic_q25, round(quantile_cont(rank_ic, 0.5), 6) AS rankic_q50,
 round(quantile_cont(rank_ic, 0.75), 6) AS rankic_q75 FROM ic GROUP BY factor""", **L))
def _(t):
    return rnds(ranking.rank_ic_summary(rank_ic(t)), ["factor"], "rankic_q25", "rankic_q50", "rankic_q75")


@query("a48_sign_stability", fl(
    """SELECT factor, round(avg(CASE WHEN sign(rank_ic) = sign(m) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS sign_stability,
 round(avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS positive_ratio FROM ic JOIN (SELECT factor, avg(rank_ic) AS m FROM ic GROUP BY factor) USING (factor) GROUP BY factor""", **L))
def _(t):
    return rnds(ranking.rank_ic_summary(rank_ic(t)), ["factor"], "sign_stability", "positive_ratio")


@query("a49_ic_summary", fl(
    """SELECT factor, round(avg(rank_ic), 6) AS ic_mean, round(stddev_samp(rank_ic), 6) AS ic_std,
 round(CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) ELSE 0 END, 6) AS ic_ir, round(avg(abs(rank_ic)), 6) AS ic_abs_mean,
 count(rank_ic) AS ic_obs FROM ic GROUP BY factor""", **L))
def _(t):
    return rnds(ranking.ic_summary(rank_ic(t)), ["factor", "ic_obs"], "ic_mean", "ic_std", "ic_ir", "ic_abs_mean")


@query("w18_rolling_ir", fl(
    """SELECT factor, CAST(dt AS VARCHAR) AS dt, round(CASE WHEN count(*) OVER w >= 60 THEN avg(rank_ic) OVER w / stddev_samp(rank_ic) OVER w END, 6) AS ir
 FROM ic WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", **L))
def _(t):
    w = Window.partitionBy("factor").orderBy("dt").rowsBetween(-59, 0)
    ir = F.when(F.count(F.lit(1)).over(w) >= 60, F.avg("rank_ic").over(w) / F.nullif(F.stddev_samp("rank_ic").over(w), F.lit(0.0)))
    return rank_ic(t).select("factor", day(), F.round(ir, 6).alias("ir"))


# --- A50-A64 -------------------------------------------------------------------------
_SEED = {"o": """SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rankicir DESC, epoch) AS best, row_number() OVER (PARTITION BY seed ORDER BY epoch) AS pl,
 count(*) OVER (PARTITION BY seed) AS n FROM epochs""",
         "m": """SELECT seed, avg(rankicir) AS mean_rankicir, stddev_samp(rankicir) AS std_rankicir, stddev_samp(rankicir) / (abs(avg(rankicir)) + 1e-6) AS cv_rankicir,
 avg(icir) AS mean_icir, avg(rankic) AS mean_rankic, avg(ic) AS mean_ic, avg(rankicir) FILTER (best <= greatest(1, floor(n * 0.2))) AS top_rankicir_mean,
 avg(rankicir) FILTER (pl <= n // 2) AS early_rankicir, avg(rankicir) FILTER (pl > n // 2) AS late_rankicir FROM o GROUP BY seed""",
         "mm": "SELECT *, early_rankicir - late_rankicir AS overfit_gap FROM m"}
_SEEDC = ["mean_rankicir", "std_rankicir", "cv_rankicir", "mean_icir", "mean_rankic", "mean_ic", "top_rankicir_mean", "early_rankicir", "late_rankicir", "overfit_gap"]


def seeds(t):
    return runs.seed_metrics(t.epochs(), split=t.size("orders", "o_custkey") > group_limit(t.spark))


@query("a50_seed_metrics", with_frames("SELECT seed, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SEEDC) + " FROM mm", "epochs", **_SEED))
def _(t):
    return rnds(seeds(t), ["seed"], *_SEEDC)


@query("a51_seed_score", with_frames(
    """SELECT seed, round(0.45 * mean_rankicir + 0.25 * mean_icir + 0.15 * mean_rankic + 0.10 * top_rankicir_mean - 0.30 * cv_rankicir
 - 0.50 * CASE WHEN overfit_gap > 0 THEN overfit_gap ELSE 0 END, 6) AS score FROM mm""", "epochs", **_SEED))
def _(t):
    return seeds(t).select("seed", F.round(runs.seed_score(), 6).alias("score"))


@query("a52_seed_class", with_frames(
    """SELECT class, count(*) AS seeds FROM (SELECT CASE WHEN top_rankicir_mean > 0.7 AND cv_rankicir > 0.6 THEN 'scalpel'
 WHEN mean_rankicir > 0.35 AND cv_rankicir < 0.35 AND abs(overfit_gap) < 0.05 THEN 'workhorse' WHEN mean_rankicir > 0.45 AND cv_rankicir < 0.5 THEN 'swiss_knife'
 WHEN top_rankicir_mean > 0.8 AND mean_rankicir < 0.2 THEN 'lottery' WHEN abs(mean_rankicir) < 0.1 AND cv_rankicir < 0.4 THEN 'blunt_knife'
 WHEN overfit_gap > 0.15 THEN 'paper_knife' ELSE 'unclassified' END AS class FROM mm) GROUP BY class""", "epochs", **_SEED))
def _(t):
    return seeds(t).select(runs.seed_class().alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("seeds"))


_CLASS = """CASE WHEN top_rankicir_mean > 0.7 AND cv_rankicir > 0.6 THEN 'scalpel'
 WHEN mean_rankicir > 0.35 AND cv_rankicir < 0.35 AND abs(overfit_gap) < 0.05 THEN 'workhorse' WHEN mean_rankicir > 0.45 AND cv_rankicir < 0.5 THEN 'swiss_knife'
 WHEN top_rankicir_mean > 0.8 AND mean_rankicir < 0.2 THEN 'lottery' WHEN abs(mean_rankicir) < 0.1 AND cv_rankicir < 0.4 THEN 'blunt_knife'
 WHEN overfit_gap > 0.15 THEN 'paper_knife' ELSE 'unclassified' END"""
_LABELS = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in runs.SEED_CLASSES.items())


@query("a52_seed_label", with_frames(
    "SELECT seed, seed_type, recommended_usage FROM sc JOIN lb USING (class)", "epochs", **_SEED, sc=f"SELECT seed, {_CLASS} AS class FROM mm",
    lb=f"SELECT * FROM (VALUES {_LABELS}) v(class, seed_type, recommended_usage)"))
def _(t):
    labels = runs.seed_class_labels(runs.seed_class())
    return seeds(t).select("seed", labels["SeedType"].alias("seed_type"), labels["RecommendedUsage"].alias("recommended_usage"))


_PM = """round(avg(annual_return), 6) AS annual_return_mean, round(avg(max_drawdown), 6) AS max_drawdown_mean, round(avg(sharpe), 6) AS sharpe_mean,
 round(avg(information_ratio), 6) AS information_ratio_mean, round(avg(annual_return) FILTER (gate_excess_return > 0), 6) AS q_annual_return_mean,
 round(avg(information_ratio) FILTER (gate_excess_return > 0), 6) AS q_information_ratio_mean"""


@query("a53_parameter_means", with_frames(" UNION ALL ".join(
    f"SELECT '{k}' AS parameter, CAST({k} AS DOUBLE) AS value, {_PM} FROM runs GROUP BY {k}" for k in ("top_k", "hold_p", "n_drop")), "runs"))
def _(t):
    out = runs.parameter_means(t.runs(), ["top_k", "hold_p", "n_drop"])
    return rnds(out, ["parameter", "value"], *[c for c in out.columns if c.endswith("_mean")])


def _bands_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS "count", round(avg(e), 6) AS annual_return_mean, round(avg(max_drawdown), 6) AS max_drawdown_mean,
 round(count(*) FILTER (e > 0) / count(*)::DOUBLE, 6) AS excess_return_0_r, round(count(*) FILTER (e > 0 AND e < 0.5) / count(*)::DOUBLE, 6) AS excess_return_0_50_r,
 round(count(*) FILTER (e >= 0.5 AND e < 1) / count(*)::DOUBLE, 6) AS excess_return_50_100_r, round(count(*) FILTER (e >= 1) / count(*)::DOUBLE, 6) AS excess_return_100_r
 FROM (SELECT *, annual_return - annual_benchmark_return AS e, 'p' || top_k || '-' || n_drop || '-' || hold_p AS b_params,
 "D_model" || '-' || "LR" || '-' || "Dropout" AS t_params FROM runs) GROUP BY ALL"""


_BANDC = ["annual_return_mean", "max_drawdown_mean", "excess_return_0_r", "excess_return_0_50_r", "excess_return_50_100_r", "excess_return_100_r"]


@query("a54_band_counts", with_frames(_bands_sql("top_k, n_drop, hold_p"), "runs"))
def _(t):
    return rnds(runs.bands(t.runs(), ["top_k", "n_drop", "hold_p"]), ["top_k", "n_drop", "hold_p", "count"], *_BANDC)


@query("a55_two_key_grid", with_frames(_bands_sql("b_params, t_params"), "runs"))
def _(t):
    return rnds(runs.bands(runs.with_param_keys(t.runs()), ["b_params", "t_params"]), ["b_params", "t_params", "count"], *_BANDC)


@query("a56_return_bands", with_frames(" UNION ALL ".join(
    f"""SELECT '{n}' AS band, "D_model", "LR", "Dropout", count(*) AS "count" FROM runs WHERE annual_excess_return >= {a} AND annual_excess_return < {b} GROUP BY ALL"""
    for n, a, b in (("low", 0.2, 0.3), ("high", 0.3, 1))), "runs"))
def _(t):
    keys = ["D_model", "LR", "Dropout"]
    parts = [runs.return_bands(t.runs(), keys, a, b).withColumn("band", F.lit(n)) for n, a, b in (("low", 0.2, 0.3), ("high", 0.3, 1.0))]
    return parts[0].unionByName(parts[1])


_GATES = ["sharpe", "information_ratio", "Test_IC", "max_drawdown"]


@query("a57_before_after", with_frames(
    """SELECT top_k, n_drop, hold_p, round(avg(e), 6) AS annual_return_old, round(avg(max_drawdown), 6) AS max_drawdown_old, count(*) FILTER (k) AS "count",
 round(avg(e) FILTER (k), 6) AS annual_return_mean, round(avg(max_drawdown) FILTER (k), 6) AS max_drawdown_mean, round(avg(e) FILTER (k) - avg(e), 6) AS annual_return_c
 FROM g GROUP BY ALL HAVING count(*) FILTER (k) > 0""", "runs",
    g="SELECT *, annual_return - annual_benchmark_return AS e, gate_excess_return > 0" + "".join(
        f' AND "{m}" > (SELECT avg("{m}") FROM runs WHERE gate_excess_return > 0)' for m in _GATES) + " AS k FROM runs")
    .replace("gate_excess_return > 0", "gate_excess_return > -0.05"))
def _(t):
    # every given run is below zero excess, so the gate is moved to a value that divides them
    shifted = t.runs().withColumn("gate", F.col("gate_excess_return") + 0.05)
    out = runs.above_average(shifted, ["top_k", "n_drop", "hold_p"], _GATES, gate="gate")
    return rnds(out, ["top_k", "n_drop", "hold_p", "count"], "annual_return_old", "max_drawdown_old", "annual_return_mean", "max_drawdown_mean", "annual_return_c")


_MED = ["annual_return", "sharpe", "information_ratio"]


@query("a58_seed_medians", with_frames('SELECT "Seed", ' + ", ".join(f"round(median({m}), 6) AS {m}_median" for m in _MED) + ' FROM runs GROUP BY "Seed"', "runs"))
def _(t):
    return rnds(runs.seed_medians(t.runs(), _MED, split=t.big("part")), ["Seed"], *[f"{m}_median" for m in _MED])


@query("a59_seed_share_of_top", with_frames(
    """SELECT "Seed", count(*) / 100.0::DOUBLE AS seed_percent FROM (SELECT * FROM runs ORDER BY annual_return DESC, "Step" LIMIT 100) GROUP BY "Seed" """, "runs"))
def _(t):
    return runs.seed_share_of_top(t.runs(), 100)


@query("a61_daily_positive_share_median", with_frames(
    """SELECT seed, CAST(dt AS VARCHAR) AS dt, round(avg(CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS positive_ratio, round(median(score), 8) AS score_median
 FROM scores GROUP BY seed, dt""", "scores"))
def _(t):
    s = t.scores()
    share = s.groupBy("seed", "dt").agg(F.avg((F.col("score") > 0.5).cast("double")).alias("positive_ratio"))
    med = quantiles(s, ["seed", "dt"], "score", {"score_median": 0.5}, t.wide_days())
    return share.join(med, ["seed", "dt"]).select("seed", day(), rnd("positive_ratio"), rnd("score_median", 8))


@query("a62_best_epochs", with_frames("SELECT seed, " + ", ".join(
    f"min(epoch) FILTER ({m} = top_{m}) AS best_{m}_epoch, max({m}) AS best_{m}" for m in ("ic", "icir", "rankic", "rankicir"))
    + " FROM (SELECT *, " + ", ".join(f"max({m}) OVER (PARTITION BY seed) AS top_{m}" for m in ("ic", "icir", "rankic", "rankicir")) + " FROM epochs) GROUP BY seed", "epochs"))
def _(t):
    return runs.best_epochs(t.epochs(), ["seed"], ["ic", "icir", "rankic", "rankicir"])


@query("a63_best_checkpoint", with_frames(
    "SELECT seed, epoch, ic, icir, rankic, rankicir FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY icir DESC, epoch DESC) AS rn FROM epochs) WHERE rn = 1", "epochs"))
def _(t):
    return runs.best_checkpoints(t.epochs(), "icir")


@query("a64_select_checkpoints", with_frames(
    """SELECT 'last' AS scope, seed, epoch FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY epoch DESC) AS rn FROM epochs) WHERE rn = 1
 UNION ALL SELECT 'every', seed, epoch FROM epochs WHERE epoch % 5 = 0 UNION ALL SELECT 'all', seed, epoch FROM epochs WHERE epoch >= 100""", "epochs"))
def _(t):
    e = t.epochs()
    parts = [runs.select_checkpoints(e, "last"), runs.select_checkpoints(e, "every", 5), runs.select_checkpoints(e, "all", min_epoch=100)]
    return parts[0].select(F.lit("last").alias("scope"), "seed", "epoch").unionByName(
        parts[1].select(F.lit("every").alias("scope"), "seed", "epoch")).unionByName(parts[2].select(F.lit("all").alias("scope"), "seed", "epoch"))


# --- X -------------------------------------------------------------------------------
TRAIN_END = "1998-12-31"

@query("x01_robust_zscore", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, " + ", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN greatest(-3.0, least(3.0, ({c} - (SELECT m_{c} FROM m)) / ((SELECT median(abs({c} - (SELECT m_{c} FROM m))) FROM tr) * 1.4826 + 1e-12))) END, 6) AS {c}"
        for c in ("f_ma5", "f_vol")) + " FROM factors", "factors",
    tr=f"SELECT * FROM factors WHERE dt <= DATE '{TRAIN_END}'", m="SELECT median(f_ma5) AS m_f_ma5, median(f_vol) AS m_f_vol FROM tr"))
def _(t):
    panel = t.factors().select("inst", "dt", "f_ma5", "f_vol")
    out = S.robust_zscore(panel, panel.where(F.col("dt") <= F.lit(TRAIN_END).cast("date")), ["f_ma5", "f_vol"], split=t.big("lineitem"))
    return rnds(out, ["inst", day()], "f_ma5", "f_vol")


@query("x02_fillna_zero", with_frames("SELECT inst, CAST(dt AS VARCHAR) AS dt, coalesce(f_mom, 0) AS f_mom, coalesce(f_gap, 0) AS f_gap FROM factors", "factors"))
def _(t):
    return t.factors().fillna(0.0, FACTORS).select("inst", day(), "f_mom", "f_gap")


@query("x03_drop_null_label", with_frames("SELECT inst, CAST(dt AS VARCHAR) AS dt, label FROM factors WHERE label IS NOT NULL", "factors"))
def _(t):
    return t.factors().na.drop(subset=["label"]).select("inst", day(), "label")


@query("x04_day_zscore", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round((f_range - avg(f_range) OVER d) / nullif(stddev_samp(f_range) OVER d, 0), 6) AS f_range FROM factors WINDOW d AS (PARTITION BY dt)", "factors"))
def _(t):
    return rnds(S.day_zscore(t.factors(), ["f_range"]), ["inst", day()], "f_range")


@query("x05_label_zscore", with_frames(
    "SELECT inst, CAST(dt AS VARCHAR) AS dt, round((label - avg(label) OVER d) / greatest(stddev_pop(label) OVER d, 1e-8), 6) AS label FROM factors WHERE label IS NOT NULL WINDOW d AS (PARTITION BY dt)", "factors"))
def _(t):
    rows = t.factors().where(F.col("label").isNotNull())
    return rnds(S.day_zscore(rows, ["label"], population=True, floor=1e-8), ["inst", day()], "label")


@query("x06_day_rank_label", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, round(((rank() OVER (PARTITION BY dt ORDER BY label) + (count(*) OVER (PARTITION BY dt, label) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) - 0.5) * 3.46, 6) AS label
 FROM factors WHERE label IS NOT NULL""", "factors"))
def _(t):
    rows = t.factors().where(F.col("label").isNotNull())
    return rnds(S.day_rank_norm(rows, "label", "label", split=t.wide_days()), ["inst", day()], "label")


@query("x07_global_zscore", with_frames(
    f"""SELECT inst, CAST(dt AS VARCHAR) AS dt, round((f_mom - m) / (s + 1e-12), 6) AS f_mom FROM factors, (SELECT avg(f_mom) AS m, stddev_samp(f_mom) AS s FROM factors WHERE dt <= DATE '{TRAIN_END}')""", "factors"))
def _(t):
    panel = t.factors().select("inst", "dt", "f_mom")
    return rnds(S.global_zscore(panel, panel.where(F.col("dt") <= F.lit(TRAIN_END).cast("date")), ["f_mom"]), ["inst", day()], "f_mom")


@query("x08_drop_extreme_label", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, label FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY label, inst) AS pos, count(*) OVER (PARTITION BY dt) AS n FROM factors WHERE label IS NOT NULL)
 WHERE floor(0.1 * n) <= 0 OR 2 * floor(0.1 * n) >= n OR (pos > floor(0.1 * n) AND pos <= n - floor(0.1 * n))""", "factors"))
def _(t):
    # a tenth per end: at 2.5% the small days of the test data would lose nothing
    return S.drop_extreme(t.factors(), "label", share=0.1, split=t.wide_days()).select("inst", day(), "label")


_C = "SELECT inst, CAST(dt AS VARCHAR) AS dt, {} FROM daily WINDOW w AS (PARTITION BY inst ORDER BY dt)"
_UP = "(w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("x12_daily_return", with_frames(_C.format("round(close / lag(close) OVER w - 1, 6) AS ret"), "daily"))
def _(t):
    return t.daily().select("inst", day(), F.round(S.daily_return(), 6).alias("ret"))


@query("x13_return_from_first", with_frames(_C.format("round(close / first_value(close) OVER w - 1, 6) AS ret"), "daily"))
def _(t):
    return t.daily().select("inst", day(), F.round(S.return_from_first(), 6).alias("ret"))


@query("x14_drawdown", with_frames(_C.format(f"round((close - max(close) OVER {_UP}) / max(close) OVER {_UP}, 6) AS drawdown"), "daily"))
def _(t):
    top = S.running_max()
    return t.daily().select("inst", day(), F.round((F.col("close") - top) / top, 6).alias("drawdown"))


@query("x15_previous_close", with_frames(_C.format("round(coalesce(lag(close) OVER w, close), 6) AS preclose"), "daily"))
def _(t):
    return t.daily().select("inst", day(), F.round(S.previous_close(), 6).alias("preclose"))


@query("x16_dense_rank", with_frames('SELECT "Step", dense_rank() OVER (ORDER BY sharpe) AS sharpe_rank, dense_rank() OVER (ORDER BY annual_return) AS annual_return_rank FROM runs', "runs"))
def _(t):
    df = source = t.runs().select("Step", "sharpe", "annual_return")
    for c in ("sharpe", "annual_return"):
        df = with_ranks(df, [], c, dense=f"{c}_rank", split=t.big("part"), source=source)
    return df.select("Step", "sharpe_rank", "annual_return_rank")


@query("x17_percent_rank", with_frames(
    'SELECT "Step", round((rank() OVER (ORDER BY sharpe) + (count(*) OVER (PARTITION BY sharpe) - 1) / 2.0) / count(*) OVER (), 8) AS sharpe_pct FROM runs', "runs"))
def _(t):
    return with_ranks(t.runs().select("Step", "sharpe"), [], "sharpe", pct="p", split=t.big("part")).select("Step", F.round("p", 8).alias("sharpe_pct"))


@query("x18_min_max_100", with_frames(
    """SELECT "Step", round((sharpe - min(sharpe) OVER ()) / (max(sharpe) OVER () - min(sharpe) OVER ()) * 60 + (alpha - min(alpha) OVER ()) / (max(alpha) OVER () - min(alpha) OVER ()) * 40, 6) AS score FROM runs""", "runs"))
def _(t):
    out = runs.to_hundred(t.runs().select("Step", "sharpe", "alpha"), ["sharpe", "alpha"])
    return out.select("Step", F.round(F.col("sharpe") * 0.6 + F.col("alpha") * 0.4, 6).alias("score"))


@query("x19_lookback_tensor")
def _(t):
    from tapeloom.functions.features import by_instrument

    out = S.lookback_tensor(by_instrument(t.factors().fillna(0.0, FACTORS)), FACTORS, steps=8)
    flat = F.flatten("tensor")
    return out.select("inst", day(), F.size("tensor").alias("steps"), F.size(flat).alias("cells"),
                      F.round(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("x20_lookback_tensor_filled")
def _(t):
    from tapeloom.functions.features import by_instrument

    out = S.lookback_tensor(by_instrument(t.factors()), ["f_mom", "f_gap", "f_vol"], steps=8, pad="fill")
    flat = F.flatten("tensor")
    return out.select("inst", day(), F.size("tensor").alias("steps"),
                      F.size(F.filter(flat, lambda v: v.isNull())).alias("unknown"),
                      F.round(F.aggregate(flat, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 6).alias("total"))


@query("x21_segment_with_lookback", with_frames(
    """SELECT inst, CAST(dt AS VARCHAR) AS dt, CASE WHEN dt >= DATE '1999-01-01' THEN 1 ELSE 0 END AS in_segment FROM keys
 WHERE day_idx >= (SELECT min(idx) FROM calendar WHERE dt >= DATE '1999-01-01') - 8 AND dt <= DATE '2000-06-30'""", "keys"))
def _(t):
    rows = t.ticks().select("inst", "dt").distinct()
    out = C.segment_with_lookback(rows, t.calendar(), F.lit("1999-01-01").cast("date"), F.lit("2000-06-30").cast("date"), 8)
    return out.select("inst", day(), F.col("in_segment").cast("int").alias("in_segment"))


@query("x22_rolling_split_dates", with_frames(
    "SELECT segment, e - s + 1 AS length, CAST(a.dt AS VARCHAR) AS start_dt, CAST(b.dt AS VARCHAR) AS end_dt FROM moved JOIN calendar a ON a.idx = s + shift JOIN calendar b ON b.idx = e + shift",
    "calendar", seg="""SELECT * FROM (VALUES ('train', DATE '1995-01-02', DATE '1998-12-31'), ('valid', DATE '1999-01-10', DATE '1999-12-31'),
 ('test', DATE '2000-01-10', DATE '2000-12-31')) v(segment, a, b)""",
    pos="SELECT segment, min(idx) FILTER (dt >= a) AS s, max(idx) FILTER (dt <= b) AS e FROM seg, calendar GROUP BY segment",
    moved="SELECT *, (SELECT max(idx) FROM calendar) - (SELECT e FROM pos WHERE segment = 'test') AS shift FROM pos"))
def _(t):
    segs = {"train": ("1995-01-02", "1998-12-31"), "valid": ("1999-01-10", "1999-12-31"), "test": ("2000-01-10", "2000-12-31")}
    return C.roll_segments(t.calendar(), segs).select("segment", "length", day("start_dt"), day("end_dt"))


@query("x23_rows_per_day", with_frames("SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS names FROM daily GROUP BY dt", "daily"))
def _(t):
    return t.daily().groupBy("dt").agg(F.count(F.lit(1)).alias("names")).select(day(), "names")


@query("x24_daily_subsample")
def _(t):
    return S.daily_subsample(t.daily().select("inst", "dt", "close"), 10, seed=7).select("inst", day(), "close")


# --- D -------------------------------------------------------------------------------
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {i} AS pos1, {j} AS pos2, corr({a}, {b}) AS corr FROM factors"
    for i, a in enumerate(FACTORS) for j, b in enumerate(FACTORS) if i < j)


@query("d01_factor_correlations", with_frames("SELECT f1, f2, round(corr, 6) AS corr FROM pr", "factors", pr=_PAIRS))
def _(t):
    return rnds(selection.pair_correlations(t.factors(), FACTORS), ["f1", "f2"], "corr")


_DAYPAIRS = " UNION ALL ".join(
    f"""SELECT dt, '{a}' AS f1, '{b}' AS f2, CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN corr({a}, {b}) END AS corr FROM factors GROUP BY dt"""
    for i, a in enumerate(FACTORS) for j, b in enumerate(FACTORS) if i < j)


@query("d02_mean_daily_correlation", with_frames("SELECT f1, f2, round(avg(corr), 6) AS corr FROM pr GROUP BY f1, f2", "factors", pr=_DAYPAIRS))
def _(t):
    return rnds(selection.mean_daily_correlation(t.factors(), FACTORS), ["f1", "f2"], "corr")


@query("d03_high_correlation_drop", with_frames("SELECT DISTINCT f2 AS factor FROM pr WHERE abs(corr) > 0.1", "factors", pr=_PAIRS))
def _(t):
    return selection.high_correlation_drop(selection.pair_correlations(t.factors(), FACTORS), 0.1)


@query("d04_select_factors", with_frames(
    """SELECT factor FROM cand WHERE factor NOT IN (SELECT f2 FROM pr WHERE abs(corr) > 0.05 AND f1 IN (SELECT factor FROM cand) AND f2 IN (SELECT factor FROM cand))""",
    "factor_long", pr=_PAIRS, **L,
    cand="""SELECT factor FROM (SELECT factor FROM factor_long GROUP BY factor HAVING avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END) < 0.2 AND stddev_samp(x) BETWEEN 0.1 AND 30)
 WHERE factor IN (SELECT factor FROM ic GROUP BY factor HAVING abs(avg(rank_ic)) >= 0.001)"""))
def _(t):
    panel = materialize(t.factors(), "panel")
    h = health.factor_health(ranking.to_long(panel, FACTORS), t.big("lineitem"))
    pairs = selection.pair_correlations(panel, FACTORS)
    ic = ranking.panel_rank_ic(panel, FACTORS, split=t.wide_days(), rows=t.size("lineitem"))
    return selection.select_factors(h, ranking.ic_summary(ic), pairs, std=(0.1, 30.0), min_ic=0.001, threshold=0.05)


@query("d05_correlation_groups", with_frames(
    "SELECT factor, min(dst) AS cluster FROM reach GROUP BY factor", "factors", pr=_PAIRS,
    ed="SELECT f1 AS a, f2 AS b FROM pr WHERE abs(corr) >= 0.05 UNION ALL SELECT f2, f1 FROM pr WHERE abs(corr) >= 0.05",
    f="SELECT unnest(['f_mom', 'f_range', 'f_vol', 'f_gap', 'f_ma5']) AS factor",
    reach="SELECT factor, factor AS dst FROM f UNION SELECT reach.factor, b FROM reach JOIN ed ON dst = a").replace("WITH ", "WITH RECURSIVE ", 1))
def _(t):
    names = t.spark.createDataFrame([(f,) for f in FACTORS], "factor string")
    return selection.link_groups(names, selection.pair_correlations(t.factors(), FACTORS), 0.05)


def series(t):
    return selection.wide_series(rank_ic(t), FACTORS)


@query("d06_pca_loadings")
def _(t):
    out = selection.pca_loadings(series(t), FACTORS)
    return out.select("factor", *[F.round(F.abs(c), 6).alias(c) for c in out.columns if c != "factor"])


@query("d07_explained_variance")
def _(t):
    return selection.explained_variance(t.factors(), FACTORS).select("component", rnd("cumulative"))


@query("d08_lasso_selection")
def _(t):
    return rnds(selection.lasso_coefficients(t.factors(), FACTORS, "label"), ["factor"], "coef")


def report(t):
    return selection.factor_report(t.factors(), FACTORS, split=t.wide_days(), big=t.big("lineitem"))


REPORT = L | {
    "hl": """SELECT factor, avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS nan_ratio, sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS zero_ratio FROM factor_long GROUP BY factor""",
    "en": """SELECT factor, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM (SELECT factor, least(floor((x - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS n
 FROM factor_long JOIN (SELECT factor, min(x) AS lo, max(x) AS hi FROM factor_long GROUP BY factor) USING (factor) WHERE x IS NOT NULL GROUP BY factor, bin) GROUP BY factor""",
    "ps": "SELECT factor, x, row_number() OVER (PARTITION BY factor ORDER BY inst, dt) AS pos FROM factor_long",
    "rn": """SELECT factor, greatest(coalesce(max(gap), 0), max(n) - coalesce(max(last), 0)) / max(n)::DOUBLE AS max_nan_streak_ratio FROM
 (SELECT factor, pos - coalesce(lag(pos) OVER (PARTITION BY factor ORDER BY pos), 0) - 1 AS gap, pos AS last FROM ps WHERE x IS NOT NULL)
 RIGHT JOIN (SELECT factor, count(*) AS n FROM factor_long GROUP BY factor) USING (factor) GROUP BY factor""",
    "sm": """SELECT factor, avg(rank_ic) AS rankic_mean, stddev_samp(rank_ic) AS rankic_std, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-6) AS rankic_ir, quantile_cont(rank_ic, 0.25) AS rankic_q25,
 quantile_cont(rank_ic, 0.75) AS rankic_q75, avg(coverage) AS coverage, avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS positive_ratio,
 avg(CASE WHEN sign(rank_ic) = sign(m) THEN 1.0::DOUBLE ELSE 0.0 END) AS sign_stability FROM ic JOIN (SELECT factor, avg(rank_ic) AS m FROM ic GROUP BY factor) USING (factor) GROUP BY factor""",
    "rp": """SELECT * REPLACE (coalesce(entropy, 0) AS entropy, coalesce(coverage, 0) AS coverage)
 FROM hl LEFT JOIN en USING (factor) LEFT JOIN rn USING (factor) LEFT JOIN sm USING (factor)""",
    "gr": """SELECT *, CASE WHEN entropy < 0.1 THEN 'HARD_DROP_ENTROPY' WHEN nan_ratio > 0.25 THEN 'HARD_DROP_NAN' WHEN zero_ratio > 0.5 THEN 'HARD_DROP_ZERO'
 WHEN coverage < 0.5 THEN 'HARD_DROP_COVERAGE' WHEN max_nan_streak_ratio > 0.3 THEN 'HARD_DROP_CONTINUITY' ELSE 'ELIGIBLE' END AS eligibility,
 CASE WHEN abs(rankic_mean) > 0.01 THEN 2 WHEN abs(rankic_mean) > 0.005 THEN 1 ELSE 0 END + CASE WHEN rankic_ir > 0.3 THEN 2 WHEN rankic_ir > 0.1 THEN 1 ELSE 0 END
 + CASE WHEN greatest(abs(rankic_q25), abs(rankic_q75)) > 0.01 THEN 1 ELSE 0 END + CASE WHEN sign_stability > 0.55 + 0.05 THEN 1 ELSE 0 END
 + CASE WHEN positive_ratio > 0.45 + 0.1 THEN 1 ELSE 0 END + CASE WHEN entropy > 0.5 THEN 1 WHEN entropy < 0.2 THEN -2 ELSE 0 END AS points FROM rp""",
    "gq": "SELECT *, CASE WHEN points >= 5 THEN 'QUALITY_A' WHEN points >= 3 THEN 'QUALITY_B' ELSE 'QUALITY_C' END AS quality FROM gr",
    # groups by zero share stand for the clusters; the score is the entropy
    "ro": """SELECT *, CASE WHEN row_number() OVER (PARTITION BY nan_ratio > 0.1 ORDER BY entropy DESC, rankic_ir DESC, factor) = 1 THEN 'CORE' ELSE 'REDUNDANT' END AS structure_role FROM gq""",
    "ad": """SELECT *, CASE WHEN eligibility <> 'ELIGIBLE' THEN 'DROP_INVALID' WHEN structure_role = 'CORE' THEN 'KEEP_CORE'
 WHEN structure_role = 'REDUNDANT' AND quality = 'QUALITY_C' THEN 'DROP_REDUNDANT' ELSE 'KEEP_OPTIONAL' END AS final_advice FROM ro""",
}


def graded(t):
    return report(t).withColumns({"eligibility": selection.eligibility(), "quality": selection.quality()})


def advised(t):
    """Report with roles: clusters and one-component loadings given as plain columns."""
    from tapeloom.session import materialize

    rep = materialize(graded(t).withColumn("cluster", (F.col("nan_ratio") > 0.1).cast("int")), "report")
    load = rep.select("factor", F.col("entropy").alias("PC1"))
    return selection.structure_roles(rep, load).withColumn("final_advice", selection.final_advice())


@query("d09_eligibility", fl("SELECT factor, eligibility FROM gr", **REPORT))
def _(t):
    return graded(t).select("factor", "eligibility")


@query("d10_quality_grade", fl("SELECT factor, points, quality FROM gq", **REPORT))
def _(t):
    return graded(t).select("factor", selection.quality_points().alias("points"), "quality")


@query("d11_main_component")
def _(t):
    load = selection.pca_loadings(series(t), FACTORS)
    clusters = t.spark.createDataFrame([(f, i % 2) for i, f in enumerate(FACTORS)], "factor string, cluster int")
    return selection.main_components(clusters, load)


@query("d12_structure_role", fl("SELECT factor, structure_role FROM ro", **REPORT))
def _(t):
    return advised(t).select("factor", "structure_role")


@query("d13_final_advice", fl("SELECT factor, final_advice FROM ad", **REPORT))
def _(t):
    return advised(t).select("factor", "final_advice")


@query("d14_advice_counts", fl("SELECT final_advice, count(*) AS n FROM ad GROUP BY final_advice", **REPORT))
def _(t):
    return advised(t).groupBy("final_advice").agg(F.count(F.lit(1)).alias("n"))
