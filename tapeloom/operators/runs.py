"""Seeds, checkpoints and run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import ratio
from tapeloom.operators.clean import lookup
from tapeloom.scale import group_limit, join_keys, per_group, quantiles, ranked_values, row_numbers
from tapeloom.session import materialize

# Weights and labels of the seed and run rankings (fixed values).
SEED_WEIGHTS = {"mean_rankicir": 0.45, "mean_icir": 0.25, "mean_rankic": 0.15, "top_rankicir_mean": 0.10, "cv_rankicir": -0.30}
OVERFIT_WEIGHT = -0.50
RANK_WEIGHTS = {
    "Valid_IC": 0.005, "Valid_ICIR": 0.005, "Valid_RIC": 0.005, "Valid_RICIR": 0.005,
    "Test_IC": 0.015, "Test_ICIR": 0.05, "Test_RIC": 0.015, "Test_RICIR": 0.05,
    "annual_return": 0.45, "max_drawdown": 0.1, "sharpe": 0.15, "information_ratio": 0.15,
}
FINAL_WEIGHTS = {
    "max_drawdown": 0.2, "annual_return": 0.1, "winning_rate_cumulant": 0.15, "Test_IC": 0.1, "Test_ICIR": 0.05,
    "sharpe": 0.1, "information_ratio": 0.05, "annual_turnover": -0.05, "volatility": -0.15,
}
# Labels and advised use of the seed classes, as published (fixed values).
SEED_CLASSES = {
    "scalpel": ("手术刀型", "仅用于 Ensemble（小权重）"),
    "workhorse": ("老黄牛型", "主力模型 / 核心仓位"),
    "swiss_knife": ("瑞士军刀型", "单模型或 Ensemble 核心"),
    "lottery": ("彩票型", "研究用途，不回测"),
    "blunt_knife": ("钝刀型", "稳定器 / 风控辅助"),
    "paper_knife": ("纸糊刀型", "淘汰"),
    "unclassified": ("未分类", "人工复核"),
}
MAXIMIZE = ["annual_return", "max_drawdown", "sharpe", "information_ratio", "alpha", "winning_rate_cumulant",
            "Test_IC", "Test_ICIR", "Test_RIC", "Test_RICIR"]
MINIMIZE = ["annual_turnover", "volatility"]


def seed_metrics(epochs: DataFrame, seed: str = "seed", epoch: str = "epoch", top_ratio: float = 0.2, split: bool = False) -> DataFrame:
    """Per seed: mean, deviation and cv of RankICIR, best-fifth mean, early and late halves and their gap.

    Positions inside a seed come from ``row_numbers``, so a seed of any length is fine.
    """
    epochs = epochs.withColumn("_e", F.col(epoch).cast("double"))
    rows = per_group(epochs, [seed], F.count(F.lit(1)).alias("_n"))
    rows = row_numbers(rows, [seed], "rankicir", epoch, "_best", split, ascending=False, source=epochs)
    rows = row_numbers(rows, [seed], "_e", epoch, "_at", split, source=epochs)
    r, mid = F.col("rankicir"), F.floor(F.col("_n") / 2)
    top = F.greatest(F.lit(1), F.floor(F.col("_n") * top_ratio))
    mean = F.avg(r)
    out = rows.groupBy(seed).agg(
        mean.alias("mean_rankicir"), F.stddev_samp(r).alias("std_rankicir"),
        (F.stddev_samp(r) / (F.abs(mean) + 1e-6)).alias("cv_rankicir"),
        F.avg("icir").alias("mean_icir"), F.avg("rankic").alias("mean_rankic"), F.avg("ic").alias("mean_ic"),
        F.avg(F.when(F.col("_best") <= top, r)).alias("top_rankicir_mean"),
        F.avg(F.when(F.col("_at") <= mid, r)).alias("early_rankicir"),
        F.avg(F.when(F.col("_at") > mid, r)).alias("late_rankicir"),
    )
    return out.withColumn("overfit_gap", F.col("early_rankicir") - F.col("late_rankicir"))


def seed_score(weights: Mapping[str, float] = SEED_WEIGHTS, overfit: float = OVERFIT_WEIGHT) -> Column:
    """Weighted sum less penalties. Pass other weights for the older form."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * w
    gap = F.when(F.col("overfit_gap") > 0, F.col("overfit_gap")).otherwise(0.0)
    return total + gap * overfit


def seed_class() -> Column:
    """Seven ordered classes of a seed; bounds are fixed values. See ``seed_class_labels``."""
    mr, cv, top, gap = (F.col(c) for c in ("mean_rankicir", "cv_rankicir", "top_rankicir_mean", "overfit_gap"))
    return (
        F.when((top > 0.7) & (cv > 0.6), "scalpel")
        .when((mr > 0.35) & (cv < 0.35) & (F.abs(gap) < 0.05), "workhorse")
        .when((mr > 0.45) & (cv < 0.5), "swiss_knife")
        .when((top > 0.8) & (mr < 0.2), "lottery")
        .when((F.abs(mr) < 0.1) & (cv < 0.4), "blunt_knife")
        .when(gap > 0.15, "paper_knife")
        .otherwise("unclassified")
    )


def seed_class_labels(c: Column) -> dict[str, Column]:
    return {
        "SeedType": lookup(c, {k: v[0] for k, v in SEED_CLASSES.items()}),
        "RecommendedUsage": lookup(c, {k: v[1] for k, v in SEED_CLASSES.items()}),
    }


def parameter_means(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means per value of each parameter in turn, all in one grouping-sets pass."""
    won = F.col("gate_excess_return") > 0
    names = {
        "annual_return_mean": F.avg("annual_return"), "max_drawdown_mean": F.avg("max_drawdown"), "sharpe_mean": F.avg("sharpe"),
        "information_ratio_mean": F.avg("information_ratio"), "q_annual_return_mean": F.avg(F.when(won, F.col("annual_return"))),
        "q_information_ratio_mean": F.avg(F.when(won, F.col("information_ratio"))),
    }
    sets = [[F.col(k)] for k in keys]
    grouped = runs.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        *[v.alias(n) for n, v in names.items()], F.grouping_id(*keys).alias("_g"))
    full = (1 << len(keys)) - 1
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    for i, k in enumerate(keys):
        hit = F.col("_g") == (full & ~(1 << (len(keys) - 1 - i)))
        which = F.when(hit, k).otherwise(which)
        value = F.when(hit, F.col(k).cast("double")).otherwise(value)
    return grouped.select(which.alias("parameter"), value.alias("value"), *names)


def bands(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, means, and shares of excess return in (0, .5), [.5, 1) and >= 1 per key."""
    e, n = F.col("excess_return"), F.count(F.lit(1))

    def share(cond):
        return F.count(F.when(cond, 1)) / n

    return runs.withColumn("excess_return", F.col("annual_return") - F.col("annual_benchmark_return")).groupBy(*keys).agg(
        n.alias("count"), F.avg("excess_return").alias("annual_return_mean"), F.avg("max_drawdown").alias("max_drawdown_mean"),
        share(e > 0).alias("excess_return_0_r"), share((e > 0) & (e < 0.5)).alias("excess_return_0_50_r"),
        share((e >= 0.5) & (e < 1)).alias("excess_return_50_100_r"), share(e >= 1).alias("excess_return_100_r"),
    )


def with_param_keys(runs: DataFrame) -> DataFrame:
    return runs.withColumns({
        "b_params": F.concat(F.lit("p"), F.concat_ws("-", "top_k", "n_drop", "hold_p")),
        "t_params": F.concat_ws("-", "D_model", "LR", "Dropout"),
    })


def return_bands(runs: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    e = F.col("annual_excess_return")
    return runs.where((e >= low) & (e < high)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def above_average(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], gate: str = "gate_excess_return") -> DataFrame:
    """Runs above the averages of the gated runs, per key, next to all runs of that key."""
    df = runs.withColumn("excess_return", F.col("annual_return") - F.col("annual_benchmark_return"))
    gated = df.where(F.col(gate) > 0)
    cond = F.col(gate) > 0
    means = gated.agg(*[F.avg(m).alias(m) for m in metrics])
    for m in metrics:
        cond = cond & (F.col(m) > means.select(m).scalar())
    e, dd = F.col("excess_return"), F.col("max_drawdown")
    # one pass: conditional aggregates give both sides; keys without a kept run drop out
    kept = df.withColumn("_keep", cond).groupBy(*keys).agg(
        F.avg(e).alias("annual_return_old"), F.avg(dd).alias("max_drawdown_old"), F.count(F.when(F.col("_keep"), 1)).alias("count"),
        F.avg(F.when(F.col("_keep"), e)).alias("annual_return_mean"), F.avg(F.when(F.col("_keep"), dd)).alias("max_drawdown_mean"))
    return kept.where(F.col("count") > 0).withColumn("annual_return_c", F.col("annual_return_mean") - F.col("annual_return_old"))


def seed_medians(runs: DataFrame, metrics: Sequence[str], seed: str = "Seed", split: bool = False) -> DataFrame:
    out = None
    for m in metrics:
        q = quantiles(runs, [seed], m, {f"{m}_median": 0.5}, split)
        out = q if out is None else out.join(q, seed)
    return out


def top_runs(runs: DataFrame, metric: str, n: int, tie: str = "Step") -> DataFrame:
    """The best ``n`` runs: a bounded top-k, no global sort."""
    return runs.orderBy(F.desc(metric), tie).limit(n)


def seed_share_of_top(runs: DataFrame, n: int, metric: str = "annual_return", seed: str = "Seed") -> DataFrame:
    return top_runs(runs, metric, n).groupBy(seed).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("seed_percent"))


def largest_per_group(runs: DataFrame, keys: Sequence[str], metric: str, n: int, tie: str = "Step") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), tie)
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def best_epochs(epochs: DataFrame, by: Sequence[str], metrics: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """Epoch of the highest value per metric, the lowest epoch on ties."""
    aggs = []
    for m in metrics:
        aggs += [F.max_by(epoch, F.struct(F.col(m), -F.col(epoch))).alias(f"best_{m}_epoch"), F.max(m).alias(f"best_{m}")]
    return epochs.groupBy(*by).agg(*aggs)


def best_checkpoints(epochs: DataFrame, metric: str, seed: str = "seed", epoch: str = "epoch") -> DataFrame:
    """One row per seed: metric descending, then epoch descending. A struct maximum, so no window."""
    rest = [c for c in epochs.columns if c not in (seed, metric, epoch)]
    best = epochs.groupBy(seed).agg(F.max(F.struct(metric, epoch, *rest)).alias("r"))
    return best.select(seed, "r.*").select(*epochs.columns)


def select_checkpoints(
    epochs: DataFrame, scope: str = "last", every_k: int = 1, seeds: Sequence[int] | None = None,
    min_epoch: int | None = None, max_epoch: int | None = None, seed: str = "seed", epoch: str = "epoch",
) -> DataFrame:
    if scope not in ("last", "all", "every"):
        raise ValueError("scope is one of last, all, every")
    if scope == "every" and every_k <= 0:
        raise ValueError("every_k must be positive")
    rows = epochs
    if seeds is not None:
        rows = rows.where(F.col(seed).isin(list(seeds)))
    if min_epoch is not None:
        rows = rows.where(F.col(epoch) >= min_epoch)
    if max_epoch is not None:
        rows = rows.where(F.col(epoch) <= max_epoch)
    if scope == "every":
        return rows.where(F.col(epoch) % every_k == 0)
    if scope == "last":
        rest = [c for c in rows.columns if c not in (seed, epoch)]
        last = rows.groupBy(seed).agg(F.max(F.struct(epoch, *rest)).alias("r"))
        return last.select(seed, "r.*").select(*epochs.columns)
    return rows


def good_runs(runs: DataFrame, split: bool = False) -> DataFrame:
    """Ten conditions against whole-table medians."""
    df = runs.withColumn("excess_return", F.col("annual_return") - F.col("annual_benchmark_return"))

    def med(c: str) -> Column:
        return quantiles(df, [], c, {"m": 0.5}, split).scalar()

    above = ["sharpe", "Test_IC", "Test_ICIR", "Test_RIC", "max_drawdown"]
    cond = F.col("excess_return") > 0.2
    for c in above:
        cond = cond & (F.col(c) > med(c))
    for c in ("volatility", "annual_turnover"):
        cond = cond & (F.col(c) < med(c))
    cond = cond & (F.col("winning_rate_cumulant") > F.greatest(F.lit(0.5), med("winning_rate_cumulant")))
    return df.where(cond & (F.col("Test_RICIR") > F.greatest(F.lit(0.3), med("Test_RICIR"))))


def _not_dominated(points: np.ndarray, against: np.ndarray, block: int = 256) -> np.ndarray:
    """Mask of ``points`` (higher is better) that no row of ``against`` dominates."""
    keep = np.ones(len(points), dtype=bool)
    for i in range(0, len(points), block):
        p = points[i : i + block, None, :]
        for j in range(0, len(against), 4096):
            a = against[None, j : j + 4096, :]
            keep[i : i + block] &= ~((a >= p).all(axis=2) & (a > p).any(axis=2)).any(axis=1)
    return keep


def pareto_front(df: DataFrame, maximize: Sequence[str], minimize: Sequence[str], key: str) -> DataFrame:
    """Rows not dominated on the given columns (no null values in them).

    Each partition first drops rows dominated inside it. The rest meet in a grid of
    block pairs: with candidates hashed into ``g`` blocks, task (i, j) tests block i
    against block j. A row stays when no pair drops it. Nothing passes through the driver,
    and ``g`` grows with the measured candidates so that a pair stays small.
    """
    cols = [*maximize, *minimize]
    sign = np.array([1.0] * len(maximize) + [-1.0] * len(minimize))
    points = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in cols])

    def local(frames):
        for pdf in frames:
            v = pdf[cols].to_numpy() * sign
            yield pdf[_not_dominated(v, v)]

    cand = materialize(points.mapInPandas(local, points.schema), "pareto")
    g = max(1, -(-cand.count() // min(20_000, group_limit(df.sparkSession))))
    # evenly filled whatever the keys are
    block = F.pmod(F.xxhash64("_key"), F.lit(g)).cast("int")
    left = cand.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    right = cand.withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))

    def dropped(a, b):
        keep = _not_dominated(a[cols].to_numpy() * sign, b[cols].to_numpy() * sign)
        return a.loc[~keep, ["_key"]]

    key_type = points.schema["_key"].dataType.simpleString()
    out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(dropped, f"_key {key_type}")
    front = cand.select("_key").join(out.distinct(), "_key", "left_anti")
    return df.join(front.withColumnRenamed("_key", key), key, "left_semi")


def composite_rank(df: DataFrame, weights: Mapping[str, float] = FINAL_WEIGHTS, split: bool = False) -> DataFrame:
    """Weighted sum of average percent ranks over the whole frame.

    There is no key to spread the rows by, so values are counted and ranked, all columns of a type at once, and the
    ranks are joined back; a window would hand every row to one task. ``split`` changes nothing any more.
    """
    types = {c: df.schema[c].dataType for c in weights}
    ranks = {}
    for kind in dict.fromkeys(types.values()):
        some = [c for c in weights if types[c] == kind]
        names = {c: str(i) for i, c in enumerate(some)}
        long = df.select(F.explode(F.array(*[F.struct(F.lit(names[c]).alias("_c"), F.col(c).alias("_v")) for c in some])).alias("_r")).select("_r.*")
        found = ranked_values(long, ["_c"], "_v")
        pct = (F.col("below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")
        found = materialize(found.select("_c", "_v", pct.alias("_pct")), "ranks")
        ranks |= {c: found.where(F.col("_c") == names[c]).select(F.col("_v").alias(c), "_pct") for c in some}
    total, columns = F.lit(0.0), df.columns
    for i, (c, w) in enumerate(weights.items()):
        df = join_keys(df, ranks[c].withColumnRenamed("_pct", f"_pct{i}"), [], "left", equal=[c])
        total = total + F.col(f"_pct{i}") * w
    return df.select(*columns, total.alias("final_score"))


def dense_rank_score(runs: DataFrame, n: int, weights: Mapping[str, float] = RANK_WEIGHTS, tie: str = "Step") -> DataFrame:
    """Weighted sum of dense ranks among the best ``n`` runs by annual return.

    Ranks run over ``n`` rows only, so the windows are small by construction.
    """
    df = top_runs(runs, "annual_return", n, tie)
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(c)) * w
    return df.withColumn("rank_score", total)


def to_hundred(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max scaling to 0..100 over the whole frame."""
    aggs = [a for c in columns for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))]
    rows = per_group(df, [], *aggs)
    out = {c: ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * 100 for c in columns}
    return rows.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi")])


def score_runs(runs: DataFrame, n: int, split: bool = False) -> DataFrame:
    """Profitable runs, ranked: 60% weighted rank, 20% seed share of the top, 20% seed medians."""
    ok = runs.where((F.col("annual_excess_return") > 0) & (F.col("sharpe") > 0) & (F.col("information_ratio") > 0))
    best = dense_rank_score(ok, n)
    med = seed_medians(ok, ["annual_return", "sharpe", "information_ratio"], split=split)
    med = med.select("Seed", (F.col("annual_return_median") + F.col("sharpe_median") + F.col("information_ratio_median")).alias("median_score"))
    rows = best.join(med, "Seed", "left").join(seed_share_of_top(ok, n), "Seed", "left")
    rows = to_hundred(rows, ["rank_score", "seed_percent", "median_score"])
    return rows.withColumn("score", F.col("rank_score") * 0.6 + F.col("seed_percent") * 0.2 + F.col("median_score") * 0.2)
