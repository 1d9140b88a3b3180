"""Factor redundancy, structure and advice.

Tables here have one row per factor or factor pair: at most some hundred factors.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import correlation, ratio
from tapeloom.operators import gram
from tapeloom.session import materialize

# Default limits of the factor report (fixed values).
LIMITS = {
    "nan": 0.25, "zero": 0.5, "coverage": 0.5, "null_run": 0.3, "entropy": 0.1,
    "rankic_mean": 0.005, "rankic_ir": 0.1, "tail": 0.01, "sign": 0.55, "sign_bonus": 0.05,
    "positive": 0.45, "positive_bonus": 0.1, "mean_high": 2, "mean_low": 1, "ir_high": 3, "ir_low": 1,
    "entropy_high": 5, "entropy_low": 2, "grade_a": 5, "grade_b": 3, "link": 0.7, "keep": 1,
}


#: Pairs of columns up to which their correlations are columns of one aggregate.
AGGREGATE_PAIRS = 400


def pair_correlations(df: DataFrame, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., f1, f2, pos1, pos2, corr) for all pairs in column order, from one read and partial sums only.

    A few pairs are columns of one aggregate. More of them come from co-moment matrices (``gram``), which for now have no ``by``.
    """
    at = {f: i for i, f in enumerate(factors)}
    pairs = list(combinations(factors, 2))
    if len(pairs) > AGGREGATE_PAIRS and not by:
        return gram.correlations(df, factors).drop("n")
    parts = []
    for i in range(0, len(pairs), AGGREGATE_PAIRS):
        some = pairs[i : i + AGGREGATE_PAIRS]
        wide = df.groupBy(*by).agg(*[correlation(a, b).alias(f"c{at[a]}_{at[b]}") for a, b in some])
        rows = F.explode(F.array(*[
            F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.lit(at[a]).alias("pos1"), F.lit(at[b]).alias("pos2"),
                     F.col(f"c{at[a]}_{at[b]}").alias("corr")) for a, b in some
        ]))
        parts.append(wide.select(*by, rows.alias("r")).select(*by, "r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_daily_correlation(df: DataFrame, factors: Sequence[str], dt: str = "dt") -> DataFrame:
    """(f1, f2, corr): mean over days of the day's correlation."""
    if len(factors) * (len(factors) - 1) // 2 > AGGREGATE_PAIRS:
        return gram.mean_correlations(df, factors, dt).select("f1", "f2", "corr")
    return pair_correlations(df, factors, [dt]).groupBy("f1", "f2").agg(F.avg("corr").alias("corr"))


def high_correlation_drop(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Factors with any earlier factor above the threshold."""
    return pairs.where(F.abs("corr") > threshold).select(F.col("f2").alias("factor")).distinct()


def select_factors(
    health: DataFrame, ic: DataFrame, pairs: DataFrame, nan: float = 0.2, std: tuple[float, float] = (0.3, 3.0),
    min_ic: float = 0.01, threshold: float = 0.85,
) -> DataFrame:
    """Health, then absolute mean IC, then correlation among those left."""
    ok = health.where((F.col("nan_ratio") < nan) & F.col("std").between(*std)).select("factor")
    ok = ok.join(ic.where(F.abs("ic_mean") >= min_ic).select("factor"), "factor", "left_semi")
    left = pairs.join(ok.withColumnRenamed("factor", "f1"), "f1", "left_semi").join(ok.withColumnRenamed("factor", "f2"), "f2", "left_semi")
    return ok.join(high_correlation_drop(left, threshold), "factor", "left_anti")


def link_groups(factors: DataFrame, pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(factor, cluster): connected components of the links with |corr| >= threshold.

    The studied report merges by average linkage, which is serial; components can be
    larger than its groups. The cluster is named by its first factor. Each round takes the
    smallest label among neighbours and the label of the own label, so rounds grow with the logarithm of
    the longest chain; each is written out, so lineage stays short. Loops until nothing changes.
    """
    edges = pairs.where(F.abs("corr") >= threshold).select("f1", "f2")
    edges = materialize(edges.unionByName(edges.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"))).distinct(), "edges")
    labels = materialize(factors.select("factor", F.col("factor").alias("cluster")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("factor", "f2"), "f2").groupBy("f1").agg(F.min("cluster").alias("_near"))
        jump = labels.select(F.col("factor").alias("cluster"), F.col("cluster").alias("_far"))
        new = labels.join(near.withColumnRenamed("f1", "factor"), "factor", "left").join(jump, "cluster", "left").select(
            "factor", "cluster", F.least("cluster", "_near", "_far").alias("_new"))
        new = materialize(new, "labels")
        changed = new.where(F.col("_new") != F.col("cluster")).limit(1).count()
        labels = new.select("factor", F.col("_new").alias("cluster"))
        if not changed:
            return labels


def wide_series(daily: DataFrame, factors: Sequence[str], value: str = "rank_ic", dt: str = "dt") -> DataFrame:
    """Long daily series to one column per factor, with the column list given (no extra pass)."""
    return daily.groupBy(dt).pivot("factor", list(factors)).agg(F.first(value))


def pca_loadings(wide: DataFrame, factors: Sequence[str], k: int = 5) -> DataFrame:
    """(factor, PC1..PCk) of the day x factor matrix with nulls as 0.

    Spark's PCA does not centre; its covariance does, so the components are the same.
    Signs are arbitrary.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import array_to_vector  # noqa: F401

    k = min(k, len(factors))
    rows = VectorAssembler(inputCols=list(factors), outputCol="v").transform(wide.fillna(0.0, list(factors)))
    matrix = PCA(k=k, inputCol="v", outputCol="p").fit(rows).pc.toArray()
    data = [(f, *[float(x) for x in matrix[i]]) for i, f in enumerate(factors)]
    schema = "factor string, " + ", ".join(f"PC{j + 1} double" for j in range(k))
    return wide.sparkSession.createDataFrame(data, schema)


def explained_variance(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(component, cumulative) after standard scaling, rows with a null left out."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(factors), outputCol="v").transform(df.na.drop(subset=list(factors)))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(rows).transform(rows)
    ratio_ = PCA(k=len(factors), inputCol="s", outputCol="p").fit(scaled).explainedVariance.toArray()
    total, data = 0.0, []
    for i, r in enumerate(ratio_):
        total += float(r)
        data.append((i + 1, total))
    return df.sparkSession.createDataFrame(data, "component int, cumulative double")


def lasso_coefficients(df: DataFrame, factors: Sequence[str], label: str, alpha: float = 0.001) -> DataFrame:
    """(factor, coef) of an L1 regression: squared error / 2n + alpha * |w|."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=list(factors), outputCol="v").transform(df.na.drop(subset=[*factors, label]))
    model = LinearRegression(
        featuresCol="v", labelCol=label, regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=200, tol=1e-9
    ).fit(rows)
    data = [(f, float(c)) for f, c in zip(factors, model.coefficients)]
    return df.sparkSession.createDataFrame(data, "factor string, coef double")


def eligibility(limits: dict = LIMITS):
    """The first failed health rule, or ELIGIBLE."""
    c = F.col
    return (
        F.when(c("entropy") < limits["entropy"], "HARD_DROP_ENTROPY")
        .when(c("nan_ratio") > limits["nan"], "HARD_DROP_NAN")
        .when(c("zero_ratio") > limits["zero"], "HARD_DROP_ZERO")
        .when(c("coverage") < limits["coverage"], "HARD_DROP_COVERAGE")
        .when(c("max_nan_streak_ratio") > limits["null_run"], "HARD_DROP_CONTINUITY")
        .otherwise("ELIGIBLE")
    )


def quality_points(limits: dict = LIMITS):
    m = limits
    mean, ir, ent = F.abs("rankic_mean"), F.col("rankic_ir"), F.col("entropy")
    tail = F.greatest(F.abs("rankic_q25"), F.abs("rankic_q75"))

    def step(cond):
        return F.when(cond, 1).otherwise(0)

    return (
        F.when(mean > m["rankic_mean"] * m["mean_high"], 2).when(mean > m["rankic_mean"] * m["mean_low"], 1).otherwise(0)
        + F.when(ir > m["rankic_ir"] * m["ir_high"], 2).when(ir > m["rankic_ir"] * m["ir_low"], 1).otherwise(0)
        + step(tail > m["tail"])
        + step(F.col("sign_stability") > m["sign"] + m["sign_bonus"])
        + step(F.col("positive_ratio") > m["positive"] + m["positive_bonus"])
        + F.when(ent > m["entropy"] * m["entropy_high"], 1).when(ent < m["entropy"] * m["entropy_low"], -2).otherwise(0)
    )


def quality(limits: dict = LIMITS):
    p = quality_points(limits)
    return F.when(p >= limits["grade_a"], "QUALITY_A").when(p >= limits["grade_b"], "QUALITY_B").otherwise("QUALITY_C")


def main_components(report: DataFrame, loadings: DataFrame) -> DataFrame:
    """(cluster, cluster_main_pc): the component with the largest mean absolute loading; earliest on ties."""
    pcs = [c for c in loadings.columns if c != "factor"]
    long = loadings.unpivot(["factor"], pcs, "pc", "w").withColumn("_i", F.substring("pc", 3, 9).cast("int"))
    mean = report.select("factor", "cluster").join(long, "factor").groupBy("cluster", "pc", "_i").agg(F.avg(F.abs("w")).alias("w"))
    return mean.groupBy("cluster").agg(F.max_by("pc", F.struct(F.col("w"), -F.col("_i"))).alias("cluster_main_pc"))


def structure_roles(report: DataFrame, loadings: DataFrame, keep: int = 1) -> DataFrame:
    """CORE, OPTIONAL or REDUNDANT by (loading on the group's main component, IR) inside the group."""
    pcs = [c for c in loadings.columns if c != "factor"]
    long = loadings.unpivot(["factor"], pcs, "cluster_main_pc", "_w")
    rows = report.join(main_components(report, loadings), "cluster", "left").join(long, ["factor", "cluster_main_pc"], "left")
    rows = rows.withColumn("pca_score", F.coalesce(F.abs("_w"), F.lit(0.0))).drop("_w")
    w = Window.partitionBy("cluster").orderBy(F.desc("pca_score"), F.desc("rankic_ir"), "factor")
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    n = F.row_number().over(w)
    optional = F.least(F.lit(keep), size - keep) if keep > 1 else F.lit(0)
    role = F.when(n <= keep, "CORE").when(n <= keep + optional, "OPTIONAL").otherwise("REDUNDANT")
    return rows.withColumn("structure_role", role)


def final_advice():
    role = F.col("structure_role")
    return (
        F.when(F.col("eligibility") != "ELIGIBLE", "DROP_INVALID")
        .when(role == "CORE", "KEEP_CORE")
        .when((role == "REDUNDANT") & (F.col("quality") == "QUALITY_C"), "DROP_REDUNDANT")
        .otherwise("KEEP_OPTIONAL")
    )


def sorted_report(report: DataFrame) -> DataFrame:
    return report.orderBy("final_advice", "quality", F.desc("rankic_ir"), "factor")


def factor_report(panel: DataFrame, factors: Sequence[str], min_names: int = 10, split: bool = False, big: bool = False) -> DataFrame:
    """The whole report of one factor panel (inst, dt, label, factors): health, rank IC, stability.

    The panel is written out first, with the null gaps that its order by instrument gives: a few aggregates read it, and
    none should build the rolling features or that order again. A factor without a known value or without a day of rank
    correlation stays: entropy and coverage 0, null statistics.
    """
    from tapeloom.operators import health, ranking

    factors = list(factors)
    panel = materialize(health.with_null_gaps(panel.select("inst", "dt", "label", *factors), factors), "panel")
    base = health.panel_health(panel, factors, split=big)
    daily = materialize(ranking.panel_rank_ic(panel, factors, min_names=min_names, split=split, rows=panel.count()), "rankic")
    for p in (health.longest_null_run(panel, factors, split=big), ranking.rank_ic_summary(daily)):
        base = base.join(F.broadcast(p), "factor", "left")
    return base.fillna(0.0, ["entropy", "coverage"])
