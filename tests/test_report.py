"""The factor report's steps: one meeting of a day's rows, quantiles from brackets, null runs from the ends of instruments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import scale
from tapeloom.operators import health, ranking, selection

FACTORS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for inst in range(25):
        for dt in range(30):
            if rng.random() < 0.15:
                continue
            x = [None if rng.random() < p else float(round(v, 1)) for p, v in zip((0.1, 0.5, 0.02), rng.normal(size=3))]
            rows.append((inst, dt, None if dt > 27 else float(rng.integers(0, 9)), x[0], x[1] if inst % 5 else None, x[2], 1.0 if inst < 20 else None))
    rows.append((99, None, 1.0, 1.0, 1.0, float("nan"), None))
    rows.append((3, 31, 2.0, float("nan"), 1.0, float("nan"), None))
    return spark.createDataFrame(rows, "inst long, dt int, label double, a double, b double, c double, d double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_wide_rank_ic_is_the_long_one(panel, split):
    want = ranking.daily_rank_ic(ranking.to_long(panel, FACTORS), min_names=5)
    assert want.count() > 60
    got = ranking.panel_rank_ic(panel, FACTORS, min_names=5)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    key = lambda df: df.toPandas().sort_values(["dt", "factor"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want), rtol=0, atol=2e-12)
    pd.testing.assert_frame_equal(key(ranking.panel_rank_ic(panel, FACTORS, min_names=5, split=True)), key(want), rtol=0, atol=2e-12)
    # the long form shuffles and sorts the panel once per factor and side
    fresh = ranking.panel_rank_ic(panel, FACTORS, min_names=5)
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_quantiles_do_not_rank_all_values(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.arange(60_000) % 3, "x": np.where(np.arange(60_000) % 3 == 2, rng.integers(0, 4, 60_000), rng.normal(size=60_000))})
    df = spark.createDataFrame(pdf).repartition(7)

    def no(*a, **k):
        raise AssertionError("ranked every value")

    monkeypatch.setattr(scale, "ranked_values", no)
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.99, "least": 0.0, "most": 1.0}
    got = scale.quantiles(df, ["g"], "x", probs, split=True).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got[list(probs)].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_quantiles_rank_when_a_bracket_misses(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(scale, "_bracketed", lambda df, keys, x, probs: df.groupBy(*keys).agg(*[F.lit(None).cast("double").alias(p) for p in probs]))
    got = rows_of(scale.quantiles(df, ["g"], "x", {"m": 0.5}, split=True))
    assert got == [(0, 2499.0), (1, 2500.0)]


@pytest.mark.parametrize("big", [False, True])
def test_null_runs_within_and_across_instruments(panel, split, big, monkeypatch):
    monkeypatch.setattr(health, "PIECE", 4, raising=False)
    panel = panel.where("dt IS NOT NULL")
    pdf = panel.toPandas().sort_values(["inst", "dt"])
    got = {r.factor: r.max_nan_streak_ratio for r in health.longest_null_run(panel, FACTORS, split=big).collect()}
    known = {(r.inst, r.dt): [getattr(r, f) is not None for f in FACTORS] for r in panel.collect()}
    for i, f in enumerate(FACTORS):
        longest = run = 0
        for k in zip(pdf["inst"], pdf["dt"]):
            run = 0 if known[k][i] else run + 1
            longest = max(longest, run)
        assert got[f] == pytest.approx(longest / len(pdf))
    plan = health.longest_null_run(panel, FACTORS, split=big)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # every known value would be a row


def test_panel_health_is_its_parts(panel):
    p = panel.drop("label").withColumn("none", F.lit(None).cast("double"))
    names = ["a", "b", "d", "none"]
    long = p.unpivot(["inst", "dt"], names, "factor", "x")
    x = F.col("x")
    want = long.where("NOT isnan(x) OR x IS NULL").groupBy("factor").agg(F.avg(x.isNull().cast("double")).alias("nan_ratio"))
    assert {r.factor for r in want.collect()} == set(names)
    clean = p.where("a IS NULL OR NOT isnan(a)")
    long = clean.unpivot(["inst", "dt"], names, "factor", "x")
    for big in (False, True):
        got = health.panel_health(clean, names, split=big).toPandas().set_index("factor").astype(float)
        for part in (health.entropy(long), health.shape(long), health.extreme_share(long, split=big)):
            for r in part.toPandas().set_index("factor").astype(float).itertuples():
                for c, v in r._asdict().items():
                    if c != "Index":
                        assert got.loc[r.Index, c] == pytest.approx(v, abs=1e-9), (r.Index, c)
        assert got.loc["none", "nan_ratio"] == 1 and got.loc["d", "zero_ratio"] == 0 and np.isnan(got.loc["none", "entropy"])


def test_report_keeps_every_factor(panel, split):
    for big in (False, True):
        rep = selection.factor_report(panel.where("dt IS NOT NULL"), FACTORS, min_names=5, big=big)
        assert {r.factor for r in rep.collect()} == set(FACTORS)
