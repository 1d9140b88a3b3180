"""All rolling figures in one pass: batch borders, odd values, and means of many columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import features as X
from tapeloom.functions import rolling as W
from tapeloom.functions.batches import means


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_moments_across_batches(spark, small_batches):
    rng = np.random.default_rng(5)
    rows = [(inst, int(dt), None if rng.random() < 0.3 else float(rng.integers(1, 5)), float(rng.normal()), int(rng.integers(0, 3)))
            for inst, n in enumerate((1, 2, 40, 3, 61, 8)) for dt in rng.choice(200, n, replace=False)]
    df = spark.createDataFrame(rows, "inst int, dt int, x double, y double, k int").repartition(3, "inst").withColumn("_t", W.position())
    s = X.Stage()
    fam = {"mean": s.mean("x", 5), "std": s.std("x", 5), "sum": s.total("k", 20), "corr": s.corr("x", "y", 20), "rank": s.rank("x", 20), "lag": s.ref("x", 3),
           "slope": s.line("y", 5)["slope"], "resi": s.line("y", 5)["resi"], "high": s.highest("k", 5), "k": F.col("k")}
    plain = {"mean": W.mean("x", 5), "std": W.std("x", 5), "sum": W.total("k", 20), "corr": W.corr("x", "y", 20), "rank": W.rank("x", 20), "lag": W.ref("x", 3),
             "slope": W.slope("y", 5, "_t"), "resi": W.resi("y", 5, "_t"), "high": W.highest("k", 5), "k": F.col("k")}
    a = {tuple(r[:2]): r for r in X.build(df, fam, s).collect()}
    b = {tuple(r[:2]): r for r in df.select("inst", "dt", *[c.alias(n) for n, c in plain.items()]).collect()}
    assert a.keys() == b.keys() and len(a) == len(rows)
    for key in a:
        assert all(close(a[key][n], b[key][n]) for n in fam), (key, a[key], b[key])


def test_means_of_many_columns(spark, small_batches):
    rng = np.random.default_rng(6)
    rows = [(None if i % 11 == 0 else i // 9 % 4, *[None if rng.random() < 0.4 else float(rng.normal()) for _ in range(3)], None) for i in range(100)]
    df = spark.createDataFrame(rows, "inst int, a double, b double, c double, none double").repartition(3)
    names = ["a", "b", "c", "none"]
    got = {r.inst: r for r in means(df, ["inst"], names).collect()}
    want = {r.inst: r for r in df.groupBy("inst").agg(*[e for n in names for e in (F.avg(n).alias(n), F.count(n).alias(f"n_{n}"))]).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert all(close(got[k][n], want[k][n]) and got[k][f"n_{n}"] == want[k][f"n_{n}"] for n in names)


def test_futures_set_has_one_pass(spark):
    """No window is left but the row number, and the features meet no aggregate row by row."""
    cols = ["open", "high", "low", "close", "volume", "amount", "vwap", "open_interest", "roll_flag", "roll_count"]
    df = spark.range(100).select(F.lit(1).alias("inst"), F.col("id").alias("dt"), *[(F.col("id") + 1.0).alias(c) for c in cols])
    s = X.Stage()
    fam = X.futures_set(s)
    out = means(X.build(X.prepare(df), fam, s), ["inst"], list(fam))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("MapInArrow") == 2
    row = out.first()
    assert row["n_ROC_60"] == 40 and row["n_MA_5"] == 100
