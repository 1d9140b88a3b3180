"""Rolling extremes by batches equal the sliding frames, across batch borders, gaps and odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import features as X
from tapeloom.functions import rolling as W

ODD = [None, None, float("nan"), float("inf"), float("-inf"), 0.0, -1.0, 1.0]


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("odd", [False, True])
def test_extremes_equal_sliding_frames(spark, small_batches, odd):
    rng = np.random.default_rng(4)
    rows = []
    for inst, n in enumerate((1, 2, 40, 3, 61, 8)):
        for dt in rng.choice(200, n, replace=False):
            x = ODD[rng.integers(len(ODD))] if odd else (None if rng.random() < 0.3 else float(rng.integers(0, 6)))
            rows.append((inst, int(dt), x))
    df = spark.createDataFrame(rows, "inst int, dt int, x double").repartition(3, "inst").withColumn("_t", W.position())
    s, want = X.Stage(), {}
    fam = {}
    for d in (1, 2, 5, 20):
        finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
        fam |= {f"max{d}": s.highest("x", d), f"min{d}": s.lowest("x", d), f"hi{d}": s.highest_at("x", d), f"lo{d}": s.lowest_at("x", d),
                f"q{d}": s.quantile("x", d, 0.8), f"r{d}": s.quantile("x", d, 0.25)}
        want |= {f"max{d}": W.highest("x", d), f"min{d}": W.lowest("x", d), f"hi{d}": W.idx_max("x", d, "_t"), f"lo{d}": W.idx_min("x", d, "_t"),
                 f"q{d}": W.quantile(finite, d, 0.8), f"r{d}": W.quantile(finite, d, 0.25)}
    got = X.build(df, fam, s)
    # no sliding frame is left, and the order of ``_t`` is used as it is
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1
    text = [F.format_string("%.9f", F.col(n) + 0.0).alias(n) for n in fam]
    key = ["inst", "dt"]
    a = {tuple(r)[:2]: tuple(r)[2:] for r in got.select(*key, *text).collect()}
    b = {tuple(r)[:2]: tuple(r)[2:] for r in df.select(*key, *[c.alias(n) for n, c in want.items()]).select(*key, *text).collect()}
    assert a == b and len(a) == len(rows)
