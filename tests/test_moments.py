"""Running-total moments and shared lists against the plain window operators."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import features as X
from tapeloom.functions import rolling as W

WINDOWS = (2, 5, 20, 60, 64, 70)


@pytest.fixture(scope="module")
def series(spark):
    """A trend far from its start, gaps, constant stretches, zeros, an instrument of nulls, one of a single row."""
    rng = random.Random(2)
    rows = []
    for inst in ("trend", "gaps", "still", "none", "one"):
        price, n = 10.0, {"one": 1}.get(inst, 300)
        for i in range(n):
            price = price * 1.01 + rng.gauss(0, 0.3) if inst == "trend" else max(1.0, price + rng.gauss(0, 0.5))
            if inst == "still" and (40 <= i < 130 or i % 7 == 0):
                price = 12.3
            x = None if inst == "none" or (inst == "gaps" and (rng.random() < 0.3 or 100 <= i < 180)) else price
            y = None if rng.random() < 0.1 else rng.gauss(0, 1) + i / 50
            z = 0.0 if inst == "still" and 40 <= i < 130 else abs(rng.gauss(0, 1))
            rows.append((inst, date(2020, 1, 1) + timedelta(i), x, y, z))
    df = spark.createDataFrame(rows, "inst string, dt date, x double, y double, z double")
    return X.by_instrument(df).withColumn("_t", W.position()).cache()


def both(series, d):
    s = X.Stage()
    line = s.line("x", d)
    made = {"mean": s.mean("x", d), "std": s.std("x", d), "sum": s.total("z", d), "corr": s.corr("x", "y", d), "rank": s.rank("x", d),
            "q80": s.quantile("x", d, 0.8), "q20": s.quantile("x", d, 0.2), **line}
    plain = {"mean": W.mean("x", d), "std": W.std("x", d), "sum": W.total("z", d), "corr": W.corr("x", "y", d), "rank": W.rank("x", d),
             "q80": W.quantile("x", d, 0.8), "q20": W.quantile("x", d, 0.2), "slope": W.slope("x", d, "_t"), "rsquare": W.rsquare("x", d, "_t"), "resi": W.resi("x", d, "_t")}
    a = {tuple(r[:2]): r for r in X.build(series, made, s).collect()}
    b = {tuple(r[:2]): r for r in series.select("inst", "dt", *[c.alias(n) for n, c in plain.items()]).collect()}
    return a, b, plain


@pytest.mark.parametrize("d", WINDOWS)
def test_same_as_plain_windows(series, d):
    a, b, names = both(series, d)
    assert a.keys() == b.keys()
    for key in a:
        for n in names:
            got, want = a[key][n], b[key][n]
            if n == "corr" and (got is None or want is None):
                # a pair that hardly moves may round to a standstill on either side
                assert got is None and want is None, (key, n, got, want)
                continue
            assert (got is None) == (want is None), (key, n, got, want)
            # digits go where a window hardly moves far from the instrument's mean
            lost = 1e-15 * (200 / b[key]["std"]) ** 2 if b[key]["std"] else 0.0
            assert got is None or math.isclose(got, want, rel_tol=1e-9 + lost, abs_tol=(1e-9 + lost) * max(1.0, abs(b[key]["mean"] or 0))), (key, n, got, want)


def test_standstill_is_exact(series):
    a, _, _ = both(series, 20)
    still = [a[("still", date(2020, 1, 1) + timedelta(i))] for i in range(65, 130)]
    assert all(r["std"] == 0.0 and r["slope"] == 0.0 and r["corr"] is None and r["sum"] == 0.0 for r in still)


def test_not_finite_is_unknown(spark):
    rows = [("a", date(2020, 1, 1) + timedelta(i), v) for i, v in enumerate([1.0, float("nan"), 3.0, float("inf"), 5.0])]
    df = X.by_instrument(spark.createDataFrame(rows, "inst string, dt date, x double")).withColumn("_t", W.position())
    s = X.Stage()
    got = X.build(df, {"m": s.mean("x", 3), "n": s.total("x", 3)}, s).orderBy("dt").collect()
    assert [r.m for r in got] == [1.0, 1.0, 2.0, 3.0, 4.0] and [r.n for r in got] == [1.0, 1.0, 4.0, 3.0, 8.0]


def test_one_exchange_for_all_windows(series):
    s = X.Stage()
    fam = {f"m{d}": s.mean("x", d) + s.std("x", d) + s.corr("x", "y", d) for d in (5, 10, 20, 30, 60)}
    plan = X.build(series, fam, s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") <= 1 and F is not None
