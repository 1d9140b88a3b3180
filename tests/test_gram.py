"""Co-moment matrices against pandas' pairwise correlations."""

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import gram, selection


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(900, 5))
    x = base @ rng.normal(size=(5, 60)) + rng.normal(size=(900, 60)) + rng.normal(size=60) * 50
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.3  # does not move
    x[:, 8] = np.nan  # unknown
    x[5:, 9] = np.nan
    df = pd.DataFrame(x, columns=[f"f{i}" for i in range(60)])
    df.insert(0, "dt", np.arange(900) % 30)
    return df


def frame(spark, wide):
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in wide.astype(object).values.tolist()]
    return spark.createDataFrame(rows, "dt long, " + ", ".join(f"{c} double" for c in wide.columns[1:])).repartition(7)


def same(got, want):
    assert (got is None) == bool(np.isnan(want)), (got, want)
    assert got is None or abs(got - want) < 1e-10


def test_all_pairs_in_one_read(spark, wide):
    names = list(wide.columns[1:])
    out = selection.pair_correlations(frame(spark, wide), names)
    assert out.columns == ["f1", "f2", "pos1", "pos2", "corr"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = wide[names].corr(min_periods=2)
    rows = out.collect()
    assert all(r.pos1 < r.pos2 and names[r.pos1] == r.f1 for r in rows)
    for r in rows:
        same(r["corr"], want.loc[r.f1, r.f2])
    known = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if (wide[a].notna() & wide[b].notna()).any()}
    assert {(r.f1, r.f2) for r in rows} == known
    few = selection.pair_correlations(frame(spark, wide), names[:9])  # the aggregate way gives the same
    for r in few.collect():
        same(r["corr"], want.loc[r.f1, r.f2])


def test_mean_of_days(spark, wide):
    names = list(wide.columns[1:])
    daily = {d: g[names].corr(min_periods=2) for d, g in wide.groupby("dt")}
    rows = selection.mean_daily_correlation(frame(spark, wide), names).collect()
    assert len(rows) > 1000
    for r in rows:
        values = [c.loc[r.f1, r.f2] for c in daily.values() if not np.isnan(c.loc[r.f1, r.f2])]
        same(r["corr"], np.mean(values) if values else np.nan)


def test_merging_parts_is_the_whole():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 4)) + 1e4
    whole, parts = gram.Gram(4), gram.Gram(4)
    whole.add(x)
    for k in range(0, 100, 9):
        parts.add(x[k : k + 9])
    for k, v in whole.pairs().items():
        assert np.allclose(v, parts.pairs()[k], rtol=1e-12, atol=1e-9)
    assert not gram.Gram(3).pairs()["n"].size
