"""Both ways of the order statistics agree with brute force, hot keys and ties included."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tapeloom import scale
from tapeloom.operators import runs


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "b", "c"], n), "x": rng.normal(size=n).round(1), "id": np.arange(n)})
    pdf.loc[pdf.index[:200], "x"] = 0.0  # a third of all rows share one value
    pdf.loc[pdf.index[::17], "x"] = np.nan
    rows = [(r.g, None if np.isnan(r.x) else float(r.x), int(r.id)) for r in pdf.itertuples()]
    return pdf, spark.createDataFrame(rows, "g string, x double, id long")


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("ascending", [False, True])
def test_ranks(frame, split, ascending):
    pdf, df = frame
    got = scale.with_ranks(df, ["g"], "x", avg="a", dense="d", pct="p", split=split, ascending=ascending).toPandas().set_index("id").sort_index()
    by = pdf.groupby("g")["x"]
    np.testing.assert_allclose(got["a"].astype(float), by.rank(ascending=ascending))
    np.testing.assert_allclose(got["d"].astype(float), by.rank(method="dense", ascending=ascending))
    np.testing.assert_allclose(got["p"].astype(float), by.rank(pct=True, ascending=ascending))


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles(frame, split, keys):
    pdf, df = frame
    got = scale.quantiles(df, keys, "x", {"lo": 0.01, "mid": 0.5, "hi": 0.77}, split).toPandas()
    groups = pdf.groupby("g")["x"] if keys else [(None, pdf["x"])]
    for k, x in groups:
        row = got[got["g"] == k].iloc[0] if keys else got.iloc[0]
        np.testing.assert_allclose([row["lo"], row["mid"], row["hi"]], x.quantile([0.01, 0.5, 0.77]))


@pytest.mark.parametrize("split", [False, True])
def test_row_numbers(frame, split):
    pdf, df = frame
    got = scale.row_numbers(df.where("x is not null"), ["g"], "x", "id", "rn", split).toPandas().set_index("id").sort_index()
    want = pdf.dropna().sort_values(["x", "id"]).groupby("g").cumcount() + 1
    assert (got["rn"] == want.sort_index()).all()


@pytest.mark.parametrize("chunk", [None, "c"])
def test_stitched(frame, chunk):
    pdf, df = frame
    rows = df.withColumn("c", F.floor(F.col("id") / 37))
    got = scale.stitched(rows, ["g"], ["id"], chunk, number="n", previous={"before": "id"}).toPandas().set_index("id").sort_index()
    by = pdf.sort_values("id").groupby("g")["id"]
    assert (got["n"] == by.cumcount() + 1).all()
    pd.testing.assert_series_equal(got["before"].astype(float).reset_index(drop=True), by.shift(1).astype(float).reset_index(drop=True), check_names=False)


def test_largest_group(frame):
    pdf, df = frame
    assert scale.largest_group(df, ["g"]) == pdf["g"].value_counts().max()
    assert scale.largest_group(df) == len(pdf)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_table_ranks_leave_no_row_window(spark):
    """Without a key a plain window would take the whole table into one task."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.integers(0, 30, 400) / 7, "b": rng.normal(size=400), "c": rng.integers(0, 9, 400)})
    df = spark.createDataFrame([(int(r.id), float(r.a), None if r.id == 5 else float(r.b), int(r.c)) for r in pdf.itertuples()], "id long, a double, b double, c long")
    pdf.loc[5, "b"] = np.nan
    out = runs.composite_rank(df, {"a": 0.5, "b": -0.25, "c": 1.0})
    assert "Window" not in plan_of(out) and out.columns == [*df.columns, "final_score"]
    got = out.toPandas().set_index("id").sort_index()["final_score"].astype(float)
    want = pdf["a"].rank(pct=True) * 0.5 + pdf["b"].rank(pct=True) * -0.25 + pdf["c"].rank(pct=True)
    np.testing.assert_allclose(got, want)
    for ranked in (scale.with_ranks(df, [], "a", avg="r"), scale.row_numbers(df, [], "a", "id", "r")):
        assert "rank(a" not in plan_of(ranked) and "_b" in plan_of(ranked)
    no = scale.row_numbers(df, [], "a", "id", "r").toPandas().set_index("id").sort_index()["r"]
    assert (no.to_numpy() == pdf.sort_values(["a", "id"]).assign(r=range(1, 401)).sort_values("id")["r"].to_numpy()).all()
