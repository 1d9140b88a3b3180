"""Null keys, null values, missing days and factors without a value."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom import scale
from tapeloom.operators import bars, calendar, selection


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture
def ragged(spark):
    data = [(None, 1, 2.0), (None, 2, 1.0), (None, 3, None), ("a", 4, 5.0), ("a", 5, None), ("a", 6, None), ("a", 7, 5.0), ("b", 8, None)]
    return spark.createDataFrame(data, "k string, id long, x double")


def test_both_ways_agree_on_null_keys_and_values(ragged):
    for up in (True, False):
        one, two = (scale.with_ranks(ragged, ["k"], "x", avg="r", dense="d", pct="p", split=s, ascending=up) for s in (False, True))
        assert rows(one, "k", "id", "r", "d", "p") == rows(two, "k", "id", "r", "d", "p")
        one, two = (scale.row_numbers(ragged, ["k"], "x", "id", "no", split=s, ascending=up) for s in (False, True))
        assert rows(one, "k", "id", "no") == rows(two, "k", "id", "no")
    one, two = (scale.quantiles(ragged, ["k"], "x", {"m": 0.5}, s) for s in (False, True))
    assert rows(one, "k", "m") == rows(two, "k", "m") == sorted([(None, 1.5), ("a", 5.0), ("b", None)], key=str)


def test_stitched_keeps_null_keys(ragged):
    cut = ragged.withColumn("piece", F.floor(F.col("id") / 2))
    one, two = (scale.stitched(cut, ["k"], ["id"], c, number="no", previous={"before": "x"}) for c in (None, "piece"))
    assert rows(one, "k", "id", "no", "before") == rows(two, "k", "id", "no", "before")
    assert two.count() == 8


def test_bars_skip_nulls(spark):
    ticks = spark.createDataFrame([("i", 1, None, 1.0), ("i", 2, 3.0, 1.0), ("i", 3, None, 1.0)], "inst string, t int, price double, v double")
    got = bars.daily_bars(ticks, ["inst"], ["t"], price="price", volume="v", amount="v").first()
    assert (got["open"], got["close"], got["num_trades"]) == (3.0, 3.0, 3)


def test_align_keeps_days_off_the_calendar(spark):
    day = lambda n: dt.date(2024, 1, n)
    cal = calendar.trade_calendar(spark.createDataFrame([(day(n),) for n in (1, 2, 4, 5)], "dt date"))
    panel = spark.createDataFrame([("i", day(1), 1.0), ("i", day(3), 3.0), ("i", day(5), 5.0)], "inst string, dt date, x double")
    assert rows(calendar.align(panel, cal), "dt", "x") == sorted([(day(1), 1.0), (day(2), None), (day(3), 3.0), (day(4), None), (day(5), 5.0)], key=str)


def test_long_chain_is_one_group(spark):
    names = [f"f{i:02d}" for i in range(70)]
    factors = spark.createDataFrame([(n,) for n in names], "factor string")
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in zip(names, names[1:], strict=False)], "f1 string, f2 string, corr double")
    assert {r["cluster"] for r in selection.link_groups(factors, pairs).collect()} == {"f00"}


def test_report_keeps_constant_and_empty_factors(spark):
    data = [(f"i{n:02d}", dt.date(2024, 1, d), float((n * 7 + d) % 11), float(n * d % 5), 1.0, None) for n in range(15) for d in (1, 2, 3)]
    panel = spark.createDataFrame(data, "inst string, dt date, label double, a double, flat double, none double")
    report = selection.factor_report(panel, ["a", "flat", "none"]).withColumn("e", selection.eligibility())
    got = {r["factor"]: (r["e"], r["entropy"], r["coverage"]) for r in report.collect()}
    assert got["flat"] == got["none"] == ("HARD_DROP_ENTROPY", 0.0, 0.0)
    assert got["a"][0] == "ELIGIBLE"
