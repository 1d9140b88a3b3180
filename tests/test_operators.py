"""Hand-made frames with literal results, above all at the edges."""

import datetime as dt
import math

import pytest

from pyspark.sql import functions as F
from tapeloom.functions import features as X
from tapeloom.functions import rolling as W
from tapeloom.operators import bars, book, calendar, clean, crosssection, health, ranking, runs, selection, spans
from tapeloom.sources import readers, sinks
from tapeloom.session import fresh_path, shared_dir


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def panel(spark, values, inst="a"):
    return spark.createDataFrame([(inst, d(i), v) for i, v in enumerate(values)], "inst string, dt date, x double")


def col(df, c="v"):
    return [r[c] for r in df.orderBy("dt").collect()]


def test_rolling_edges(spark):
    p = panel(spark, [1.0, 3.0, 3.0, 2.0]).withColumn("t", W.position())
    out = p.select("dt", W.mean("x", 2).alias("m"), W.std("x", 3).alias("s"), W.rank("x", 3).alias("r"), W.idx_max("x", 3).alias("i"),
                   W.slope("x", 3).alias("b"), W.quantile("x", 3, 0.5).alias("q"))
    assert col(out, "m") == [1.0, 2.0, 3.0, 2.5]
    assert col(out, "s")[0] is None and math.isclose(col(out, "s")[1], math.sqrt(2))
    assert [round(v, 6) for v in col(out, "r")] == [1.0, 1.0, round((1 + 1.5) / 3, 6), round(1 / 3, 6)]
    assert col(out, "i") == [1.0, 2.0, 2.0, 1.0]  # the earliest of two equal highs
    assert col(out, "b")[0] is None and math.isclose(col(out, "b")[2], 1.0)
    assert col(out, "q") == [1.0, 2.0, 3.0, 3.0]


def test_constant_and_null_columns(spark):
    p = panel(spark, [2.0, 2.0, 2.0, None]).withColumn("t", W.position())
    out = p.select("dt", W.corr("x", "t", 3).alias("c"), W.rank("x", 3).alias("r"), W.greater("x", F.lit(0.0)).alias("g"), W.std("x", 3).alias("s"))
    assert col(out, "c") == [None, None, None, None]
    assert col(out, "r")[3] is None and col(out, "g")[3] is None
    assert col(out, "s") == [None, 0.0, 0.0, 0.0]


def test_no_future_rows_but_in_labels(spark):
    base = dict(open=10.0, high=12.0, low=9.0, close=11.0, volume=100.0, amount=1000.0, vwap=10.5, open_interest=5.0, roll_flag=0.0, roll_count=0.0)

    def make(n, last):
        rows = [("a", d(i), *[v + i % 5 + (last if i == n - 1 else 0) for v in base.values()]) for i in range(n)]
        return spark.createDataFrame(rows, "inst string, dt date, " + ", ".join(f"{k} double" for k in base))

    def run(df):
        s = X.Stage()
        fam = X.futures_set(s)
        return fam, X.build(X.prepare(df), fam, s).orderBy("dt").collect()

    fam, one = run(make(12, 0.0))
    assert len(fam) == 163
    _, two = run(make(12, 50.0))
    assert one[:-1] == two[:-1] and one[-1] != two[-1]


def test_intraday_small_groups(spark):
    t = dt.datetime(2024, 1, 1, 9, 30)
    rows = [("one", t, 10.0, 11.0, 9.0, 10.0, 5.0, 50.0, 1.0)]
    rows += [("two", t + dt.timedelta(minutes=i), 10.0, 11.0, 9.0, 10.0 + i % 2, 5.0, 50.0, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "inst string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double, num_trades double")
    df = df.withColumn("day", F.to_date("datetime"))
    for minutes in (None, 2):
        got = {r["inst"]: r for r in bars.intraday_features(df, chunk_minutes=minutes).collect()}
        assert got["one"]["d_vol"] is None and got["one"]["d_corr"] is None and got["one"]["d_intraday_trend"] is None
        assert got["one"]["d_realized_vol"] == 0 and got["one"]["d_cntp"] == 0
        assert math.isclose(got["two"]["d_cntp"], 3 / 6) and math.isclose(got["two"]["d_cntn"], 2 / 6)
        assert got["two"]["d_vol_skew"] == 0 and got["two"]["d_high_time_frac"] == 0


def test_chunked_bars_equal_plain(spark):
    from tapeloom.plans.frames import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    key = ["day", "inst"]
    a = bars.intraday_features(t.bars()).orderBy(*key).collect()
    b = bars.intraday_features(t.bars(), chunk_minutes=90).orderBy(*key).collect()
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y):
            assert u == v or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)


def test_calendar_gaps_and_rejoin(spark):
    rows = [("a", d(0), 1.0), ("a", d(3), 4.0), ("b", d(1), 9.0), ("b", d(2), None)]
    p = spark.createDataFrame(rows, "inst string, dt date, x double")
    cal = calendar.trade_calendar(p)
    got = [(r["inst"], r["dt"], r["x"]) for r in calendar.align(p, cal).orderBy("inst", "dt").collect()]
    assert got == [("a", d(0), 1.0), ("a", d(1), None), ("a", d(2), None), ("a", d(3), 4.0), ("b", d(1), 9.0), ("b", d(2), None)]
    filled = clean.fill_both_ways(calendar.align(p, cal), ["x"], default=0.0).orderBy("inst", "dt")
    assert [r["x"] for r in filled.collect()] == [1.0, 1.0, 1.0, 4.0, 9.0, 9.0]
    s = spans.unbroken_spans(p, ["inst"]).orderBy("inst", "start_date").collect()
    assert [(r["inst"], r["start_date"], r["end_date"]) for r in s] == [("a", d(0), d(0)), ("a", d(3), d(3)), ("b", d(1), d(2))]
    states = {(r["inst"], r["dt"]): r["state"] for r in spans.day_over_day(p, ["inst"], cal).collect()}
    assert states[("a", d(1))] == "exit" and states[("a", d(3))] == "enter" and states[("b", d(2))] == "hold"


def test_single_day_history_has_a_span(spark):
    p = spark.createDataFrame([("a", d(0))], "inst string, dt date")
    assert spans.unbroken_spans(p, ["inst"]).count() == 1


def test_base_close(spark):
    p = spark.createDataFrame([("few", d(i), v) for i, v in enumerate([-1.0, 0.0, 7.0, 9.0])] + [("none", d(0), -3.0)]
                              + [("many", d(i), float(i + 1)) for i in range(40)], "inst string, dt date, close double")
    want = {"few": 7.0, "none": 1.0, "many": 15.5}
    assert {r["inst"]: r["base_close"] for r in bars.base_close(p).collect()} == want
    assert {r["inst"]: r["base_close"] for r in bars.with_base_close(p).collect()} == want


@pytest.mark.parametrize("n,kept", [(39, 39), (40, 38)])
@pytest.mark.parametrize("split", [False, True])
def test_drop_extreme_edges(spark, n, kept, split):
    df = spark.createDataFrame([(d(0), i, float(i % 7)) for i in range(n)], "dt date, inst long, label double")
    assert crosssection.drop_extreme(df, "label", split=split).count() == kept


def test_rank_ic_is_unchanged_by_a_monotone_map(spark):
    rows = [(d(k), i, float((i * 7 + k) % 13), float((i * 5 + k) % 11)) for k in range(4) for i in range(15)]
    p = spark.createDataFrame(rows, "dt date, inst long, f double, label double")

    def ic(df):
        return [round(r["rank_ic"], 10) for r in ranking.daily_rank_ic(ranking.to_long(df, ["f"])).orderBy("dt").collect()]

    assert ic(p) == ic(p.withColumn("f", F.exp("f"))) and len(ic(p)) == 4
    assert ranking.daily_rank_ic(ranking.to_long(p, ["f"]), min_names=16).count() == 0


def test_longest_null_run_crosses_instruments(spark):
    rows = [(1, d(0), None), (1, d(1), 1.0), (1, d(2), None), (2, d(0), None), (2, d(1), None), (2, d(2), 5.0), (3, d(0), None)]
    p = spark.createDataFrame([(i, t, x, None) for i, t, x in rows], "inst long, dt date, x double, empty double")
    for split in (False, True):
        got = {r["factor"]: r["max_nan_streak_ratio"] for r in health.longest_null_run(p, ["x", "empty"], split=split).collect()}
        assert math.isclose(got["x"], 3 / 7) and got["empty"] == 1.0


def test_top_n_ties_by_name(spark):
    s = spark.createDataFrame([(d(0), i, 1.0) for i in (3, 1, 2)], "dt date, inst long, score double")
    assert sorted(r["inst"] for r in book.top_n(s, 2).collect()) == [1, 2]


def test_seed_intersection_and_missing_day(spark):
    rows = [(s, d(0), i, float(i == s) + i / 10) for s in (0, 1) for i in range(3)] + [(0, d(1), 1, 1.0)]
    s = spark.createDataFrame(rows, "seed long, dt date, inst long, score double")
    common = book.intersection(s, [0, 1], 3)
    assert common.count() == 3
    stats = book.intersection_stats(s.select("dt"), common).first()
    assert (stats["total_days"], stats["empty_days"], stats["min_size"], stats["max_size"]) == (2, 1, 0, 3)


def test_risk_figures(spark):
    rows = [(d(0), 0.1, 0.0), (d(1), -0.5, 0.01), (d(2), 0.2, -0.01)]
    r = book.risk_figures(spark.createDataFrame(rows, "dt date, ret double, bench double")).first()
    assert math.isclose(r["max_drawdown"], -0.5) and math.isclose(r["annual_return"], (1.1 * 0.5 * 1.2) ** (252 / 3) - 1)
    assert book.net_and_excess(spark.createDataFrame([(d(0), 0.1, 0.0), (d(1), 0.2, 0.0)], "dt date, ret double, cost double")).first()["information_ratio"] is None


def test_affordable_drops_names_until_lots_fit(spark):
    rows = [(d(0), 1, 0.9, 10.0), (d(0), 2, 0.8, 60.0), (d(0), 3, 0.7, 10.0)]
    c = spark.createDataFrame(rows, "dt date, inst long, score double, close double")
    got = {r["inst"]: r["lots"] for r in book.affordable(c, 13_000.0).collect()}
    assert got == {1: 600, 2: 100}  # three names would leave the dear one without a lot


def test_pareto_front_equals_brute_force(spark, split):
    import itertools
    import random

    random.seed(3)
    pts = [(i, random.randint(0, 9), random.randint(0, 9), random.randint(0, 9)) for i in range(40)]
    df = spark.createDataFrame(pts, "k long, a int, b int, c int")

    def beats(q, p):
        ge = q[1] >= p[1] and q[2] >= p[2] and q[3] <= p[3]
        return ge and q[1:] != p[1:]

    want = {p[0] for p in pts if not any(beats(q, p) for q in pts)}
    assert {r["k"] for r in runs.pareto_front(df, ["a", "b"], ["c"], "k").collect()} == want
    assert list(itertools.islice(want, 1))


def test_link_groups(spark):
    f = spark.createDataFrame([(x,) for x in "abcde"], "factor string")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("d", "e", 0.1)], "f1 string, f2 string, corr double")
    got = {r["factor"]: r["cluster"] for r in selection.link_groups(f, pairs).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_structure_roles_keep_two(spark):
    rep = spark.createDataFrame([(f, 1, ir) for f, ir in zip("abcde", (0.1, 0.5, 0.2, 0.3, 0.4))], "factor string, cluster int, rankic_ir double")
    load = spark.createDataFrame([(f, 0.5, 0.1) for f in "abcde"], "factor string, PC1 double, PC2 double")
    got = {r["factor"]: r["structure_role"] for r in selection.structure_roles(rep, load, keep=2).collect()}
    assert got == {"b": "CORE", "e": "CORE", "d": "OPTIONAL", "c": "OPTIONAL", "a": "REDUNDANT"}


def test_lookback_tensors(spark):
    p = panel(spark, [1.0, None, 3.0])
    zero = crosssection.lookback_tensor(p.fillna(0.0), ["x"], 4).orderBy("dt").collect()
    assert zero[1]["tensor"] == [[0.0], [0.0], [1.0], [0.0]]
    fill = crosssection.lookback_tensor(p, ["x"], 4, pad="fill").orderBy("dt").collect()
    assert fill[2]["tensor"] == [[1.0], [1.0], [1.0], [3.0]]


def test_robust_zscore_fits_on_train_only(spark):
    p = panel(spark, [1.0, 2.0, 3.0, 1000.0])
    train = p.where(F.col("dt") <= F.lit(d(2)))
    for split in (False, True):
        got = col(crosssection.robust_zscore(p, train, ["x"], split=split), "x")
        assert math.isclose(got[0], -1 / 1.4826, rel_tol=1e-6) and got[3] == 3.0


def test_file_names_and_log(spark):
    names = spark.createDataFrame([("model_predictions_backday_8_f88_46_0.csv",), ("model_predictions_backday_8_f88_46.csv",)], "n string")
    got = names.select(*[c.alias(k) for k, c in readers.seed_and_step(F.col("n")).items()]).collect()
    assert [tuple(r) for r in got] == [(46, 0), (46, -1)]
    log = spark.createDataFrame([("Seed 1, Epoch 3, train_loss 0.9, valid ic -0.01, icir 0.2, rankic 0.03, rankicir 0.4.",), ("noise",)], "value string")
    assert [tuple(r) for r in readers.parse_training_log(log).collect()] == [(3, 0.9, -0.01, 0.2, 0.03, 0.4)]


def test_json_maps(spark):
    body = '{"status": 1, "data": {"pb": {"2024-01-01": 1.5}, "crowd": {"2024-01-02": 2.0}}}'
    df = spark.createDataFrame([("f", body), ("g", '{"status": 0}')], "code string, body string")
    got = [tuple(r) for r in readers.date_maps_to_rows(df, "body", ["pb", "crowd"], ["code"]).orderBy("date").collect()]
    assert got == [("f", d(0), 1.5, None), ("f", d(1), None, 2.0)]


def test_incremental_equals_full(spark):
    p = panel(spark, [1.0, 2.0, 3.0])
    compute = lambda df: df.select("inst", "dt", (F.col("x") * 2).alias("y"))
    stored = compute(p.where(F.col("dt") <= F.lit(d(1))))
    out = sinks.append_new_days(p, stored, compute, ["inst", "dt", "y"])
    assert sorted(out.collect()) == sorted(compute(p).collect())
    assert sinks.needs_rebuild(stored, ["y", "z"])


def test_required_columns(spark):
    with pytest.raises(ValueError, match="nothing"):
        clean.require_columns(panel(spark, [1.0]), ["x", "nothing"])


def test_shared_dir_comes_from_the_session(spark):
    before = shared_dir(spark)
    assert fresh_path(spark, "a").startswith(before) and shared_dir(spark) == before


def test_seed_labels_are_complete(spark):
    c = runs.seed_class_labels(F.lit("workhorse"))
    row = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert row["SeedType"] == "老黄牛型" and len(runs.SEED_CLASSES) == 7


def test_lag_arrays_equal_lag_columns(spark):
    names = ("open", "high", "low", "close", "volume", "vwap")
    p = spark.createDataFrame([("a", d(i), *[10.0 + i * (k + 1) for k in range(6)]) for i in range(5)],
                              "inst string, dt date, " + ", ".join(f"{n} double" for n in names))
    s = X.Stage()
    wide = X.build(p, X.lag_block(s, 4), s).orderBy("dt").collect()
    arrays = X.lag_arrays(p, 4).orderBy("dt").collect()
    for w, a in zip(wide, arrays):
        for n in names:
            have = a[f"{n.upper()}_LAGS"]
            assert [w[f"{n.upper()}{i}"] for i in range(len(have))] == have
            assert all(w[f"{n.upper()}{i}"] is None for i in range(len(have), 4))


def test_scored_returns_are_the_join_of_scores_and_returns(spark, monkeypatch):
    """Beside the returns instead of joined to them, and dealt over a measured number of tasks."""
    from pyspark.sql import functions as F

    from tapeloom.plans import frames

    t = frames.Tables(spark, "/root/testdata/sf0.001")
    want = t.scores().join(t.returns().where(F.col("fwd").isNotNull()), ["inst", "dt"])
    monkeypatch.setattr(frames, "PANEL_ROWS", 500)
    got = t.scored_returns()
    assert got.rdd.getNumPartitions() >= t.size("lineitem") // 500 > spark.sparkContext.defaultParallelism
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
