"""Files named after model runs, and the stream sink of whole days."""

import os
import shutil
from datetime import datetime

from tapeloom.sources import readers, sinks
from tapeloom.streaming import bars_stream


def test_prediction_files_keep_their_names(spark, tmp_path):
    data = [("2024-01-02", "a", 0.5, 46, 0, "x"), ("2024-01-03", "a", -0.5, 46, 0, "x"), ("2024-01-02", "b", 1.5, 7, None, "y"), ("2024-01-02", "b", 2.5, 7, None, "x")]
    scores = spark.createDataFrame(data, "datetime string, instrument string, score double, seed long, step long, run string")
    path = str(tmp_path / "pred")
    sinks.write_prediction_files(scores, path, "master_predictions_backday_8_f88", ["run"])
    found = sorted(os.path.relpath(os.path.join(at, f), path) for at, _, files in os.walk(path) for f in files if f.endswith(".csv"))
    assert found == ["run=x/master_predictions_backday_8_f88_46_0.csv", "run=x/master_predictions_backday_8_f88_7.csv", "run=y/master_predictions_backday_8_f88_7.csv"]
    with open(f"{path}/run=y/master_predictions_backday_8_f88_nothing.csv", "w") as f:
        f.write("datetime,instrument,score\n2024-01-05,c,oops\n2024-01-05,d,NaN\n2024-01-05,e,3\n")
    with open(f"{path}/run=y/other_9.csv", "w") as f:
        f.write("datetime,instrument,score\n2024-01-05,z,1\n")
    got = readers.read_predictions(spark, path).select("datetime", "instrument", "score", "seed", "step", "folder")
    want = [("2024-01-02", "a", 0.5, 46, 0, "run=x"), ("2024-01-03", "a", -0.5, 46, 0, "run=x"), ("2024-01-02", "b", 1.5, 7, -1, "run=y"), ("2024-01-02", "b", 2.5, 7, -1, "run=x"), ("2024-01-05", "e", 3.0, None, None, "run=y")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_prediction_files_are_written_without_a_sort(spark, tmp_path):
    """A sort by file holds whole runs in one task; its memory grew with the scores."""
    scores = spark.range(200_000).selectExpr("id AS datetime", "id % 7 AS instrument", "id / 3.0D AS score", "id % 2 AS seed", "1L AS step", "'x' AS run")
    bus = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in stages(bus)}
    sinks.write_prediction_files(scores, str(tmp_path / "p"), "a_predictions", ["run"])
    seen = [s.peakExecutionMemory() for s in stages(bus) if s.stageId() not in before]
    assert seen and max(seen) < 1_000_000
    assert spark.conf.get(sinks.OPEN_FILES_KEY) == "0"
    assert sorted(f for f in os.listdir(tmp_path / "p" / "run=x") if f.endswith(".csv")) == ["a_predictions_0_1.csv", "a_predictions_1_1.csv"]
    got = readers.read_predictions(spark, str(tmp_path / "p"))
    assert got.count() == 200_000 and got.select("datetime").distinct().count() == 200_000


def stages(store):
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [found.apply(i) for i in range(found.size())]


SCHEMA = "inst string, datetime timestamp, open double, high double, low double, close double, volume double, amount double"


def bars(spark, days, shift=0.0):
    rows = [(i, datetime(2024, 1, d, 10 + h), 1.0, 2.0 + h, 0.5, 1.0 + h + shift, 10.0, 10.0) for d in days for i in ("a", "b") for h in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_overwrites_whole_days_only(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def feed(df, number):
        df.coalesce(1).write.parquet(f"{src}/{number}")

    def run(at=state, start=src):
        rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(start)
        q = bars_stream.run_to_days(bars_stream.daily_from_stream(rows), out, at)
        q.awaitTermination()
        return q

    def table():
        return sorted(tuple(r) for r in spark.read.parquet(out).select("inst", "part", "close", "volume", "bars").collect())

    feed(bars(spark, [1, 2, 3]), 1)
    first = run()
    want = [(i, datetime(2024, 1, d).date(), 3.0, 30.0, 3) for i in ("a", "b") for d in (1, 2)]
    assert table() == want and bars_stream.late_rows(first) == 0
    shutil.copytree(f"{src}/1", f"{src}/2")  # the same file again: its closed days are late
    again = run()
    assert table() == want and bars_stream.late_rows(again) > 0
    feed(bars(spark, [5]), 3)
    run()
    assert [r for r in table() if r[1].day <= 2] == want and {r[1].day for r in table()} == {1, 2, 3}
    before = {p: os.listdir(f"{out}/{p}") for p in os.listdir(out) if p.endswith(("-01", "-02"))}
    feed(bars(spark, [6, 7]), 4)
    run()
    assert before == {p: os.listdir(f"{out}/{p}") for p in before}
    # a run without its state writes the same partitions again
    whole, other = table(), str(tmp_path / "other")
    bars(spark, [1, 2, 3]).unionByName(bars(spark, [5])).coalesce(1).write.parquet(f"{other}/1")
    bars(spark, [6, 7]).coalesce(1).write.parquet(f"{other}/2")
    run(str(tmp_path / "fresh"), other)
    closed = lambda rows: [r for r in rows if r[1].day != 3]  # noqa: E731 - day 3 was open when its bars came twice
    assert closed(table()) == closed(whole) and len(table()) == len(whole)
