"""Stored loads: run twice, broken off, drifted, corrected."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tapeloom.sources.stored import PART, StoredTable


def rows(spark, days, insts=("a", "b"), factor=1.0):
    data = [(i, date(2024, 1, d), factor * d * (k + 1)) for k, i in enumerate(insts) for d in days]
    return spark.createDataFrame(data, "inst string, dt date, close double")


def twice(df):
    return df.select("inst", "dt", (F.col("close") * 2).alias("twice"))


def content(table):
    return sorted(tuple(r) for r in table.read().select("inst", "dt", "twice").collect())


def stamps(table):
    base = f"{table.path}/{table.version()}"
    return {p: {f: os.stat(f"{base}/{PART}={p}/{f}").st_mtime_ns for f in os.listdir(f"{base}/{PART}={p}")} for p in table.parts()}


def test_only_new_days_are_touched(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.marks() is None
    assert t.load(rows(spark, range(1, 6)), twice, ["twice"]).rebuilt
    before = stamps(t)
    got = t.load(rows(spark, range(1, 9), factor=9.0), twice, ["twice"])
    assert not got.rebuilt and sorted(got.parts) == ["2024-01-06", "2024-01-07", "2024-01-08"]
    after = stamps(t)
    assert all(after[p] == before[p] for p in before)
    want = content(t)
    assert len(want) == 16 and want[0] == ("a", date(2024, 1, 1), 2.0) and want[7] == ("a", date(2024, 1, 8), 144.0)
    again = t.load(rows(spark, range(1, 9), factor=9.0), twice, ["twice"])
    assert again.parts == () and content(t) == want and stamps(t) == after


def test_late_instrument_joins_old_days(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    t.load(rows(spark, range(1, 4)), twice)
    got = t.load(rows(spark, range(1, 4), ("a", "b", "c")), twice)
    assert len(got.parts) == 3
    assert content(t) == sorted((i, date(2024, 1, d), 2.0 * d * k) for k, i in ((1, "a"), (2, "b"), (3, "c")) for d in (1, 2, 3))


@pytest.mark.parametrize("where", ["staged", "half applied", "not marked"])
def test_broken_off_load_is_finished(spark, tmp_path, monkeypatch, where):
    whole = StoredTable(spark, str(tmp_path / "whole"))
    whole.load(rows(spark, range(1, 10)), twice)
    t = StoredTable(spark, str(tmp_path / "t"))
    t.load(rows(spark, range(1, 6)), twice)

    def die(self, name):
        if where == "half applied":  # the newest day got in, the ones before it did not
            fresh = self._open(name).where(F.col("dt") == F.lit(date(2024, 1, 9)))
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/{self.version()}")
        if where == "not marked":
            monkeypatch.setattr(self.folder, "touch", lambda path: (_ for _ in ()).throw(KeyboardInterrupt))
            real(self, name)
        raise KeyboardInterrupt

    real = StoredTable._apply
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_apply", die)
        with pytest.raises(KeyboardInterrupt):
            t.load(rows(spark, range(1, 10)), twice)
    t = StoredTable(spark, t.path)
    got = t.load(rows(spark, range(1, 10)), twice)
    assert got.finished_earlier and content(t) == content(whole)
    assert not t.load(rows(spark, range(1, 10)), twice).finished_earlier


def test_incomplete_writes_are_not_data(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    t.load(rows(spark, range(1, 4)), twice)
    want = content(t)
    for name in ("v=0002", "staged=000009"):  # died before the job was complete
        rows(spark, [9]).withColumn(PART, F.lit("2024-01-09")).write.partitionBy(PART).parquet(f"{t.path}/{name}")
        t.folder.delete(f"{t.path}/{name}/_SUCCESS")
    assert t.version() == "v=0001" and content(t) == want and not t.recover()


def test_drift_rebuilds_into_a_new_version(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    t.load(rows(spark, range(1, 4)), twice, ["twice"])
    old = t.read()
    wide = lambda df: twice(df).withColumn("half", F.lit(0.5))
    got = t.load(rows(spark, range(1, 5)), wide, ["twice", "half"])
    assert got.rebuilt and t.version() == "v=0002" and t.read().columns == ["inst", "dt", "twice", "half"]
    assert old.count() == 6 and t.read().count() == 8
    t.drop_old()
    assert t.folder.names(t.path) == ["v=0002"]


def test_other_partitions_and_an_empty_source(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), part=lambda d: F.date_format(d, "yyyy-MM"))
    t.load(rows(spark, []), twice)
    assert t.read() is None or t.read().count() == 0
    t.load(rows(spark, range(1, 4)), twice)
    t.load(rows(spark, range(1, 8)), twice)
    assert t.parts() == ["2024-01"] and len(content(t)) == 14
