"""A stored table in partitions of days, loaded again and again: only new days are computed, a load that broke off is finished.

Layout below the table's folder: ``v=0001`` and so on, each a whole version partitioned by ``part``, and
``staged=...`` with the rows of one load. A version or a staged load counts once Spark has marked it complete, so a job
that dies leaves nothing that a reader would take for data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.sinks import needs_rebuild, new_rows

PART = "part"
_DONE = "_SUCCESS"
_APPLIED = "_APPLIED"


@dataclass(frozen=True)
class Load:
    """What a load did: the whole table anew, or the partitions it wrote."""

    rebuilt: bool
    parts: tuple[str, ...]
    finished_earlier: bool = False


class Folder:
    """Folders of any store Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def touch(self, path: str) -> None:
        self.fs.create(self._path(path), True).close()

    def rename(self, path: str, to: str) -> None:
        if not self.fs.rename(self._path(path), self._path(to)):
            raise OSError(f"cannot rename {path} to {to}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class StoredTable:
    """A table of (inst, day) rows below ``path``; ``part`` maps a day to its partition, the day itself by default."""

    def __init__(self, spark: SparkSession, path: str, inst: str = "inst", dt: str = "dt", part: Callable[[Column], Column] | None = None) -> None:
        self.spark, self.path, self.inst, self.dt = spark, path.rstrip("/"), inst, dt
        self.part = part or (lambda day: F.date_format(day, "yyyy-MM-dd"))
        self.folder = Folder(spark, self.path)

    def _complete(self, kind: str) -> list[str]:
        return [n for n in self.folder.names(self.path) if n.startswith(f"{kind}=") and self.folder.exists(f"{self.path}/{n}/{_DONE}")]

    def version(self) -> str | None:
        """Folder name of the newest complete version."""
        return max(self._complete("v"), default=None)

    def parts(self) -> list[str]:
        v = self.version()
        return [n.split("=", 1)[1] for n in self.folder.names(f"{self.path}/{v}") if n.startswith(f"{PART}=")] if v else []

    def _open(self, name: str) -> DataFrame:
        # partition values stay text: their type does not depend on how they look
        base = f"{self.path}/{name}"
        schema = self.spark.read.parquet(base).drop(PART).schema
        return self.spark.read.schema(schema.add(PART, "string")).parquet(base)

    def read(self) -> DataFrame | None:
        return self._open(self.version()).drop(PART) if self.parts() else None  # a version without a row is no table yet

    def marks(self) -> DataFrame | None:
        """(inst, newest day) of the stored rows; only two columns are read."""
        rows = self.read()
        return None if rows is None else rows.groupBy(self.inst).agg(F.max(self.dt).alias("newest"))

    def load(self, source: DataFrame, compute: Callable[[DataFrame], DataFrame], required: Sequence[str] = ()) -> Load:
        """Bring the table up to ``source``; ``compute`` maps source rows to rows of the table.

        A first load, or a stored table without a ``required`` column, is computed whole into a fresh version; readers keep
        the old one until it is complete. Otherwise only rows after the newest stored day of their
        instrument are computed, staged, and put into their partitions. A load that broke off is finished first. Running a load again
        changes nothing, wherever the one before stopped.
        """
        earlier = self.recover()
        stored = self.read()
        if needs_rebuild(stored, required):
            number = max((int(n.split("=")[1]) for n in self.folder.names(self.path) if n.startswith("v=")), default=0) + 1
            self._write(compute(source), f"v={number:04d}")
            return Load(True, tuple(self.parts()), earlier)
        staged = f"staged={len(self.folder.names(self.path)):06d}"
        fresh = compute(new_rows(source, stored, self.inst, self.dt)).select(*stored.columns)
        self._write(fresh, staged)
        return Load(False, tuple(self._apply(staged)), earlier)

    def _write(self, rows: DataFrame, name: str) -> None:
        # rows of a partition meet in one task per range of instruments, so a day is few files and a hot day is no single task
        rows = rows.withColumn(PART, self.part(F.col(self.dt)))
        rows.repartitionByRange(PART, self.inst).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{name}")

    def recover(self) -> bool:
        """Put staged loads in that are complete and not yet applied. True if there was one."""
        found = [n for n in self._complete("staged") if not self.folder.exists(f"{self.path}/{n}/{_APPLIED}")]
        for name in found:
            self._apply(name)
        return bool(found)

    def _apply(self, name: str) -> list[str]:
        """Overwrite the staged rows' partitions by what they hold and the stored rows of other (inst, day)."""
        touched = [n.split("=", 1)[1] for n in self.folder.names(f"{self.path}/{name}") if n.startswith(f"{PART}=")]
        if touched:
            v = self.version()
            fresh, key = self._open(name), [self.inst, self.dt]
            held = self._open(v).where(F.col(PART).isin(touched)).join(fresh.select(*key).distinct(), key, "left_anti")
            merged = held.unionByName(fresh)
            merged.repartitionByRange(PART, self.inst).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/{v}")
        self.folder.touch(f"{self.path}/{name}/{_APPLIED}")
        return touched

    def drop_old(self) -> None:
        """Remove versions before the newest complete one and applied loads. Not while others read them."""
        keep = self.version()
        for n in self.folder.names(self.path):
            old = n.startswith("v=") and keep and n < keep
            if old or (n.startswith("staged=") and self.folder.exists(f"{self.path}/{n}/{_APPLIED}")):
                self.folder.delete(f"{self.path}/{n}")
