"""Correlations of all pairs of many columns from mergeable co-moment matrices, in one read.

Each task keeps one matrix per moment over its rows, with pairwise missing values masked, and gives one
row per pair at its end. What is shuffled is pairs times tasks, whatever the number of rows. A task
holds 32 bytes a pair of columns: 2 MB for 239 columns, 128 MB for 2,000.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A variance below this share of the squared mean counts as no movement.
STILL = 1e-14
_PAIRS = "pos1 int, pos2 int, n double, mx double, my double, cxx double, cyy double, cxy double"


class Gram:
    """Masked sums of one set of rows, values taken from ``shift`` (the first row's)."""

    def __init__(self, width: int) -> None:
        self.n, self.s, self.ss, self.xy = (np.zeros((width, width)) for _ in range(4))
        self.shift: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        there = np.isfinite(x)
        if self.shift is None:
            self.shift = np.full(x.shape[1], np.nan)
        new = np.isnan(self.shift) & there.any(0)  # a column's shift is its first known value
        self.shift[new] = x[there.argmax(0)[new], np.flatnonzero(new)]
        x = np.where(there, x - np.nan_to_num(self.shift), 0.0)
        mask = there.astype(np.float64)
        self.n += mask.T @ mask
        self.s += x.T @ mask  # [i, j]: sum of i where j is known
        self.ss += (x * x).T @ mask
        self.xy += x.T @ x

    def pairs(self) -> dict[str, np.ndarray]:
        """Per pair i < j with a common row: count, means and central co-moments over the common rows."""
        i, j = np.nonzero(np.triu(self.n > 0, 1))
        shift = np.zeros(len(self.n)) if self.shift is None else self.shift
        n, sx, sy = self.n[i, j], self.s[i, j], self.s[j, i]
        return {
            "pos1": i.astype(np.int32), "pos2": j.astype(np.int32), "n": n, "mx": shift[i] + sx / n, "my": shift[j] + sy / n,
            "cxx": np.maximum(self.ss[i, j] - sx * sx / n, 0.0), "cyy": np.maximum(self.ss[j, i] - sy * sy / n, 0.0), "cxy": self.xy[i, j] - sx * sy / n}


def _values(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False).astype(np.float64) for f in names])


def correlations(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(f1, f2, pos1, pos2, n, corr) of all pairs in column order with a common row; null where a side does not move there."""
    names = list(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(len(names))
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                gram.add(_values(batch.slice(a, 8192), names))
        if gram.shift is not None:
            found = gram.pairs()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    parts = df.select(*[F.col(f).cast("double").alias(f) for f in names]).mapInArrow(run, _PAIRS)
    n, mx, my = F.sum("n"), F.sum(F.col("n") * F.col("mx")) / F.sum("n"), F.sum(F.col("n") * F.col("my")) / F.sum("n")
    # the pieces' means differ little from the whole mean, so this loses no digits to speak of
    between = lambda c, x, y, a, b: F.sum(F.col(c) + F.col("n") * F.col(x) * F.col(y)) - n * a * b
    whole = parts.groupBy("pos1", "pos2").agg(
        n.cast("long").alias("n"), mx.alias("mx"), my.alias("my"), between("cxx", "mx", "mx", mx, mx).alias("cxx"),
        between("cyy", "my", "my", my, my).alias("cyy"), between("cxy", "mx", "my", mx, my).alias("cxy"))
    return _named(whole.withColumn("corr", _corr()), names)


def _corr():
    moves = lambda c, m: F.when(F.col(c) > STILL * F.col("n") * F.col(m) * F.col(m), F.sqrt(c))
    size = F.nullif(moves("cxx", "mx") * moves("cyy", "my"), F.lit(0.0))
    return F.when(size.isNotNull(), F.greatest(F.least(F.col("cxy") / size, F.lit(1.0)), F.lit(-1.0)))  # least would skip a null


def _named(pairs: DataFrame, names: list[str]) -> DataFrame:
    name = F.array(*[F.lit(f) for f in names])
    return pairs.select(F.get(name, F.col("pos1")).alias("f1"), F.get(name, F.col("pos2")).alias("f2"), "pos1", "pos2", "n", "corr")


def mean_correlations(df: DataFrame, factors: Sequence[str], by: str = "dt") -> DataFrame:
    """(f1, f2, pos1, pos2, n, corr): the mean over ``by`` of the pairs' correlations there; n is the number of them.

    Rows of a day meet in one task (names of a day, not raw rows), which adds up its days' correlations and
    gives one row per pair.
    """
    names = list(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
        day, gram = None, None

        def close() -> None:
            if gram is None or gram.shift is None:
                return
            p = gram.pairs()
            moves = (p["cxx"] > STILL * p["n"] * p["mx"] ** 2) & (p["cyy"] > STILL * p["n"] * p["my"] ** 2)
            i, j = p["pos1"][moves], p["pos2"][moves]
            total[i, j] += np.clip(p["cxy"][moves] / np.sqrt(p["cxx"][moves] * p["cyy"][moves]), -1.0, 1.0)
            count[i, j] += 1

        for batch in batches:
            days, x = batch.column(0).to_pylist(), _values(batch, names)
            cuts = [0, *[k for k in range(1, len(days)) if days[k] != days[k - 1]], len(days)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if gram is None or days[a] != day:
                        close()
                        day, gram = days[a], Gram(len(names))
                    gram.add(x[a:b])
        close()
        i, j = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), count[i, j], total[i, j])], names=["pos1", "pos2", "n", "total"])

    key = F.col(by).cast("string").alias("_by")
    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in names]).repartition("_by").sortWithinPartitions("_by")
    parts = rows.mapInArrow(run, "pos1 int, pos2 int, n double, total double").groupBy("pos1", "pos2")
    return _named(parts.agg(F.sum("n").cast("long").alias("n"), (F.sum("total") / F.sum("n")).alias("corr")), names)
