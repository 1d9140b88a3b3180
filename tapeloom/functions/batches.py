"""All rolling figures of a ``features.Stage`` in one pass over a task's rows in order.

Spark evaluates a sliding frame anew for every row, and some hundred window columns make generated methods too long to be compiled. Here a
task's rows pass in Spark's order by instrument and day, and a batch of them is worked on at once; the last rows of a batch are
kept for the next one. ``_t``, the row's number in its instrument, says how far back a window may look. Memory is a
batch times the longest window. Numbers travel as one array per row: Spark measures every Arrow column anew for each row it writes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import extremes
from tapeloom.functions import rolling as W
from tapeloom.functions.moments import Moments

VIEWS = {"high", "low", "quantile"}


def _matrix(c: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and where there are any, from arrays of ``width`` numbers."""
    flat = c.flatten()
    return tuple(p.to_numpy(zero_copy_only=False).reshape(-1, width) for p in (flat, flat.is_valid()))


class Figures:
    """Figures asked for; ``add`` computes them all in one go."""

    def __init__(self) -> None:
        self.asked: dict[str, tuple] = {}

    def ask(self, name: str, kind: str, x: str, d: int, more: str | float | None = None) -> Column:
        """``more``: the other series of a correlation, the place of a quantile, the figure of a line."""
        name = name.replace(".", "_")
        self.asked.setdefault(name, (kind, x, d, more))
        return F.col(name)

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``_t``) and the columns asked for."""
        if not self.asked:
            return df
        asked = dict(self.asked)
        series = sorted({x for _, x, _, _ in asked.values()} | {y for kind, _, _, y in asked.values() if kind == "corr"})
        windows = {d for kind, _, d, _ in asked.values() if kind != "lag"} or {1}
        lead = max(d + (kind == "lag") for kind, _, d, _ in asked.values()) - 1
        # the row's own numbers, then series of other types as numbers
        own = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in (*W.KEYS, *W.ORDER)]
        others = [f for f in df.schema.fields if f.name not in own]
        packed = [*own, *[x for x in dict.fromkeys([*series, "_t"]) if x not in own]]
        place = {n: i for i, n in enumerate(packed)}

        def run(batches):
            kept = {x: (np.full(lead, np.nan), np.zeros(lead, bool)) for x in series}
            firsts: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                values, there = _matrix(batch.column("_row"), len(packed))
                t = values[:, place["_t"]].copy()
                rows = {}
                for x in series:
                    rows[x] = tuple(np.concatenate([p, now[:, place[x]]]) for p, now in zip(kept[x], (values, there)))
                    kept[x] = tuple(p[len(p) - lead :] for p in rows[x])
                with np.errstate(all="ignore"):
                    made, firsts = _figures(asked, rows, t, lead, windows, firsts)
                width = len(own) + len(asked)
                out, missing = np.empty((len(t), width)), np.empty((len(t), width), bool)
                out[:, : len(own)], missing[:, : len(own)] = values[:, : len(own)], ~there[:, : len(own)]
                for i, (v, some) in enumerate(made, len(own)):
                    out[:, i], missing[:, i] = v, ~some
                offsets = pa.array(np.arange(len(t) + 1, dtype=np.int32) * width)
                column = pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.float64(), mask=missing.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=batch.schema.names)

        rows = df.select(*[f.name for f in others], F.array(*[F.col(n).cast("double") for n in packed]).alias("_row"))
        schema = T.StructType([*others, T.StructField("_row", T.ArrayType(T.DoubleType()))])
        # the order that ``_t`` was counted in: no further sort
        made = rows.sortWithinPartitions(*W.KEYS, *W.ORDER).mapInArrow(run, schema)
        at = {n: F.get("_row", F.lit(i)).alias(n) for i, n in enumerate([*own, *asked])}
        return made.select(*[at.get(n, F.col(n)) for n in df.columns], *[at[n] for n in asked])


def _figures(asked: dict[str, tuple], rows: dict, t: np.ndarray, lead: int, windows: set[int], firsts: dict) -> tuple[list, dict]:
    m = Moments(rows, t, lead, windows, firsts)
    made = []
    for kind, x, d, more in asked.values():
        if kind in VIEWS:
            v, known = (np.lib.stride_tricks.sliding_window_view(p[lead + 1 - d :], d) for p in rows[x])
            there = m.once(("there", x, d), lambda: known & (np.arange(d - 1, -1, -1) < t[:, None]))
            made.append(extremes.figure(kind, more, v, there, t, lambda make: m.once(("ordered", x, d), make)))
        elif kind == "corr":
            made.append(m.corr(x, more, d))
        elif kind == "line":
            made.append(m.line(x, d, more))
        else:
            made.append(getattr(m, kind)(x, d))
    return made, m.after


def means(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per group the mean (under the column's name) and the number of known values (``n_`` before it) of many columns of numbers.

    Each batch is summed per group before Spark's aggregate meets it, which would take longer, row by row, than all the rest.
    """
    fields = [df.schema[k] for k in keys]
    sums = [T.StructField(f"s_{n}", T.DoubleType()) for n in names]
    schema = T.StructType([*fields, *sums, *[T.StructField(f"n_{n}", T.LongType()) for n in names]])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, there = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)) for c in ("_row", "_there"))
            values = np.where(there, values, 0.0)
            # neighbours with the same keys are one group here; groups meet again in Spark's aggregate
            new = np.zeros(len(values), bool)
            new[0] = True
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            s, n = np.add.reduceat(values, first, axis=0), np.add.reduceat(there.astype(np.int64), first, axis=0)
            groups = [batch.column(k).take(pa.array(first)) for k in keys]
            columns = [*[pa.array(s[:, i].copy(), mask=n[:, i] == 0) for i in range(len(names))], *[pa.array(n[:, i].copy()) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays([*groups, *columns], names=schema.names)

    # each column is used twice, so Spark keeps the step that makes it apart from the arrays: fused, both would be one method too long to be compiled
    rows = df.select(*keys, F.array(*[F.col(n).cast("double") for n in names]).alias("_row"), F.array(*[F.col(n).isNotNull() for n in names]).alias("_there"))
    rows = rows.mapInArrow(run, schema)
    made = [a for n in names for a in ((F.sum(f"s_{n}") / F.nullif(F.sum(f"n_{n}"), F.lit(0))).alias(n), F.sum(f"n_{n}").alias(f"n_{n}"))]
    return rows.groupBy(*keys).agg(*made)
