"""Exact order statistics and ordered windows over groups of any size.

A plain window or ``percentile`` hands one whole group to one task. That is right while
groups are small, and wrong when one key holds a third of the table. Each function here
has two exact ways, picked by a measured size:

* plain: ordinary windows and aggregates, used when the largest group is below
  ``spark.tapeloom.groupRowsLimit`` rows;
* split: equal values are counted first (map-side combine), the distinct values of a group
  are cut into buckets at sketched quantiles, each bucket is ordered on its own, and
  the few bucket totals are added up in order. Every bucket is its own task, results
  are the same to the last row.

The sketched cut points only steer balance. Any cut gives the same ranks, so the
approximation never reaches a result; they are written out once so that all readers
and retries use the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

LIMIT_KEY = "spark.tapeloom.groupRowsLimit"
DEFAULT_LIMIT = 2_000_000
BUCKETS = 64
#: Rows one task should hold where work is dealt by measured rows.
TASK_ROWS = 500_000
#: Of the sketches that bracket a quantile; their error is at most 1 / ACCURACY of the rows.
ACCURACY = 10_000


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(LIMIT_KEY, str(DEFAULT_LIMIT)))


def largest_group(df: DataFrame, keys: Sequence[str] = ()) -> int:
    """Rows in the biggest group. Reads the key columns only; counts combine map-side."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def spread(df: DataFrame, rows: int, *keys: str, each: int | None = None) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as its ``rows`` ask for.

    The session's count of partitions is fixed and the adaptive planner goes by bytes, which say little about rows
    of short keys. On small tables the planner's choice stays.
    """
    n = -(-rows // (each or TASK_ROWS))
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", equal: Sequence[str] = ()) -> DataFrame:
    """Join on null-safe equality of ``keys`` and plain equality of ``equal``; the left side's key columns stay.

    A group with a null key keeps its rows, as it does in a window.
    """
    if not keys:
        return left.join(right, list(equal), how)
    names = {k: f"_key{i}" for i, k in enumerate([*keys, *equal])}
    right = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(names[k]))
    for k in equal:
        cond = cond & (F.col(k) == F.col(names[k]))
    return left.join(right, cond, how).drop(*names.values())


def per_group(df: DataFrame, keys: Sequence[str], *aggs: Column, bounded: bool = False) -> DataFrame:
    """Attach group aggregates to every row without a window.

    The aggregate combines map-side, so a hot group never lands in one task. Pass
    ``bounded=True`` only where the keys have a proven count (calendar days): then the
    totals are broadcast. Otherwise the adaptive planner chooses by measured size and
    splits a hot key.
    """
    if not keys:
        totals = df.agg(*aggs)
        return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})
    totals = df.groupBy(*keys).agg(*aggs)
    return df.join(F.broadcast(totals) if bounded else totals, list(keys), "left")


def ranked_values(df: DataFrame, keys: Sequence[str], x: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per (keys, value): ``n`` rows with it, ``below`` rows under it,
    ``dense`` distinct values up to and with it, ``total`` rows of the group.

    This is the split way; nulls in ``x`` are left out.
    """
    keys = list(keys)
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    cuts = [i / buckets for i in range(1, buckets)]
    edges = counts.groupBy(*keys).agg(
        F.percentile_approx(x, [float(c) for c in cuts], 10000).alias("_edges")
    )
    edges = materialize(edges, "edges")
    place = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(x))).alias("_b")
    # no hint unless the group count is one: the planner sees the size of the written table
    placed = (
        join_keys(counts, edges, keys, "left") if keys else counts.withColumn("_edges", edges.scalar())
    ).select(*keys, x, "n", place)
    sums = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn"), F.count(F.lit(1)).alias("_bd"))
    # at most `buckets` rows per group
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select(
        *keys, "_b",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_bd").over(before), F.lit(0)).alias("_doff"),
        F.sum("_bn").over(whole).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(x)
    local = placed.withColumns({
        "_lb": F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_ld": F.row_number().over(inside),
    })
    return join_keys(local, sums, keys, equal=["_b"]).select(
        *keys, x, "n",
        (F.col("_off") + F.col("_lb")).alias("below"),
        (F.col("_doff") + F.col("_ld")).alias("dense"),
        "total",
    )


def with_ranks(
    df: DataFrame, keys: Sequence[str], x: str, *, avg: str | None = None, dense: str | None = None,
    pct: str | None = None, split: bool = False, ascending: bool = True, source: DataFrame | None = None,
) -> DataFrame:
    """Add average rank, dense rank and / or average percent rank of ``x`` inside ``keys``.

    Rows with a null ``x`` get null. Average rank of ties is ``low rank + (ties - 1) / 2``.
    When several columns are ranked in turn, pass the first frame as ``source``: it has the
    same rows, and the split way then does not recompute the ranks joined before.
    """
    keys = list(keys)
    # without a key a window would hand every row to one task
    if keys and not split:
        order = F.col(x).asc_nulls_last() if ascending else F.col(x).desc_nulls_last()
        w = Window.partitionBy(*keys).orderBy(order)
        ties = Window.partitionBy(*keys, x)
        mean_rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
        cols: dict[str, Column] = {}
        if avg:
            cols[avg] = F.when(F.col(x).isNotNull(), mean_rank)
        if dense:
            cols[dense] = F.when(F.col(x).isNotNull(), F.dense_rank().over(w).cast("long"))
        if pct:
            cols[pct] = F.when(F.col(x).isNotNull(), mean_rank / F.count(x).over(Window.partitionBy(*keys)))
        return df.withColumns(cols)
    ranks = ranked_values(df if source is None else source, keys, x)
    if ascending:
        mean_rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
        dense_rank = F.col("dense")
    else:
        mean_rank = F.col("total") - F.col("below") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
        top = ranks.groupBy(*keys).agg(F.max("dense").alias("_top"))
        ranks = join_keys(ranks, top, keys) if keys else ranks.withColumn("_top", top.scalar())
        dense_rank = F.col("_top") - F.col("dense") + 1
    out = [F.col(k) for k in [*keys, x]]
    if avg:
        out.append(mean_rank.alias(avg))
    if dense:
        out.append(dense_rank.cast("long").alias(dense))
    if pct:
        out.append((mean_rank / F.col("total")).alias(pct))
    # a hot value is one small row on the right: the adaptive skew join splits the left side
    return join_keys(df, ranks.select(*out), keys, "left", equal=[x])


def quantiles(
    df: DataFrame, keys: Sequence[str], x: str, probs: dict[str, float], split: bool = False
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``x`` per group, one column per name."""
    keys = list(keys)
    if not split:
        return df.groupBy(*keys).agg(*[F.percentile(x, F.lit(p)).alias(a) for a, p in probs.items()])
    found = _bracketed(df, keys, x, probs)
    if found.where(" OR ".join(f"`{a}` IS NULL" for a in probs)).limit(1).count():
        found = _interpolated(ranked_values(df, keys, x), keys, x, probs)
    if not keys:
        return found
    # groups with nothing but nulls keep their row
    return join_keys(df.select(*keys).distinct(), found, keys, "left")


def _bracketed(df: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from the values near them only; null where a bracket missed.

    A sketch gives two ends around each quantile, five times its error away. Values between the two are kept, all others
    only counted, so about a thousandth of the rows is ordered per quantile. Counts are exact, and so is the value picked.
    """
    known = df.where(F.col(x).isNotNull()).select(*keys, x)
    margin = 5 / ACCURACY
    ends = [min(max(p + side * margin, 0.0), 1.0) for p in probs.values() for side in (-1, 1)]
    edges = materialize(known.groupBy(*keys).agg(F.percentile_approx(x, ends, ACCURACY).alias("_e")), "edges")
    rows = join_keys(known, edges, keys) if keys else known.withColumn("_e", edges.scalar())
    near = F.lit(False)
    for i in range(len(probs)):
        near = near | F.col(x).between(F.get("_e", F.lit(2 * i)), F.get("_e", F.lit(2 * i + 1)))
    # between two neighbouring ends either all values are near or none; a value that is an end itself comes after those under it
    under = F.size(F.filter("_e", lambda e: e < F.col(x)))
    counts = rows.groupBy(*keys, under.alias("_under"), F.when(near, F.col(x)).alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("_under", "_x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "below": F.coalesce(F.sum("n").over(order), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    return materialize(_interpolated(counts.withColumnRenamed("_x", "_value"), keys, "_value", probs), "quantiles")


def _interpolated(ranks: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from values with ``n`` rows, ``below`` rows under them and the group's ``total``."""
    cols = []
    for a, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
            cols.append(F.max(F.when(hit, F.col(x))).alias(f"_{a}_{side}"))
        cols.append(F.max(pos - F.floor(pos)).alias(f"_{a}_w"))
    picked = ranks.groupBy(*keys).agg(*cols)
    return picked.select(
        *keys,
        *[
            (F.col(f"_{a}_lo") + (F.col(f"_{a}_hi") - F.col(f"_{a}_lo")) * F.col(f"_{a}_w")).alias(a)
            for a in probs
        ],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], x: str, tie: str, out: str, split: bool = False, ascending: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """1-based position by ``x`` then ``tie`` ascending; null values come last. ``tie`` is unique inside a group and not null.

    The split way ranks the values first and then orders ``tie`` only among equal values.
    ``source`` is as in ``with_ranks``.
    """
    keys = list(keys)
    if keys and not split:
        order = F.col(x).asc_nulls_last() if ascending else F.col(x).desc_nulls_last()
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)).cast("long"))
    base = (df if source is None else source).select(*dict.fromkeys([*keys, x, tie]))
    ranks = ranked_values(base, keys, x)
    first = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("n")
    ranks = ranks.select(*keys, x, first.alias("_first"), F.col("n").alias("_ties"))
    # rows without a value come after all others, in the order of ``tie``
    known = base.groupBy(*keys).agg(F.count(x).alias("_first"), F.count(F.when(F.col(x).isNull(), 1)).alias("_ties"))
    ranks = ranks.unionByName(known.where("_ties > 0").withColumn(x, F.lit(None).cast(base.schema[x].dataType)))
    tied = join_keys(base, ranks.where(F.col("_ties") > 1).select(*keys, x), [*keys, x], "left_semi")
    inner = ranked_values(tied, [*keys, x], tie).select(*keys, x, tie, F.col("below").alias("_in"))
    placed = join_keys(join_keys(df, ranks, [*keys, x], "left"), inner, [*keys, x], "left", equal=[tie])
    pos = F.col("_first") + F.coalesce(F.col("_in"), F.lit(0)) + 1
    return placed.withColumn(out, pos.cast("long")).drop("_first", "_ties", "_in")


def stitched(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str | None, *,
    number: str | None = None, previous: dict[str, str] | None = None,
) -> DataFrame:
    """Row number and previous-row values inside ``keys``, with the group cut at ``chunk``.

    ``chunk`` must not decrease along ``order``. Only one row per chunk (its size and last
    values) crosses chunk borders, so a group of any size spreads over as many tasks as it
    has chunks. Without a chunk column this is the plain window.
    """
    keys, order = list(keys), list(order)
    previous = previous or {}
    parts = keys + ([chunk] if chunk else [])
    w = Window.partitionBy(*parts).orderBy(*order)
    cols: dict[str, Column] = {"_rn": F.row_number().over(w).cast("long")}
    for out, src in previous.items():
        cols[out] = F.lag(src).over(w)
    rows = df.withColumns(cols)
    if not chunk:
        rows = rows.withColumn(number, F.col("_rn")) if number else rows
        return rows.drop("_rn")
    key = F.struct(*order)
    heads = df.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max_by(s, key).alias(f"_last_{o}") for o, s in previous.items()]
    )
    along = Window.partitionBy(*keys).orderBy(chunk)
    heads = heads.select(
        *parts,
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *[F.lag(f"_last_{o}").over(along).alias(f"_prev_{o}") for o in previous],
    )
    rows = join_keys(rows, heads, parts)
    if number:
        rows = rows.withColumn(number, F.col("_rn") + F.col("_off"))
    for out in previous:
        rows = rows.withColumn(out, F.when(F.col("_rn") == 1, F.col(f"_prev_{out}")).otherwise(F.col(out)))
    return rows.drop("_rn", "_off", *[f"_prev_{o}" for o in previous])
