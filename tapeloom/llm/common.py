"""What the corpus operators share: word pattern, table readers, null-safe joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

#: White space is ASCII only: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Up to this many rows of one long column a join side may be broadcast; above, the join shuffles.
BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column is called so (case does not count)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number of its own for every row, and that column's name.

    Ids may be null or repeat; decisions on rows meet their rows by this key.
    """
    name = free("_row_key", docs.columns)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a larger expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` only if its counted rows are few; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``at`` (place in its group by ``order``, from 0, gapless) and ``n`` (rows of the group), written.

    Rows are dealt by ranges of (group, order), so a hot group spreads over all tasks; only one row per group and
    task is added up. ``group`` columns hold no null; put a row number last in ``order`` to split equal rows.
    """
    rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_m", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_task", F.shiftright("_m", 33)), "dealt")
    runs = rows.groupBy(*group, "_task").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    key = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_rows").over(key.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("_rows").over(key)).drop("_rows")
    placed = rows.join(runs, [*group, "_task"]).withColumn("at", F.col("_before") + F.col("_m") - F.col("_first"))
    return placed.drop("_m", "_task", "_before", "_first")
