"""Projection, filter and cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def safe_double(c: Column) -> Column:
    """Bad text becomes null. Text that spells NaN or infinity is a number to Spark; see ``finite``."""
    return c.try_cast("double")


def safe_date(c: Column) -> Column:
    return c.try_cast("date")


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def positive_or_null(c: Column) -> Column:
    return F.when(c > 0, c)


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def default_date(c: Column, day: str = "1990-01-01") -> Column:
    return F.coalesce(c, F.lit(day).cast("date"))


def whitelist(df: DataFrame, keep: Sequence[str], extra: Sequence[str] = ("label",)) -> DataFrame:
    """Named features in frame order, then the extra columns."""
    wanted = set(keep) - set(extra)
    return df.select(*[c for c in df.columns if c in wanted], *[c for c in extra if c in df.columns])


def traded_only(df: DataFrame, volume: str = "volume", amount: str = "amount") -> DataFrame:
    """Drop days with no volume and no amount; a missing value is not zero and stays."""
    idle = (F.col(volume) == 0) & (F.col(amount) == 0)
    return df.where(~F.coalesce(idle, F.lit(False)))


def is_continuous(symbol: Column) -> Column:
    """Continuous-contract id: ends in 88 after a non-digit (pattern fixed)."""
    return symbol.rlike("[^0-9]88$")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last by ``order``.

    A struct minimum or maximum does it, so duplicates collapse map-side and a key with
    very many copies is no hot window.
    """
    others = [c for c in df.columns if c not in keys]
    pick = F.max if keep == "last" else F.min
    rest = [c for c in others if c not in order]
    row = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_r"))
    return row.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def split_segments(df: DataFrame, segments: Mapping[str, tuple[str, str]], dt: str = "dt") -> dict[str, DataFrame]:
    return {n: df.where(F.col(dt).between(F.lit(a).cast("date"), F.lit(b).cast("date"))) for n, (a, b) in segments.items()}


def full_history(df: DataFrame, inst: str = "inst", dt: str = "dt") -> DataFrame:
    """Instruments whose first day is the first day of all."""
    first = df.agg(F.min(dt)).scalar()
    names = df.groupBy(inst).agg(F.min(dt).alias("_first")).where(F.col("_first") <= first).select(inst)
    return df.join(names, inst, "left_semi")


def long_members(spans: DataFrame, day: str) -> DataFrame:
    """Spans that began by ``day`` and reach the newest end day."""
    return spans.where((F.col("start_date") <= F.lit(day).cast("date")) & (F.col("end_date") == spans.agg(F.max("end_date")).scalar()))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean_predictions(df: DataFrame, dt: str = "datetime", inst: str = "instrument", score: str = "score") -> DataFrame:
    require_columns(df, [dt, inst, score])
    cast = df.withColumns({dt: F.col(dt).try_cast("date"), inst: F.col(inst).cast("string"), score: finite(F.col(score).try_cast("double"))})
    return cast.na.drop(subset=[score])


def score_variants(df: DataFrame, score: str, other: str) -> DataFrame:
    """Two score columns side by side: the plain one, and the one kept where ``other`` is positive."""
    return df.where(F.col(score).isNotNull()).withColumns({
        "score_plain": F.col(score), "score_gated": F.when(F.col(other) > 0, F.col(score)),
    })


def limit_class(code: Column) -> Column:
    """Daily move limit by numeric code (bounds and limits are fixed values)."""
    return (
        F.when(code < 300000, 0.095)
        .when(code < 400000, 0.195)
        .when(code < 680000, 0.095)
        .when(code < 800000, 0.195)
        .otherwise(0.295)
    )


# First-level industry code to industry index.
INDUSTRY_INDEX = {
    "10": "CI005001.INDX",
    "11": "CI005002.INDX",
    "12": "CI005003.INDX",
    "20": "CI005004.INDX",
    "21": "CI005005.INDX",
    "22": "CI005006.INDX",
    "23": "CI005007.INDX",
    "24": "CI005008.INDX",
    "25": "CI005009.INDX",
    "26": "CI005010.INDX",
    "27": "CI005011.INDX",
    "28": "CI005012.INDX",
    "30": "CI005013.INDX",
    "31": "CI005014.INDX",
    "32": "CI005015.INDX",
    "33": "CI005016.INDX",
    "34": "CI005017.INDX",
    "35": "CI005018.INDX",
    "36": "CI005019.INDX",
    "37": "CI005020.INDX",
    "40": "CI005021.INDX",
    "41": "CI005022.INDX",
    "42": "CI005023.INDX",
    "43": "CI005030.INDX",
    "50": "CI005024.INDX",
    "60": "CI005025.INDX",
    "61": "CI005026.INDX",
    "62": "CI005027.INDX",
    "63": "CI005028.INDX",
    "70": "CI005029.INDX",
}


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Small fixed dictionary as a map literal; unknown keys give null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns are replaced by their fields, last name part kept."""
    return df.select(*[f"{n}.*" if t.startswith("struct") else F.col(n) for n, t in df.dtypes])


def fill_both_ways(
    df: DataFrame, columns: Sequence[str], inst: str = "inst", dt: str = "dt", default: float | None = None
) -> DataFrame:
    """Forward fill, then backward fill, then ``default``, per instrument by day.

    After the forward fill only leading gaps are left, and for those the next value is
    the first known one of the instrument: a whole-partition frame, linear in its rows,
    where a frame that looks ahead would be quadratic.
    """
    w = Window.partitionBy(inst).orderBy(dt)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {}
    for c in columns:
        parts = [F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)]
        filled[c] = F.coalesce(*parts, *([F.lit(default)] if default is not None else []))
    return df.withColumns(filled)


def advice_columns(report: DataFrame, gates: DataFrame, advice: str = "KEEP_CORE") -> DataFrame:
    """Names with the given advice, sorted, then gate names not yet among them, each once."""
    kept = report.where(F.col("final_advice") == advice).select("factor").distinct().withColumn("part", F.lit(0))
    extra = gates.select("factor").distinct().join(kept, "factor", "left_anti").withColumn("part", F.lit(1))
    return kept.unionByName(extra).orderBy("part", "factor")
