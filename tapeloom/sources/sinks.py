"""Writers, incremental loads and rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files one task keeps open at once; beyond it the rest of its rows are sorted by file.
OPEN_FILES_KEY, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 64


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Write, or leave an existing table alone when ``overwrite`` is off."""
    w = df.write.mode("overwrite" if overwrite else "ignore")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, dates: Sequence[str] = (), decimals: int = 3, overwrite: bool = False) -> None:
    """CSV with ISO days and fixed decimals."""
    cols = {d: F.date_format(d, "yyyy-MM-dd") for d in dates}
    cols |= {n: F.format_string(f"%.{decimals}f", F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    df.withColumns(cols).write.mode("overwrite" if overwrite else "ignore").csv(path, header=True)


def write_prediction_files(scores: DataFrame, path: str, name: str, folder: Sequence[str] = (), seed: str = "seed", step: str = "step") -> None:
    """One CSV file per model run, named ``{name}_{seed}_{step}.csv``, without the step where it is null.

    ``folder``: columns whose values are sub-folders. The columns named here are in the path only. A run's scores are
    written by one task, as the format wants one file; the task keeps up to ``OPEN_FILES`` files open and passes rows on as
    they come. Spark's usual way sorts a task's rows by file first, so one task would hold whole runs.
    """
    from tapeloom.sources.stored import Folder

    end = F.concat_ws("_", F.lit(name), F.col(seed).cast("string"), F.col(step).cast("string"))
    keys = [*folder, "_run"]
    rows = scores.withColumn("_run", end).drop(seed, step)
    conf, before = scores.sparkSession.conf, scores.sparkSession.conf.get(OPEN_FILES_KEY, "0")
    conf.set(OPEN_FILES_KEY, str(OPEN_FILES))
    try:
        rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys).csv(path, header=True)
    finally:
        conf.set(OPEN_FILES_KEY, before)
    disk = Folder(scores.sparkSession, path)

    def give_names(at: str, depth: int) -> None:
        for sub in disk.names(at):
            if "=" not in sub:
                continue
            below, value = f"{at}/{sub}", sub.split("=", 1)[1]
            if depth < len(folder):
                give_names(below, depth + 1)
                continue
            (part,) = [n for n in disk.names(below) if n.endswith(".csv")]
            disk.rename(f"{below}/{part}", f"{at}/{value}.csv")
            disk.delete(below)

    give_names(path, 0)


def write_advice_json(report: DataFrame, path: str) -> None:
    """Factor names per advice with their count. One row per factor, so lists are short."""
    report.groupBy("final_advice").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("factor")).alias("factors")
    ).write.mode("overwrite").json(path)


def write_report_csv(report: DataFrame, path: str, nested: Sequence[str] = ("rankic_ts",), loadings: DataFrame | None = None) -> None:
    """Report without its nested series, and the loading matrix beside it."""
    report.drop(*nested).write.mode("overwrite").csv(f"{path}/report", header=True)
    if loadings is not None:
        loadings.write.mode("overwrite").csv(f"{path}/loadings", header=True)


def needs_rebuild(stored: DataFrame | None, required: Sequence[str]) -> bool:
    """A stored table without a required column is computed anew."""
    return stored is None or not set(required) <= set(stored.columns)


def new_rows(source: DataFrame, stored: DataFrame, inst: str = "inst", dt: str = "dt") -> DataFrame:
    """Source rows after the stored newest day of their instrument; unknown instruments whole."""
    mark = stored.groupBy(inst).agg(F.max(dt).alias("_mark"))
    return source.join(mark, inst, "left").where(F.col("_mark").isNull() | (F.col(dt) > F.col("_mark"))).drop("_mark")


def append_new_days(source: DataFrame, stored: DataFrame | None, compute, required: Sequence[str], inst: str = "inst", dt: str = "dt") -> DataFrame:
    """Stored rows plus ``compute`` of the new days, or everything when the columns drifted. ``stored.StoredTable`` keeps the table."""
    if needs_rebuild(stored, required):
        return compute(source)
    return stored.unionByName(compute(new_rows(source, stored, inst, dt)).select(*stored.columns))


def truncate_after(spark: SparkSession, path: str, day: str, out: str, dt: str = "dt") -> DataFrame:
    """Keep rows up to ``day`` and write them to ``out`` (a table cannot overwrite its own input)."""
    kept = spark.read.parquet(path).where(F.col(dt) <= F.lit(day).cast("date"))
    kept.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def latest_day(df: DataFrame, dt: str = "dt") -> DataFrame:
    return df.where(F.col(dt) == df.agg(F.max(dt)).scalar())
