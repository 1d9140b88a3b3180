"""Session defaults and the one place that decides where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Shuffle files go when the query that made them ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # a stack trace per column expression costs seconds on plans of some hundred columns
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there the driver and the
    executors are one process. Anywhere else a missing setting is an error, because a
    machine-local folder would lose data with its machine.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set; name a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-tapeloom-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a small table must stay the same for every reader (bucket edges, graph
    labels): its lineage is cut and a lost executor cannot change its values. The shuffles of the write end with it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stages: DataFrame) -> None:
    """Delete the folders of frames as ``materialize`` gave them, once nothing is left that reads them."""
    for df in stages:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
