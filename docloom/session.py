"""Session helpers shared by the operators: tables, checkpoints, batch sizes."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder takes its place, for the whole
    session, on one machine (tests); on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str, *spent: DataFrame) -> DataFrame:
    """`df` written as a Parquet table in the shared folder, and read again.

    Cuts the lineage: what follows does not recompute `df` if executors go.
    The files lie below the application's id, to be removed with it; those of
    the `spent` tables, which nothing reads any more, are removed at once, and
    so are the shuffle files that `df` needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    drop(*spent)
    return out


def drop(*spent: DataFrame) -> None:
    """Removes the files of tables that `cut` has written."""
    for table in spent:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that the driver's Python no longer uses back to the machine; glibc would keep it for the session."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows that an Arrow batch hands to Python, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where its files give fewer partitions than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
