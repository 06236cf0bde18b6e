"""Where intermediate tables live: the folder the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING = threading.Lock()
_cleaning: dict[str, tuple[int, str]] = {}  # session: writes under way, setting before the first


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder set on its context.

    A local session without one gets a temporary folder; on a cluster that would not be
    visible to all executors, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="textveil-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


MOST_ROWS = 100_000  # that one task reads, before the table is dealt out anew


def spread_small(df: DataFrame) -> DataFrame:
    """Deal out a table that the cores would read unevenly, or in tasks of very many rows.

    A file is cut by its bytes, but a row group is read whole by one task: of many splits of one
    large row group, all but one are empty. Detection is bound by CPU, so what counts are the rows
    of each split; counting them reads no column. A table with even splits is returned as it is
    and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("split")).agg(
        F.count(F.lit(1)).alias("n")).collect()]
    total, most = sum(counts), max(counts, default=0)
    if most <= MOST_ROWS and most * cores <= 2 * total and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * max(1, -(-2 * total // (MOST_ROWS * cores))))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/textveil/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all tables that this application has staged; results that read them are void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


ROW = "_veil_row"


def with_row(df: DataFrame) -> DataFrame:
    """Add an id of each row, unique whatever the keys; stable once the table is staged."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of a write go once it is done, not when the driver happens to collect garbage.

    A staged table is read from its files, so nothing comes back to them. The setting holds while
    any write of the session is under way: a table outside keeps its own, as it may be run again.
    """
    at = spark._jsparkSession.sessionUUID()
    with _CLEANING:
        writes, before = _cleaning.get(at, (0, ""))
        if not writes:
            before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _cleaning[at] = writes + 1, before
    try:
        yield
    finally:
        with _CLEANING:
            writes, before = _cleaning.pop(at)
            if writes > 1:
                _cleaning[at] = writes - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, split: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    With ``split``, a boolean column, its two values are kept in separate files, so that a
    consumer of one side reads nothing of the other.

    Cuts the lineage (a lost executor re-reads a file instead of re-running detection),
    lets several consumers share the work, and gives later joins real sizes.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if split:
        # two open writers per task instead of a sort of whole rows by the flag; set once and
        # for good, as other threads may write at the same time
        spark = df.sparkSession
        if spark.conf.get(_WRITERS) == "0":
            spark.conf.set(_WRITERS, "2")
        writer = df.write.partitionBy(split)
    else:
        writer = df.write
    with _shuffles_end(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
