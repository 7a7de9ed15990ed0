"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the plans rely on. Skewed join keys are split at run time by AQE.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SQL_SETTINGS` to a session and return it."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables and stream checkpoints.

    On a cluster it lies under ``spark.checkpoint.dir``, which every executor can reach. Only a
    local session without that setting falls back to the machine's temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tidemart-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Spark's setting that deletes what a job has shuffled when the job ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def conf_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds within the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs within leave no shuffle files behind; else these stay until the driver collects its garbage.

    For jobs whose result is written or collected once, as many small ones together leave a file per task and exchange.
    """
    return conf_set(spark, _FREE_SHUFFLES, "true")


def python_tasks(df: DataFrame, at_most: int | None = None) -> int:
    """Number of partitions for groups whose cost is computing, not bytes.

    AQE sizes partitions by bytes and would put many small but slow groups into one task; it
    leaves an explicit number alone.
    """
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return n if at_most is None else min(n, at_most)


#: Bytes of input for which :func:`materialise` makes a slice.
SLICE_BYTES = 512 << 20


def slices(df: DataFrame, by: str | None, n: int) -> list[DataFrame]:
    """The rows of a frame in ``n`` parts by the hash of a column.

    To be written one after the other, each with its shuffle files freed. Where the column comes unchanged through all
    exchanges the filter goes down to the inputs, else only the rows are the same.
    """
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)]


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a frame reads, each as often as it is read; inputs of unknown size count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # Spark's own word for unknown is the largest number


def materialise(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """Write a frame to the scratch folder and read it back, large ones in slices of ``by`` if that is given.

    For results that several later steps read and that are costly to compute again. Unlike a
    cached frame the written table outlives the executors that made it.
    """
    path = scratch_dir(df.sparkSession, purpose)
    n = 1 + input_bytes(df) // SLICE_BYTES if by else 1
    with freed_shuffles(df.sparkSession):
        for part in slices(df, by, n):
            part.write.mode("append").parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting for the bytes of files that a task reads.
_READ_BYTES = "spark.sql.files.maxPartitionBytes"


@contextmanager
def materialised(df: DataFrame, purpose: str, task_bytes: int) -> Iterator[DataFrame]:
    """:func:`materialise` for a while: the files go when the block ends. A good deal smaller than a cached frame.

    Rows are smaller than elsewhere, so a task within reads ``task_bytes`` of them at most.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    try:
        with freed_shuffles(spark):
            df.write.option("parquet.block.size", task_bytes // 2).parquet(path, compression="zstd")
        with conf_set(spark, _READ_BYTES, str(task_bytes)):
            yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
