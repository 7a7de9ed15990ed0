"""Facts stored in buckets: joins on the bucket keys need no exchange.

A table is partitioned by a coarse period of its day, bucketed and sorted by its keys. Two tables with the same keys and
number of buckets are joined bucket by bucket, whatever their size; a date range prunes periods. Each task writes one
bucket, so a period has one file per bucket. Buckets suit keys without hot values, such as order ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD = "part_period"


def save_bucketed(
    df: DataFrame, name: str, path: str, keys: list[str], buckets: int, day: str | None = None, period: str = "year"
) -> None:
    """Create or replace the table ``name`` with its files under ``path``; all columns are kept."""
    if day is not None:
        df = df.withColumn(PERIOD, F.trunc(day, period))
    writer = df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").option("path", path)
    writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(PERIOD) if day is not None else writer).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(PERIOD)


def read_days(spark: SparkSession, name: str, day: str, start, stop=None, period: str = "year") -> DataFrame:
    """Rows from ``start`` to ``stop`` (both included); periods outside are not read."""
    df = spark.table(name)
    df = df.where((F.col(PERIOD) >= F.trunc(F.lit(start), period)) & (F.col(day) >= F.lit(start)))
    if stop is not None:
        df = df.where((F.col(PERIOD) <= F.trunc(F.lit(stop), period)) & (F.col(day) <= F.lit(stop)))
    return df.drop(PERIOD)
