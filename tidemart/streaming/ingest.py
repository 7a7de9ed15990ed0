"""Ingest of landed files into RAW: one stream per table, each run date held once.

A stream sees every landed file once. Its batches name the run dates that have new files; these dates are read whole
from the landing zone and replace what RAW has of them, so a date that is landed again with changed rows is not loaded
twice, and a batch that is repeated after a failure changes nothing. A ledger has a row per load.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructType

from tidemart.schemas import RAW_COLUMNS, RAW_SCHEMAS
from tidemart.sources.landing import EXTRACT_TABLES

LEDGER = "table_name string, run_date date, batch_id bigint, n_rows bigint"


def _dated(table: str) -> StructType:
    return StructType([*RAW_SCHEMAS[table].fields]).add("run_date", DateType())


def landed_stream(spark: SparkSession, table: str, landing: str, max_files: int | None = None) -> DataFrame:
    """New files of ``<landing>/<table>/run_date=*/`` in the declared RAW schema, with their run date.

    Columns match by name, whatever their case.
    """
    reader = spark.readStream.schema(_dated(table))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{landing}/{table}").select(*RAW_COLUMNS[table], "run_date")


def replace_dates(spark: SparkSession, table: str, landing: str, raw: str, dates: list, batch_id: int) -> None:
    """Copy the named run dates from the landing zone over those of RAW and note them in the ledger."""
    landed = spark.read.schema(_dated(table)).parquet(f"{landing}/{table}").where(F.col("run_date").isin(dates))
    (
        landed.select(*RAW_COLUMNS[table], "run_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(f"{raw}/{table}")
    )
    stored = spark.read.schema(_dated(table)).parquet(f"{raw}/{table}").where(F.col("run_date").isin(dates))
    (
        stored.groupBy("run_date")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(table).alias("table_name"), "run_date", F.lit(batch_id).cast("bigint").alias("batch_id"), "n_rows")
        .coalesce(1)
        .write.mode("append")
        .parquet(f"{raw}/_ledger_of/{table}")
    )


def start_ingest(
    spark: SparkSession, table: str, landing: str, raw: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Load run dates with files not seen before into ``<raw>/<table>`` and stop when there are none left."""

    def load(batch: DataFrame, batch_id: int) -> None:
        dates = [r.run_date for r in batch.select("run_date").distinct().collect()]
        if dates:
            replace_dates(batch.sparkSession, table, landing, raw, dates, batch_id)

    return (
        landed_stream(spark, table, landing, max_files)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", f"{checkpoint}/{table}")
        .trigger(availableNow=True)
        .start()
    )


def ingest_all(spark: SparkSession, landing: str, raw: str, checkpoint: str) -> None:
    """One stream per RAW table; all run at the same time."""
    streams = [start_ingest(spark, t, landing, raw, checkpoint) for t in EXTRACT_TABLES]
    for stream in streams:
        stream.awaitTermination()


def read_raw(spark: SparkSession, table: str, raw: str) -> DataFrame:
    """All run dates of a RAW table, declared columns."""
    return spark.read.schema(RAW_SCHEMAS[table]).parquet(f"{raw}/{table}").select(*RAW_COLUMNS[table])


def ledger(spark: SparkSession, raw: str) -> DataFrame:
    """The newest load of each table and run date: table_name, run_date, batch_id, n_rows."""
    out = spark.createDataFrame([], LEDGER)
    for table in EXTRACT_TABLES:
        try:
            out = out.unionByName(spark.read.schema(LEDGER).parquet(f"{raw}/_ledger_of/{table}"))
        except AnalysisException as e:  # nothing loaded yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    newest = F.max(F.struct("batch_id", "n_rows")).alias("newest")
    return out.groupBy("table_name", "run_date").agg(newest).select("table_name", "run_date", "newest.*")
