"""Landing zone: dated Parquet copies of the source tables, and the extract job."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.schemas import RAW_COLUMNS, RAW_SCHEMAS

log = logging.getLogger(__name__)

EXTRACT_TABLES = ["customers", "subscriptions", "products", "orders", "order_items"]


def read_parquet(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Parquet scan with the declared schema; columns match by name, whatever their case."""
    return spark.read.schema(RAW_SCHEMAS[table]).parquet(path)


def write_landing(df: DataFrame, table: str, root: str, run_date: dt.date) -> str:
    """Write ``<root>/<table>/run_date=<date>/``; a second run of a date replaces that date only."""
    (
        df.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(f"{root}/{table}")
    )
    return f"{root}/{table}/run_date={run_date.isoformat()}"


@dataclass(frozen=True)
class ObjectStore:
    """Target of the upload step, for example ``s3a://bucket/prefix``; unset means no upload."""

    url: str | None = None

    @property
    def configured(self) -> bool:
        return bool(self.url)


def publish(
    spark: SparkSession, landed: str, table: str, run_date: dt.date, store: ObjectStore, strict: bool = False
) -> bool:
    """Copy one landed date to the object store with the same layout. True when written.

    Without a configured store, or when the write fails, this logs and returns False; with
    ``strict`` it raises.
    """
    if not store.configured:
        if strict:
            raise RuntimeError("object store is not configured")
        log.info("upload of %s skipped: object store is not configured", table)
        return False
    try:
        write_landing(spark.read.schema(RAW_SCHEMAS[table]).parquet(landed), table, store.url, run_date)
        return True
    except Exception:
        if strict:
            raise
        log.warning("upload of %s failed; the landed copy is unaffected", table, exc_info=True)
        return False


def run_extract(
    spark: SparkSession,
    extract: Callable[[str], DataFrame],
    root: str,
    run_date: dt.date,
    store: ObjectStore = ObjectStore(),
    strict: bool = False,
) -> list[str]:
    """Extract, land and upload all five tables; returns the landed paths."""
    written = []
    for table in EXTRACT_TABLES:
        df = extract(table).select(*RAW_COLUMNS[table])
        path = write_landing(df, table, root, run_date)
        written.append(path)
        publish(spark, path, table, run_date, store, strict)
    return written
