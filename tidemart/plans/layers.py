"""The four layers: as lazy frames (:class:`Warehouse`) and as stored tables (:func:`build_layers`)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions.scalars import DateLike
from tidemart.plans import dwh, marts, staging
from tidemart.plans.steps import STEPS, in_order
from tidemart.schemas import RAW_COLUMNS
from tidemart.session import freed_shuffles
from tidemart.sources.driver_tables import ALL_LOOKUPS, RawTables, raw_tables

LAYERS = ("raw", "staging", "dwh", "mart")

# Fact and mart tables are read by date range, then by these columns.
CLUSTERING = {
    "dwh.fact_orders": ("order_date", ["customer_id"]),
    "dwh.fact_order_items": ("order_date", ["product_id", "customer_id"]),
    "dwh.fact_subscription_events": ("event_date", ["customer_id"]),
    "mart.daily_sales": ("order_date", ["channel"]),
    "mart.daily_product_demand": ("order_date", ["product_id"]),
    "mart.customer_features": ("snapshot_date", ["customer_id"]),
    "mart.order_transaction_features": ("order_date", ["customer_id"]),
}

# Ids and amounts, most of what is stored, take a third less than by Parquet's usual codec.
STORED = {"compression": "zstd"}


class Warehouse:
    """Staging, dimensions, facts and marts over RAW frames. Nothing runs until an action does."""

    def __init__(self, raw: RawTables):
        self.raw = raw
        self.as_of = raw.as_of

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str, lookups: frozenset[str] | set[str] = ALL_LOOKUPS) -> "Warehouse":
        return cls(raw_tables(spark, sf_dir, frozenset(lookups)))

    def staged(self, table: str) -> DataFrame:
        return staging.clean(self.raw.table(table), table)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return dwh.dim_customer(self.staged("customers"))

    @cached_property
    def dim_product(self) -> DataFrame:
        return dwh.dim_product(self.staged("products"))

    @cached_property
    def dim_date(self) -> DataFrame:
        return dwh.dim_date(dwh.days_until(F.col("order_date"), F.col("order_date"), self.fact_orders))

    @cached_property
    def fact_orders(self) -> DataFrame:
        return dwh.fact_orders(self.staged("orders"))

    @cached_property
    def fact_order_items(self) -> DataFrame:
        return dwh.fact_order_items(self.staged("order_items"), staging.clean(self.raw.order_heads, "orders"))

    @cached_property
    def fact_subscription_events(self) -> DataFrame:
        return dwh.fact_subscription_events(self.staged("subscriptions"))

    @cached_property
    def daily_sales(self) -> DataFrame:
        return marts.daily_sales(self.fact_orders)

    @cached_property
    def daily_product_demand(self) -> DataFrame:
        return marts.daily_product_demand(self.fact_order_items)

    @cached_property
    def customer_features(self) -> DataFrame:
        return marts.customer_features(self.dim_customer, self.fact_orders, self.as_of)

    @cached_property
    def latest_features(self) -> DataFrame:
        return marts.latest_customer_features(self.dim_customer, self.fact_orders, self.as_of)

    @cached_property
    def order_features(self) -> DataFrame:
        # Items meet their orders in the mart's own join; joining them to the fact first adds nothing.
        return marts.order_transaction_features(self.fact_orders, self.staged("order_items"))

    def marts(self) -> dict[str, DataFrame]:
        return {
            "daily_sales": self.daily_sales,
            "daily_product_demand": self.daily_product_demand,
            "customer_features": self.customer_features,
            "order_transaction_features": self.order_features,
        }


def create_namespaces(spark: SparkSession, prefix: str = "") -> None:
    for layer in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer}")


def clustered(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Range-partition by day and cluster columns and sort within.

    Ranges split a hot day or key over several files, and narrow ranges per file let the reader
    skip row groups. The partition column is the month: one folder per day would be too many.
    It leads the sort, which changes no order but saves the writer a second sort by it.
    """
    return (
        df.repartitionByRange(day, *columns)
        .withColumn("part_month", F.trunc(day, "month"))
        .sortWithinPartitions("part_month", day, *columns)
    )


def save_table(df: DataFrame, name: str, prefix: str = "", if_absent: bool = False) -> None:
    """Create or replace ``<prefix><layer>.<table>``; ``if_absent`` keeps an existing one."""
    mode = "ignore" if if_absent else "overwrite"
    if name in CLUSTERING:
        day, columns = CLUSTERING[name]
        writer = clustered(df, day, columns).write.partitionBy("part_month")
    else:
        writer = df.write
    with freed_shuffles(df.sparkSession):
        writer.options(**STORED).mode(mode).option("partitionOverwriteMode", "static").format("parquet").saveAsTable(prefix + name)


def read_layer_table(spark: SparkSession, name: str, prefix: str = "") -> DataFrame:
    df = spark.table(prefix + name)
    return df.drop("part_month") if name in CLUSTERING else df


def load_raw(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Replace the RAW tables by the given frames, declared columns only."""
    for name, df in tables.items():
        save_table(df.select(*RAW_COLUMNS[name]), f"raw.{name}", prefix)


def build_layers(spark: SparkSession, as_of: DateLike, prefix: str = "") -> list[str]:
    """Rebuild STAGING, DWH and MART from the RAW tables, each layer from the stored one below.

    Tables are replaced one by one; :class:`tidemart.plans.store.LayerStore` swaps all at once.
    """
    create_namespaces(spark, prefix)
    order = in_order(STEPS)
    for name in order:
        step = STEPS[name]
        save_table(step.frame(as_of, *[read_layer_table(spark, i, prefix) for i in step.inputs]), name, prefix)
    return order
