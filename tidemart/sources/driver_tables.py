"""The five RAW tables expressed over TPC-H-shaped Parquet tables.

An order's ``item_count`` and ``region`` and a product's ``launch_date`` are functions of a key that the row already
carries. A plan that does not read them may leave them out of ``lookups``; they are then typed
NULL constants and the joins that would fetch them are not planned at all.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions.scalars import lookup, money
from tidemart.schemas import RAW_SCHEMAS

ALL_LOOKUPS = frozenset({"item_count", "order_region", "launch_date"})

# Monthly recurring revenue of each market segment.
SEGMENT_MRR = {
    "AUTOMOBILE": 980.0,
    "BUILDING": 1980.0,
    "FURNITURE": 2980.0,
    "HOUSEHOLD": 4980.0,
    "MACHINERY": 9800.0,
}

# A customer without an order for this many days counts as churned that long after the last one.
CHURN_GAP_DAYS = 365


@dataclass(frozen=True)
class RawTables:
    customers: DataFrame
    subscriptions: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    as_of: dt.date
    # The orders without their lookups, for plans that only need keys and dates.
    order_heads: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the declared schema of a RAW table and drop every other column."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMAS[table].fields])


def as_of_date(spark: SparkSession, sf_dir: str) -> dt.date:
    """Last order date, the run date of everything derived from these tables.

    One small job over one column. As a literal the date reaches scans and constant folding; as a
    subquery it would be planned again inside every plan that mentions it.
    """
    return read_table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]


def _customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return customer.join(nations, customer.c_nationkey == nations.n_nationkey, "left").select(
        "c_custkey", "c_mktsegment", F.col("r_name").alias("region")
    )


def raw_orders(spark: SparkSession, sf_dir: str, lookups: frozenset[str] = ALL_LOOKUPS) -> DataFrame:
    df = read_table(spark, sf_dir, "orders")
    if "item_count" in lookups:
        counts = (
            read_table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.count("*").alias("item_count"))
        )
        df = df.join(counts, "o_orderkey", "left").withColumn(
            "item_count", F.coalesce("item_count", F.lit(0))
        )
    else:
        df = df.withColumn("item_count", F.lit(None))
    if "order_region" in lookups:
        regions = _customer_region(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"), "region")
        df = df.join(regions, "o_custkey", "left")
    else:
        df = df.withColumn("region", F.lit(None))
    return conform(
        df.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_orderpriority").alias("channel"),
            "region",
            money("o_totalprice").alias("order_amount"),
            "item_count",
            F.col("o_orderstatus").alias("status"),
        ),
        "orders",
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return conform(
        line.join(part, line.l_partkey == part.p_partkey, "left").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("p_retailprice").alias("unit_price"),
            (F.col("l_discount") + F.lit(0.0)).alias("discount_pct"),
        ),
        "order_items",
    )


def raw_products(spark: SparkSession, sf_dir: str, lookups: frozenset[str] = ALL_LOOKUPS) -> DataFrame:
    df = read_table(spark, sf_dir, "part")
    if "launch_date" in lookups:
        line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        launched = (
            line.join(orders, line.l_orderkey == orders.o_orderkey)
            .groupBy(F.col("l_partkey").alias("p_partkey"))
            .agg(F.min(F.to_date("o_orderdate")).alias("launch_date"))
        )
        df = df.join(launched, "p_partkey", "left")
    else:
        df = df.withColumn("launch_date", F.lit(None))
    return conform(
        df.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("unit_price"),
            "launch_date",
        ),
        "products",
    )


def raw_customers(spark: SparkSession, sf_dir: str, as_of: dt.date) -> DataFrame:
    span = (
        read_table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min(F.to_date("o_orderdate")).alias("signup_date"),
            F.max(F.to_date("o_orderdate")).alias("last_date"),
        )
    )
    df = (
        _customer_region(spark, sf_dir)
        .join(span, "c_custkey", "left")
        .withColumn(
            "churn_date",
            F.when(
                F.col("last_date") < F.date_sub(F.lit(as_of), CHURN_GAP_DAYS),
                F.date_add("last_date", CHURN_GAP_DAYS),
            ),
        )
    )
    return conform(
        df.select(
            F.col("c_custkey").alias("customer_id"),
            "signup_date",
            "churn_date",
            F.col("churn_date").isNull().alias("is_active"),
            F.col("c_mktsegment").alias("plan_type"),
            "region",
        ),
        "customers",
    )


def raw_subscriptions(customers: DataFrame) -> DataFrame:
    return conform(
        customers.select(
            F.concat(F.lit("S"), "customer_id").alias("subscription_id"),
            "customer_id",
            F.col("plan_type").alias("plan"),
            lookup(SEGMENT_MRR, "plan_type").alias("mrr"),
            F.col("signup_date").alias("start_date"),
            F.col("churn_date").alias("end_date"),
            F.when(F.col("churn_date").isNull(), "active").otherwise("cancelled").alias("status"),
        ),
        "subscriptions",
    )


def raw_tables(spark: SparkSession, sf_dir: str, lookups: frozenset[str] = ALL_LOOKUPS) -> RawTables:
    as_of = as_of_date(spark, sf_dir)
    customers = raw_customers(spark, sf_dir, as_of)
    return RawTables(
        customers=customers,
        subscriptions=raw_subscriptions(customers),
        products=raw_products(spark, sf_dir, lookups),
        orders=raw_orders(spark, sf_dir, lookups),
        order_items=raw_order_items(spark, sf_dir),
        as_of=as_of,
        order_heads=raw_orders(spark, sf_dir, frozenset()),
    )
