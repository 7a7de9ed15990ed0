"""STAGING to DWH: dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.functions.scalars import DateLike, as_date, date_range, is_weekend


def dim_customer(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "region", "plan_type", "signup_date", "churn_date", "is_active")


def dim_product(products: DataFrame) -> DataFrame:
    return products.select("product_id", "category", "unit_price", "launch_date")


def dim_date(bounds: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """One row per day of a one-row frame with columns ``start`` and ``stop``.

    ``holidays`` is an optional table with a ``date`` column; without it no day is a holiday.
    """
    days = bounds.select(F.explode(date_range(F.col("start"), F.col("stop"))).alias("date"))
    out = days.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofweek("date").alias("day_of_week"),
        is_weekend("date").alias("is_weekend"),
    )
    if holidays is None:
        return out.withColumn("is_holiday_jp", F.lit(False))
    marks = holidays.select("date").distinct().withColumn("marked", F.lit(True))
    return out.join(marks, "date", "left").select(
        *out.columns, F.coalesce("marked", F.lit(False)).alias("is_holiday_jp")
    )


def fact_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id", "customer_id", "order_date", "channel", "region", "order_amount", "item_count", "status"
    )


def fact_order_items(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    heads = orders.select("order_id", "order_date", "customer_id")
    return order_items.join(heads, "order_id").select(
        "order_item_id",
        "order_id",
        "order_date",
        "product_id",
        "customer_id",
        "quantity",
        "unit_price",
        "discount_pct",
    )


def fact_subscription_events(subscriptions: DataFrame) -> DataFrame:
    """Started and cancelled events from one scan: each row yields one or two."""
    event = lambda day, kind: F.struct(F.col(day).alias("event_date"), F.lit(kind).alias("event_type"))
    started, cancelled = event("start_date", "started"), event("end_date", "cancelled")
    events = F.when(F.col("end_date").isNotNull(), F.array(started, cancelled)).otherwise(F.array(started))
    return subscriptions.select(
        "subscription_id", "customer_id", "plan", "mrr", F.explode(events).alias("e")
    ).select("subscription_id", "customer_id", "e.event_date", "e.event_type", "plan", "mrr")


def days_until(start: DateLike, stop: DateLike, source: DataFrame) -> DataFrame:
    """One-row ``start``/``stop`` frame for :func:`dim_date`."""
    return source.agg(F.min(as_date(start)).alias("start"), F.max(as_date(stop)).alias("stop"))
