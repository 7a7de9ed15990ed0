"""DWH to MART: one feature table per use case."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.functions.scalars import (
    DateLike,
    as_date,
    eligible_at,
    in_forward_window,
    in_trailing_window,
    safe_divide,
)
from tidemart.operators.pit import previous_day_gap, snapshot_bounds, snapshot_rollup

TOP_PRODUCTS = 20
LABEL_HORIZON_DAYS = 30
SNAPSHOT_INTERVAL_DAYS = 30
FEATURE_WINDOW_DAYS = 90
FIRST_SNAPSHOT_OFFSET_DAYS = 180

# What stands in for a missing value where a model needs a number.
MISSING_RECENCY_DAYS = 9999
MISSING_GAP_HOURS = 24 * 365


def daily_sales(fact_orders: DataFrame) -> DataFrame:
    return fact_orders.groupBy("order_date", "channel").agg(F.sum("order_amount").alias("total_amount"))


def product_revenue(fact_order_items: DataFrame) -> DataFrame:
    """Revenue by product; discounts are not deducted."""
    return fact_order_items.groupBy("product_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("revenue")
    )


def top_products(fact_order_items: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    return product_revenue(fact_order_items).orderBy(F.desc("revenue"), "product_id").limit(n)


def daily_product_demand(fact_order_items: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """Units sold by day and product, for the ``n`` products with the most revenue.

    The ids, ``n`` at most, are found first and broadcast, so that only their rows are summed by day.
    """
    ids = top_products(fact_order_items, n).select("product_id")
    chosen = fact_order_items.join(F.broadcast(ids), "product_id", "left_semi")
    return chosen.groupBy("order_date", "product_id").agg(F.sum("quantity").alias("quantity_sold"))


def customer_features_at(
    dim_customer: DataFrame,
    fact_orders: DataFrame,
    snapshot: DateLike,
    window_days: int = FEATURE_WINDOW_DAYS,
) -> DataFrame:
    """Features of every customer eligible at one snapshot date."""
    at = as_date(snapshot)
    recent = in_trailing_window("order_date", at, window_days)
    stats = (
        fact_orders.where(F.col("order_date") <= at)
        .groupBy("customer_id")
        .agg(
            F.count_if(recent).alias("frequency"),
            F.sum(F.when(recent, F.col("order_amount")).otherwise(F.lit(0))).alias("monetary"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    base = dim_customer.where(eligible_at("signup_date", "churn_date", at))
    return _feature_columns(
        base.join(stats, "customer_id", "left")
        .withColumn("snapshot_date", at)
        .na.fill({"frequency": 0, "monetary": 0})
    )


def _feature_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "customer_id",
        "snapshot_date",
        F.datediff("snapshot_date", "last_order_date").alias("recency_days"),
        F.col("frequency").alias("frequency_90d"),
        F.col("monetary").alias("monetary_90d"),
        safe_divide("monetary", "frequency").alias("avg_order_value"),
        F.datediff("snapshot_date", "signup_date").alias("tenure_days"),
        "plan_type",
        "region",
        "churn_date",
    )


def with_churn_label(features: DataFrame, horizon_days: int = LABEL_HORIZON_DAYS) -> DataFrame:
    """Adds ``churned_next_30d`` from (snapshot, snapshot + horizon] and drops ``churn_date``."""
    return features.withColumn(
        "churned_next_30d", in_forward_window("churn_date", "snapshot_date", horizon_days)
    ).drop("churn_date")


def snapshot_grid(dim_customer: DataFrame, as_of: dt.date, label_horizon_days: int) -> tuple[dt.date, dt.date]:
    """First and last possible snapshot date, from one small job over the signup dates."""
    first_signup = dim_customer.agg(F.min("signup_date")).first()[0] or as_of
    return (
        first_signup + dt.timedelta(days=FIRST_SNAPSHOT_OFFSET_DAYS),
        as_of - dt.timedelta(days=label_horizon_days),
    )


def customer_features(
    dim_customer: DataFrame,
    fact_orders: DataFrame,
    as_of: dt.date,
    label_horizon_days: int = LABEL_HORIZON_DAYS,
    interval_days: int = SNAPSHOT_INTERVAL_DAYS,
    window_days: int = FEATURE_WINDOW_DAYS,
) -> DataFrame:
    """Labelled features at every snapshot from first signup + 180 days to as_of - horizon."""
    start, stop = snapshot_grid(dim_customer, as_of, label_horizon_days)
    rolled = snapshot_rollup(
        dim_customer.select("customer_id", "region", "plan_type", "signup_date", "churn_date"),
        fact_orders,
        start=start,
        stop=stop,
        interval_days=interval_days,
        window_days=window_days,
    )
    return with_churn_label(_feature_columns(rolled), label_horizon_days)


def latest_snapshot(features: DataFrame) -> DataFrame:
    """Rows of the newest snapshot in a stored feature table."""
    newest = features.agg(F.max("snapshot_date")).scalar()
    return features.where(F.col("snapshot_date") == newest)


def latest_customer_features(
    dim_customer: DataFrame,
    fact_orders: DataFrame,
    as_of: dt.date,
    label_horizon_days: int = LABEL_HORIZON_DAYS,
    interval_days: int = SNAPSHOT_INTERVAL_DAYS,
) -> DataFrame:
    """The newest snapshot of :func:`customer_features` without building the older ones.

    Which snapshot is the newest depends on the customers alone.
    """
    start, stop = snapshot_grid(dim_customer, as_of, label_horizon_days)
    first, last = snapshot_bounds(start, stop, interval_days, F.col("signup_date"), F.col("churn_date"))
    spans = dim_customer.select(first.alias("lo"), last.alias("hi")).where(F.col("lo") <= F.col("hi"))
    newest = spans.agg(F.max("hi")).first()[0] or 0
    snapshot = start + dt.timedelta(days=newest * interval_days)
    return with_churn_label(customer_features_at(dim_customer, fact_orders, snapshot), label_horizon_days)


def resolved_labels(features: DataFrame, as_of: DateLike, horizon_days: int = LABEL_HORIZON_DAYS) -> DataFrame:
    """Rows whose whole label window lies in the past."""
    return features.where(F.col("snapshot_date") <= F.date_sub(as_date(as_of), horizon_days))


def order_item_averages(fact_order_items: DataFrame) -> DataFrame:
    return fact_order_items.groupBy("order_id").agg(
        F.avg(F.col("unit_price").cast("double")).alias("avg_unit_price"),
        F.avg(F.col("discount_pct").cast("double")).alias("discount_pct"),
    )


def order_transaction_features(
    fact_orders: DataFrame,
    fact_order_items: DataFrame,
    window_days: int | None = None,
    as_of: DateLike | None = None,
    how: str = "inner",
) -> DataFrame:
    """Per-order features. The previous order is looked up over all history, then filtered.

    ``how="left"`` also keeps orders without items.
    """
    heads = fact_orders.select("order_id", "order_date", "customer_id", "order_amount", "item_count")
    gaps = previous_day_gap(heads.join(order_item_averages(fact_order_items), "order_id", how))
    if window_days is not None:
        if as_of is None:
            raise ValueError("window_days needs as_of")
        gaps = gaps.where(F.col("order_date") >= F.date_sub(as_date(as_of), window_days))
    return gaps.select(
        "order_id",
        "order_date",
        "customer_id",
        "order_amount",
        "item_count",
        "discount_pct",
        "avg_unit_price",
        "hours_since_last_order",
    )


def model_ready_customers(features: DataFrame) -> DataFrame:
    """Feature table with numbers in place of NULLs, all features as double."""
    numeric = ["recency_days", "frequency_90d", "monetary_90d", "avg_order_value", "tenure_days"]
    return features.withColumns({c: F.col(c).cast("double") for c in numeric}).na.fill(
        {"recency_days": float(MISSING_RECENCY_DAYS), "avg_order_value": 0.0}
    )


def model_ready_orders(features: DataFrame) -> DataFrame:
    numeric = ["order_amount", "item_count", "discount_pct", "avg_unit_price", "hours_since_last_order"]
    return (
        features.withColumns({c: F.col(c).cast("double") for c in numeric})
        .na.fill({"hours_since_last_order": float(MISSING_GAP_HOURS)})
        .na.fill(0.0, subset=numeric)
    )
