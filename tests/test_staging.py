from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import day
from tidemart.plans import dwh, staging
from tidemart.sources.driver_tables import conform


def test_defaults_and_keys(table):
    raw = table(
        "customers",
        [
            {"customer_id": "a", "churn_date": None, "is_active": None, "plan_type": None, "region": None},
            {"customer_id": "b", "churn_date": day(0), "is_active": None, "plan_type": "basic", "region": "x"},
            {"customer_id": None, "plan_type": "basic"},
        ],
    )
    rows = {r.customer_id: r for r in staging.clean(raw, "customers").collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].is_active, rows["a"].plan_type, rows["a"].region) == (True, "unknown", "unknown")
    assert rows["b"].is_active is False


def test_value_rules_drop_bad_and_null_values(table):
    orders = [{"order_id": str(i), "customer_id": "c", "order_amount": v} for i, v in enumerate([Decimal(0), Decimal(-1), None])]
    assert [r.order_id for r in staging.clean(table("orders", orders), "orders").collect()] == ["0"]
    products = [{"product_id": str(i), "unit_price": v} for i, v in enumerate([Decimal(1), Decimal(0), None])]
    assert [r.product_id for r in staging.clean(table("products", products), "products").collect()] == ["0"]
    items = [{"order_item_id": str(i), "order_id": "o", "quantity": v} for i, v in enumerate([1, 0, None])]
    assert [r.order_item_id for r in staging.clean(table("order_items", items), "order_items").collect()] == ["0"]


def test_distinct_is_over_whole_rows(table):
    row = {"order_id": "1", "customer_id": "c", "order_amount": Decimal(5), "status": "open"}
    raw = table("orders", [row] * 50 + [row | {"status": "closed"}])
    assert staging.clean(raw, "orders").count() == 2
    latest = staging.latest_by_key(raw.withColumn("v", F.when(F.col("status") == "closed", 2).otherwise(1)), "order_id", "v")
    assert [r.status for r in latest.collect()] == ["closed"]


def test_internal_columns_never_pass(table):
    raw = table("customers", [{"customer_id": "a"}]).withColumn("archetype", F.lit("loyal"))
    assert "archetype" not in conform(raw, "customers").columns
    assert "archetype" not in staging.clean(raw, "customers").columns


def test_subscription_events_and_calendar(spark, table):
    subs = table(
        "subscriptions",
        [
            {"subscription_id": "s1", "customer_id": "a", "start_date": day(-10), "end_date": None},
            {"subscription_id": "s2", "customer_id": "b", "start_date": day(-9), "end_date": day(-1)},
        ],
    )
    events = dwh.fact_subscription_events(subs)
    assert sorted((r.subscription_id, r.event_type, r.event_date) for r in events.collect()) == [
        ("s1", "started", day(-10)),
        ("s2", "cancelled", day(-1)),
        ("s2", "started", day(-9)),
    ]
    bounds = spark.range(1).select(F.lit(day(-6)).alias("start"), F.lit(day(0)).alias("stop"))
    holidays = spark.createDataFrame([(day(-3),)], "date date")
    days = dwh.dim_date(bounds, holidays).orderBy("date").collect()
    assert [d.is_holiday_jp for d in days] == [False, False, False, True, False, False, False]
    assert sum(d.is_weekend for d in days) == 2
    assert not any(d.is_holiday_jp for d in dwh.dim_date(bounds).collect())
