from __future__ import annotations

import datetime as dt
from decimal import Decimal
from random import Random

import pytest

from tests.conftest import AS_OF, day
from tidemart.operators.pit import last_on_or_before, previous_day_gap, snapshot_rollup
from tidemart.plans import marts


def order(i, customer, d, amount=10):
    return {
        "order_id": f"o{i:04d}",
        "customer_id": customer,
        "order_date": d,
        "order_amount": Decimal(amount),
        "channel": "web",
        "item_count": 1,
    }


def customer(cid, signup, churn=None):
    return {"customer_id": cid, "signup_date": signup, "churn_date": churn, "plan_type": "basic", "region": "r", "is_active": churn is None}


def test_window_is_half_open(table):
    people = table("customers", [customer("a", day(-400)), customer("quiet", day(-400)), customer("new", day(0))])
    orders = table("orders", [order(1, "a", day(0)), order(2, "a", day(-89), 20), order(3, "a", day(-90), 40), order(4, "quiet", day(-300))])
    rows = {r.customer_id: r for r in marts.customer_features_at(people, orders, AS_OF).collect()}
    assert (rows["a"].frequency_90d, rows["a"].monetary_90d, rows["a"].recency_days) == (2, Decimal(30), 0)
    assert rows["quiet"].avg_order_value is None and rows["quiet"].recency_days == 300
    assert (rows["new"].tenure_days, rows["new"].recency_days) == (0, None)


def test_label_and_eligibility_edges(table):
    people = table("customers", [customer(str(k), day(-400), day(k)) for k in (0, 1, 30, 31)])
    orders = table("orders", [order(1, "1", day(-1))])
    rows = marts.with_churn_label(marts.customer_features_at(people, orders, AS_OF)).collect()
    assert {r.customer_id: r.churned_next_30d for r in rows} == {"1": True, "30": True, "31": False}


@pytest.mark.parametrize("interval,window", [(30, 90), (30, 45), (7, 10)])
def test_rollup_equals_literal_join(table, interval, window):
    rng = Random(7)
    start, stop = day(-200), day(-30)
    people = [customer(f"c{i}", day(-rng.randint(0, 300)), rng.choice([None, day(-rng.randint(0, 200))])) for i in range(15)]
    people.append(customer("no signup", None))
    orders = [order(i, f"c{rng.randint(0, 15)}", day(-rng.randint(0, 320)), rng.randint(1, 99)) for i in range(300)]
    got = snapshot_rollup(table("customers", people), table("orders", orders), start, stop, interval, window).collect()
    want = []
    s = start
    while s <= stop:
        for p in people:
            if p["signup_date"] is None or p["signup_date"] > s or (p["churn_date"] and p["churn_date"] <= s):
                continue
            mine = [o for o in orders if o["customer_id"] == p["customer_id"] and o["order_date"] <= s]
            recent = [o for o in mine if o["order_date"] > s - dt.timedelta(days=window)]
            last = max((o["order_date"] for o in mine), default=None)
            want.append((p["customer_id"], s, last, len(recent), sum(o["order_amount"] for o in recent)))
        s += dt.timedelta(days=interval)
    key = lambda r: (r[0], r[1])
    assert sorted([(r.customer_id, r.snapshot_date, r.last_order_date, r.frequency, r.monetary) for r in got], key=key) == sorted(want, key=key)


def test_latest_features_are_the_newest_snapshot(table):
    people = table("customers", [customer("a", day(-500)), customer("b", day(-480), day(-100)), customer("c", day(-20))])
    orders = table("orders", [order(i, "a", day(-15 * i)) for i in range(30)])
    whole = marts.latest_snapshot(marts.customer_features(people, orders, AS_OF))
    assert whole.collect() == marts.latest_customer_features(people, orders, AS_OF).collect()


def test_gap_equals_lag_with_a_hot_customer(table):
    rng = Random(3)
    orders = [order(i, "hot" if rng.random() < 0.6 else f"c{rng.randint(0, 9)}", day(-rng.randint(0, 25))) for i in range(600)]
    got = {r.order_id: r.hours_since_last_order for r in previous_day_gap(table("orders", orders)).collect()}
    previous = {}
    for o in sorted(orders, key=lambda o: (o["customer_id"], o["order_date"], o["order_id"])):
        before = previous.get(o["customer_id"])
        assert got[o["order_id"]] == (None if before is None else 24 * (o["order_date"] - before).days)
        previous[o["customer_id"]] = o["order_date"]


def test_as_of_lookup(spark, table):
    probes = spark.createDataFrame([("a", day(0)), ("a", day(-10)), ("a", day(-30)), ("b", day(0))], "customer_id string, snapshot_date date")
    events = table("orders", [order(1, "a", day(-10)), order(2, "a", day(-20)), order(3, "a", day(1))])
    out = last_on_or_before(probes, events, "customer_id", "snapshot_date", "order_date", "seen")
    assert {(r.customer_id, r.snapshot_date): r.seen for r in out.collect()} == {
        ("a", day(0)): day(-10),
        ("a", day(-10)): day(-10),
        ("a", day(-30)): None,
        ("b", day(0)): None,
    }


def test_top_products_tie_break_and_demand(spark):
    rows = [(f"p{i:02d}", day(-i), 2, Decimal(5)) for i in range(25)] + [("p24", day(0), 3, Decimal(100))]
    items = spark.createDataFrame(rows, "product_id string, order_date date, quantity int, unit_price decimal(12,2)")
    top = [r.product_id for r in marts.top_products(items).collect()]
    assert top == ["p24"] + [f"p{i:02d}" for i in range(19)]
    demand = marts.daily_product_demand(items)
    assert {r.product_id for r in demand.collect()} == set(top)
    assert demand.where("product_id = 'p24'").count() == 2


def test_order_features_join_kind_and_model_input(table):
    orders = table("orders", [order(1, "a", day(-40)), order(2, "a", day(-2)), order(3, "a", day(-1))])
    items = table("order_items", [{"order_item_id": str(i), "order_id": o, "unit_price": Decimal(p), "discount_pct": Decimal("0.1")} for i, (o, p) in enumerate([("o0001", 10), ("o0001", 20), ("o0003", 5)])])
    inner = {r.order_id: r for r in marts.order_transaction_features(orders, items).collect()}
    assert set(inner) == {"o0001", "o0003"} and inner["o0001"].avg_unit_price == 15
    assert inner["o0003"].hours_since_last_order == 39 * 24
    left = marts.order_transaction_features(orders, items, 30, AS_OF, how="left")
    rows = {r.order_id: r for r in left.collect()}
    assert rows["o0002"].avg_unit_price is None and rows["o0002"].hours_since_last_order == 38 * 24
    ready = {r.order_id: r for r in marts.model_ready_orders(marts.order_transaction_features(orders, items, how="left")).collect()}
    assert ready["o0001"].hours_since_last_order == 8760 and ready["o0002"].avg_unit_price == 0.0
