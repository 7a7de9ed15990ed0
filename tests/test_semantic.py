from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import AS_OF, day
from tidemart.plans import semantic
from tidemart.plans.semantic import LastDays, Latest, Metric, Range, SemanticTable, VerifiedQuery


@pytest.fixture(scope="module")
def marts(spark):
    sales = [(day(-i), c, Decimal(i + 1)) for i in range(70) for c in ("web", "app", None)]
    demand = [(day(-i), str(i % 8), i) for i in range(50)]
    features = [
        (str(i), day(-30 * s), None if i == 2 else "r" + str(i % 3), "basic", s == 0 and i % 2 == 0, i, 1, float(i), None, 5)
        for i in range(9)
        for s in range(3)
    ]
    return {
        "daily_sales": spark.createDataFrame(sales, "order_date date, channel string, total_amount decimal(12,2)"),
        "daily_product_demand": spark.createDataFrame(demand, "order_date date, product_id string, quantity_sold bigint"),
        "customer_features": spark.createDataFrame(
            features,
            "customer_id string, snapshot_date date, region string, plan_type string, churned_next_30d boolean, recency_days int,"
            " frequency_90d int, monetary_90d double, avg_order_value double, tenure_days int",
        ),
    }


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_the_model_is_valid():
    assert semantic.validate() == []
    assert set(semantic.SEMANTIC_MODEL) == {"daily_sales", "customer_features", "daily_product_demand", "order_transaction_features"}
    assert len(semantic.VERIFIED_QUERIES) >= 3 and all(q.question for q in semantic.VERIFIED_QUERIES)


def test_faults_of_a_model_are_named(marts):
    table = SemanticTable({"a": ("x",)}, "day", {"b": ("x",)}, primary_key=("z",))
    bad = VerifiedQuery("q", " ", Metric("daily_sales", (("nothing", "sum"),)))
    faults = semantic.validate({"t": table, "u": SemanticTable({}, "", {})}, [bad, replace(bad, question="?")], {"t": marts["daily_sales"]})
    text = "\n".join(faults)
    for part in ("t: x means several columns", "t: key column z", "t: no column a", "u: no facts", "u: no dimensions", "q: asked for twice", "q: no question", "q: 'nothing'"):
        assert part in text


def test_verified_queries_by_name_and_question(marts):
    by_name = semantic.answer(marts, "monthly_revenue_by_channel")
    assert rows(by_name) == rows(semantic.monthly_revenue_by_channel(marts["daily_sales"]))
    question = semantic.verified("top_products_by_demand").question
    assert rows(semantic.answer(marts, f" {question} ", AS_OF)) == rows(
        semantic.top_products_by_demand(marts["daily_product_demand"], AS_OF)
    )
    latest = marts["customer_features"].where(F.col("snapshot_date") == F.lit(day(0)))
    assert rows(semantic.answer(marts, "high_risk_customer_count_by_region")) == rows(semantic.high_risk_by_region(latest))
    with pytest.raises(KeyError):
        semantic.answer(marts, "how is the weather?")
    with pytest.raises(ValueError):
        semantic.answer(marts, question).collect()  # needs the run date


def test_filters(marts):
    count = lambda table, *filters: Metric(table, (("*", "count"),), filters=filters).plan(marts, AS_OF).first()[0]
    assert count("daily_sales", ("チャネル", ["web", "app"])) == 140
    assert count("daily_sales", ("channel", None)) == 70
    assert count("daily_sales", ("channel", "web"), ("売上", Range(least=10, most=19))) == 10
    assert count("daily_sales", ("order_date", Range(most=day(-60)))) == 30
    assert count("daily_sales", ("order_date", LastDays(9))) == 30
    assert count("customer_features", ("snapshot_date", Latest()), ("recency_days", Range(3, 5))) == 3
    assert count("customer_features", ("region", ())) == 0


def test_several_facts_orders_and_names(marts):
    metric = Metric(
        "daily_sales", (("売上", "sum"), ("total_amount", "max"), ("channel", "distinct")), grain="month",
        order=("-biggest",), limit=2, names=(("max_total_amount", "biggest"),),
    )
    out = metric.plan(marts)
    assert out.columns == metric.columns() == ["period", "sum_total_amount", "biggest", "distinct_channel"]
    assert [r.biggest for r in out.collect()] == [Decimal(70), Decimal(61)] and out.first().period == dt.date(2024, 10, 1)
    for bad in (replace(metric, grain="hour"), replace(metric, facts=(("channel", "mode"),)), replace(metric, facts=(("売上", "sum"),) * 2)):
        with pytest.raises(ValueError):
            bad.plan(marts)
    for bad in (replace(metric, order=("x",)), replace(metric, filters=(("x", 1),)), replace(metric, dimensions=("売上",))):
        with pytest.raises(KeyError):
            bad.plan(marts)
