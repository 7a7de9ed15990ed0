from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import AS_OF, day
from tests.test_sources import small  # noqa: F401
from tidemart.plans import bucketed
from tidemart.plans.steps import STEPS, in_order
from tidemart.plans.store import LayerStore
from tidemart.sources import landing
from tidemart.streaming import ingest

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def test_inputs_are_built_first():
    order = in_order(STEPS)
    assert len(order) == 15 and sorted(order) == sorted(STEPS)
    for name in order:
        assert all(order.index(i) < order.index(name) for i in STEPS[name].inputs if i in STEPS)
    assert in_order(["mart.daily_sales"]) == ["staging.orders", "dwh.fact_orders", "mart.daily_sales"]
    with pytest.raises(KeyError):
        in_order(["mart.nothing"])


def test_a_reader_keeps_its_version_and_a_failed_refresh_changes_nothing(small, spark, tmp_path, monkeypatch):  # noqa: F811
    store = LayerStore(spark, str(tmp_path))
    assert store.snapshot().names == [] and store.versions() == []
    store.load_raw({t: df.withColumn("internal", F.lit(1)) for t, df in small.items()})
    store.refresh(AS_OF)
    before = store.snapshot()
    assert len(before.names) == 20 and "internal" not in before.table("raw.orders").columns
    counts = {r.table_name: r.n_rows for r in before.row_counts().collect()}
    assert counts["dwh.fact_orders"] == 8 and counts["mart.daily_product_demand"] == 7

    def fails(*_):
        raise RuntimeError("no luck")

    broken = STEPS["mart.daily_sales"].__class__(STEPS["mart.daily_sales"].inputs, fails)
    monkeypatch.setitem(STEPS, "mart.daily_sales", broken)
    store.load_raw({"orders": small["orders"].where("order_id < '3'")})
    with pytest.raises(RuntimeError):
        store.refresh(AS_OF)
    assert store.snapshot().version == 3 and store.snapshot().table("dwh.fact_orders").count() == 8
    monkeypatch.undo()
    after = store.refresh(AS_OF)
    assert after.table("dwh.fact_orders").count() == 3 and store.snapshot().table("dwh.fact_orders").count() == 3
    assert before.table("dwh.fact_orders").count() == 8 and store.snapshot(2).table("mart.daily_sales").count() == 8
    assert store.versions() == [1, 2, 3, 4]
    with pytest.raises(KeyError):
        store.snapshot(9)
    assert "part_month" in after.stored("dwh.fact_orders").columns
    after.register("st_")
    assert spark.table("st_dwh.fact_orders").count() == 3 and "part_month" not in spark.table("st_dwh.fact_orders").columns
    store.vacuum(keep=1)
    assert LayerStore(spark, str(tmp_path)).snapshot().table("mart.daily_sales").count() == 3
    with pytest.raises(Exception):
        before.table("dwh.fact_orders").count()


def test_of_two_refreshes_at_once_one_is_read_whole(small, spark, tmp_path):  # noqa: F811
    store = LayerStore(spark, str(tmp_path))
    base = store.load_raw(small)
    one = {"raw.products": store._write(small["products"], "raw.products", "a")}
    two = {"raw.products": store._write(small["products"].limit(0), "raw.products", "b")}
    store._commit(base, one, "a")
    store._commit(base, two, "b")
    assert store.snapshot().version == 2 and store.snapshot().table("raw.products").count() == 0


def test_a_date_that_lands_again_is_held_once(small, spark, tmp_path):  # noqa: F811
    root, raw, check = (str(tmp_path / p) for p in ("l", "raw", "c"))
    assert ingest.ledger(spark, raw).isEmpty()
    for d in (D1, D2):
        landing.run_extract(spark, small.__getitem__, root, d)
    ingest.ingest_all(spark, root, raw, check)
    assert ingest.read_raw(spark, "orders", raw).count() == 16
    changed = small["orders"].where("order_id < '5'").withColumn("order_amount", F.lit(Decimal("3.00")).cast("decimal(12,2)"))
    landing.write_landing(changed, "orders", root, D1)
    for _ in range(2):
        ingest.ingest_all(spark, root, raw, check)
    got = ingest.read_raw(spark, "orders", raw)
    assert got.count() == 13 and got.where("order_amount = 3").count() == 5
    noted = {(r.table_name, r.run_date): (r.batch_id, r.n_rows) for r in ingest.ledger(spark, raw).collect()}
    assert noted["orders", D1] == (1, 5) and noted["orders", D2] == (0, 8) and noted["order_items", D1] == (0, 7)
    # a batch that is repeated after a failure changes nothing
    ingest.replace_dates(spark, "orders", root, raw, [D1], 1)
    assert ingest.read_raw(spark, "orders", raw).count() == 13 and ingest.ledger(spark, raw).count() == 10


def test_files_of_a_date_may_come_in_several_batches(small, spark, tmp_path):  # noqa: F811
    root, raw, check = (str(tmp_path / p) for p in ("l", "raw", "c"))
    landing.write_landing(small["orders"].repartition(3), "orders", root, D1)
    ingest.start_ingest(spark, "orders", root, raw, check, max_files=1).awaitTermination()
    assert ingest.read_raw(spark, "orders", raw).count() == 8


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_bucketed_tables_have_no_exchange(table, spark, tmp_path):
    orders = table("orders", [{"order_id": str(i), "customer_id": str(i % 7), "order_date": day(-i), "order_amount": Decimal(i)} for i in range(900)])
    items = table("order_items", [{"order_item_id": str(i), "order_id": str(i % 900), "product_id": "p", "quantity": 1} for i in range(2000)])
    marks = orders.select("customer_id", F.col("order_date").alias("snapshot_date"), "order_amount")
    keys = ["customer_id", "snapshot_date"]
    bucketed.save_bucketed(orders, "b_orders", str(tmp_path / "o"), ["order_id"], 4, "order_date")
    bucketed.save_bucketed(items, "b_items", str(tmp_path / "i"), ["order_id"], 4)
    bucketed.save_bucketed(marks, "b_marks", str(tmp_path / "m"), keys, 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = lambda name: bucketed.read_bucketed(spark, name)
        joined = read("b_items").join(read("b_orders"), "order_id")
        averages = read("b_items").groupBy("order_id").agg(F.avg("quantity").alias("n"))
        twice = read("b_marks").join(read("b_marks").select(*keys, F.lit(1).alias("x")), keys)
        for df in (joined, averages.join(read("b_orders"), "order_id"), twice):
            assert "Exchange" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
        assert joined.count() == 2000 and joined.select(*orders.columns).distinct().count() == 900
        assert twice.count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    days = bucketed.read_days(spark, "b_orders", "order_date", day(-100), day(-50))
    assert days.columns == orders.columns and days.exceptAll(orders.where(F.col("order_date").between(day(-100), day(-50)))).isEmpty()
    assert days.count() == 51 and "part_period" in plan_of(days).split("PartitionFilters")[1].split("]")[0]
