from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import AS_OF, day
from tidemart.plans import layers
from tidemart.schemas import RAW_SCHEMAS
from tidemart.search.bm25 import SearchIndex, query_terms, search
from tidemart.sources import documents, jdbc, landing
from tidemart.streaming import ingest

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


@pytest.fixture(scope="module")
def small(table):
    return {
        "customers": table("customers", [{"customer_id": "a", "signup_date": day(-400), "plan_type": "basic", "region": "r", "is_active": True}]),
        "subscriptions": table("subscriptions", [{"subscription_id": "s", "customer_id": "a", "start_date": day(-400)}]),
        "products": table("products", [{"product_id": "p", "name": "n", "unit_price": Decimal(5)}]),
        "orders": table("orders", [{"order_id": str(i), "customer_id": "a", "order_date": day(-i * 40), "channel": "web", "order_amount": Decimal(10), "item_count": 1} for i in range(8)]),
        "order_items": table("order_items", [{"order_item_id": str(i), "order_id": str(i), "product_id": "p", "quantity": 2, "unit_price": Decimal(5), "discount_pct": Decimal(0)} for i in range(7)]),
    }


def test_landing_replaces_only_its_date(small, tmp_path, spark):
    root = str(tmp_path)
    landing.write_landing(small["orders"], "orders", root, D1)
    landing.write_landing(small["orders"], "orders", root, D2)
    path = landing.write_landing(small["orders"].limit(3), "orders", root, D2)
    assert path.endswith("orders/run_date=2024-01-02")
    assert {str(r.run_date): r["count"] for r in spark.read.parquet(f"{root}/orders").groupBy("run_date").count().collect()} == {"2024-01-01": 8, "2024-01-02": 3}


def test_publish_contract(small, tmp_path, spark):
    path = landing.write_landing(small["products"], "products", str(tmp_path / "l"), D1)
    none, broken = landing.ObjectStore(), landing.ObjectStore("nosuchscheme://bucket/x")
    assert landing.publish(spark, path, "products", D1, none) is False
    assert landing.publish(spark, path, "products", D1, broken) is False
    for store in (none, broken):
        with pytest.raises(Exception):
            landing.publish(spark, path, "products", D1, store, strict=True)
    assert landing.publish(spark, path, "products", D1, landing.ObjectStore(str(tmp_path / "s")), strict=True)
    assert (tmp_path / "s" / "products" / "run_date=2024-01-01").exists()


def test_extract_and_load_once_stream(small, tmp_path, spark):
    root, raw, check = (str(tmp_path / p) for p in ("l", "raw", "c"))
    paths = landing.run_extract(spark, small.__getitem__, root, D1)
    assert len(paths) == 5
    ingest.ingest_all(spark, root, raw, check)
    ingest.ingest_all(spark, root, raw, check)
    assert ingest.read_raw(spark, "orders", raw).count() == 8
    assert ingest.read_raw(spark, "orders", raw).schema == RAW_SCHEMAS["orders"]
    landing.write_landing(small["orders"].limit(2), "orders", root, D2)
    ingest.start_ingest(spark, "orders", root, raw, check).awaitTermination()
    assert ingest.read_raw(spark, "orders", raw).count() == 10


def test_columns_match_by_name_in_any_case(small, tmp_path, spark):
    shuffled = small["orders"].select(*[F.col(c).alias(c.upper()) for c in reversed(small["orders"].columns)])
    shuffled.write.parquet(str(tmp_path / "x"))
    assert landing.read_parquet(spark, "orders", str(tmp_path / "x")).exceptAll(small["orders"]).isEmpty()


def test_stored_layers(small, spark):
    layers.create_namespaces(spark, "t_")
    layers.load_raw(spark, {k: v.withColumn("internal", F.lit(1)) for k, v in small.items()}, "t_")
    for _ in range(2):
        layers.build_layers(spark, AS_OF, "t_")
    read = lambda name: layers.read_layer_table(spark, name, "t_")
    assert "internal" not in read("raw.orders").columns
    assert read("dwh.fact_orders").count() == 8 and read("dwh.fact_order_items").count() == 7
    assert read("mart.daily_product_demand").count() == 7 and read("mart.order_transaction_features").count() == 7
    assert read("mart.customer_features").agg(F.max("snapshot_date")).first()[0] <= day(-30)
    assert "part_month" in spark.table("t_dwh.fact_orders").columns
    layers.save_table(small["orders"].limit(0), "dwh.fact_orders", "t_", if_absent=True)
    assert read("dwh.fact_orders").count() == 8


def test_jdbc_options(small):
    """Option building only: no database is started for tests."""
    db = jdbc.JdbcDatabase("jdbc:postgresql://db/x", properties={"user": "u"})
    options = jdbc.read_options(db, "orders", jdbc.ReadSplit("order_date", "2023-01-01", "2024-12-31", 64))
    assert options["dbtable"] == "raw.orders" and options["numPartitions"] == "64" and options["partitionColumn"] == "order_date"
    assert "numPartitions" not in jdbc.read_options(db, "orders", None)
    assert jdbc.write_options(db, "orders")["truncate"] == "true"
    dirty = small["orders"].withColumn("order_amount", F.lit(float("nan"))).withColumn("internal", F.lit(1))
    out = jdbc.loadable(dirty, "orders")
    assert "internal" not in out.columns and out.where("order_amount IS NULL").count() == 8


def test_documents_and_search(tmp_path, spark):
    texts = {"refunds": ("faq", "Refund refund policy --- money back"), "outage": ("ops_runbook", "When the pipeline fails, restart it."), "plans": ("faq", "Plans and prices. Refund possible.")}
    for name, (category, body) in texts.items():
        (tmp_path / f"{name}.md").write_text(f"---\ntitle: \"About {name}\"\ncategory: {category}\nupdated_at: 2024-05-06\n---\n\n{body}\n\n", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no")
    docs = documents.load_documents(spark, str(tmp_path))
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(texts) and rows["refunds"].content == texts["refunds"][1]
    assert rows["plans"].title == "About plans" and rows["plans"].updated_at == dt.date(2024, 5, 6)
    hits = search(docs, "REFUND", attributes={"category": "faq"}).collect()
    assert [h.doc_id for h in hits] == ["refunds", "plans"] and hits[0].score > hits[1].score
    assert search(docs, "refund", attributes={"category": "ops_runbook"}).isEmpty()
    with pytest.raises(ValueError):
        query_terms(" - ")
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.refresh(docs, 0)
    index.refresh(docs.where("doc_id = 'outage'").withColumn("content", F.lit("refund refund refund now")), 1)
    index.refresh(docs.where("doc_id = 'plans'").withColumn("content", F.lit("")), 2)
    assert [h.doc_id for h in index.search("refund").collect()] == ["outage", "refunds"]
