"""Registered queries over stored tables: versioned layers, ingest, buckets, document files."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.catalog.relational import (
    big,
    d,
    feature_columns,
    order_columns,
    order_feature_columns,
)
from tidemart.plans import bucketed, quality
from tidemart.plans.layers import Warehouse
from tidemart.plans.store import LayerStore
from tidemart.schemas import RAW_COLUMNS
from tidemart.session import scratch_dir, tune
from tidemart.sources import documents, landing
from tidemart.sources.driver_tables import raw_orders, raw_tables, read_table
from tidemart.streaming import ingest

QUERIES = {}
RUN_DATE = dt.date(2001, 8, 1)
BUCKETS = 8


def query(f):
    """Register ``f(spark, sf_dir)`` under its own name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
    return f


def _loaded(spark: SparkSession, sf_dir: str):
    """A store with the five RAW tables, and the tables themselves."""
    store, raw = LayerStore(spark, scratch_dir(spark, "layers")), raw_tables(spark, sf_dir)
    store.load_raw({t: raw.table(t) for t in RAW_COLUMNS})
    return store, raw


# --- versioned layers


@query
def s9_bulk_load_raw(spark, sf_dir):
    """Five RAW tables loaded twice; the second load replaces the first. Rows of each, read by name."""
    store, raw = _loaded(spark, sf_dir)
    store.load_raw({t: raw.table(t).withColumn("internal", F.lit(1)) for t in RAW_COLUMNS})
    prefix = f"l{uuid.uuid4().hex}_"
    store.snapshot().register(prefix)
    counts = [
        spark.table(f"{prefix}raw.{t}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        for t in RAW_COLUMNS
    ]
    return quality.union_all(counts)


@query
def s9_bulk_load_raw_orders(spark, sf_dir):
    store, _ = _loaded(spark, sf_dir)
    return store.snapshot().table("raw.orders").select(*order_columns())


@query
def s14_namespaces(spark, sf_dir):
    """The namespaces of the layers with what a refresh of the dimensions put into them, and the rows of each."""
    store, raw = _loaded(spark, sf_dir)
    prefix = f"n{uuid.uuid4().hex}_"
    store.refresh(raw.as_of, ["dwh.dim_customer", "dwh.dim_product"]).register(prefix)
    found = [(layer, t.name) for layer in ("raw", "staging", "dwh", "mart") for t in spark.catalog.listTables(prefix + layer) if not t.isTemporary]
    return quality.union_all(
        [
            spark.table(f"{prefix}{layer}.{t}").agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(layer).alias("namespace"), F.lit(t).alias("table_name"), "n_rows"
            )
            for layer, t in found
        ]
    )


@query
def s17_mart_refresh(spark, sf_dir):
    """All layers built twice, from changed RAW orders; a reader of the first version sees it whole afterwards."""
    store, raw = LayerStore(spark, scratch_dir(spark, "layers")), raw_tables(spark, sf_dir)
    tables = {t: raw.table(t) for t in RAW_COLUMNS}
    store.load_raw(tables | {"orders": tables["orders"].where(F.col("status") == "F")})
    store.refresh(raw.as_of)
    before = store.snapshot()
    store.load_raw({"orders": tables["orders"]})
    after = store.refresh(raw.as_of)
    return quality.union_all([s.row_counts().select(F.lit(n).alias("refresh"), "table_name", "n_rows") for n, s in (("first", before), ("second", after))])


def _mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store, raw = _loaded(spark, sf_dir)
    return store.refresh(raw.as_of, [name]).table(name)


@query
def s17_daily_sales(spark, sf_dir):
    return _mart(spark, sf_dir, "mart.daily_sales").select("order_date", "channel", d("total_amount"))


@query
def s17_daily_product_demand(spark, sf_dir):
    return _mart(spark, sf_dir, "mart.daily_product_demand").select("order_date", "product_id", big("quantity_sold"))


@query
def s17_customer_features(spark, sf_dir):
    return _mart(spark, sf_dir, "mart.customer_features").select(*feature_columns(), "churned_next_30d")


@query
def s17_order_transaction_features(spark, sf_dir):
    return _mart(spark, sf_dir, "mart.order_transaction_features").select(*order_feature_columns())


@query
def q12_qc_row_counts(spark, sf_dir):
    """Rows of the stored RAW and STAGING tables against those of the source."""
    store, raw = _loaded(spark, sf_dir)
    stored = store.refresh(raw.as_of, [f"staging.{t}" for t in RAW_COLUMNS])
    source = {t: raw.table(t) for t in RAW_COLUMNS}
    checks = [
        quality.row_counts({t: stored.table(f"{layer}.{t}") for t in RAW_COLUMNS}, source).withColumn("layer", F.lit(layer))
        for layer in ("raw", "staging")
    ]
    return quality.union_all(checks).select("layer", "table_name", "loaded_rows", "source_rows", "matches")


# --- single stored tables


@query
def s8_copy_by_name(spark, sf_dir):
    """Columns in another order and case are loaded by name into the declared schema."""
    path = scratch_dir(spark, "copy")
    orders = raw_orders(spark, sf_dir)
    orders.select(*[F.col(c).alias(c.upper()) for c in reversed(orders.columns)]).write.parquet(path)
    return landing.read_parquet(spark, "orders", path).select(*order_columns())


@query
def s11_ctas_if_absent(spark, sf_dir):
    """A second CREATE IF NOT EXISTS, here with no rows, leaves the stored fact as it is."""
    path = scratch_dir(spark, "fact")
    facts = Warehouse.open(spark, sf_dir).fact_orders
    facts.write.mode("ignore").parquet(path)
    facts.where(F.lit(False)).write.mode("ignore").parquet(path)
    return spark.read.schema(facts.schema).parquet(path).select(*order_columns())


def _bucketed_facts(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    w, run = Warehouse.open(spark, sf_dir), uuid.uuid4().hex
    orders, items = f"fact_orders_{run}", f"fact_order_items_{run}"
    bucketed.save_bucketed(w.fact_orders, orders, scratch_dir(spark, "fact"), ["order_id"], BUCKETS, "order_date")
    bucketed.save_bucketed(w.fact_order_items, items, scratch_dir(spark, "fact"), ["order_id"], BUCKETS)
    return orders, items


@query
def s12_partitioned_clustered_write(spark, sf_dir):
    """Facts stored by year in buckets of orders; a range of days is read back with every column."""
    w, name = Warehouse.open(spark, sf_dir), f"fact_orders_{uuid.uuid4().hex}"
    bucketed.save_bucketed(w.fact_orders, name, scratch_dir(spark, "fact"), ["order_id"], BUCKETS, "order_date")
    return bucketed.read_days(spark, name, "order_date", dt.date(1997, 1, 15), dt.date(1999, 12, 31)).select(*order_columns())


@query
def s12_bucketed_join(spark, sf_dir):
    """Items joined to their orders bucket by bucket."""
    orders, items = _bucketed_facts(spark, sf_dir)
    heads = bucketed.read_bucketed(spark, orders).select("order_id", "channel", "order_amount")
    return bucketed.read_bucketed(spark, items).join(heads, "order_id").select(
        "order_item_id", "order_id", "order_date", "product_id", big("quantity"), "channel", d("order_amount")
    )


# --- ingest, object store and document files


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Five tables landed and ingested; one date of orders is landed again with changed rows; the RAW folder."""
    root, raw, checkpoint = (scratch_dir(spark, p) for p in ("landing", "raw", "stream"))
    tables = raw_tables(spark, sf_dir)
    for t in RAW_COLUMNS:
        landing.write_landing(tables.table(t), t, root, RUN_DATE)
    ingest.ingest_all(spark, root, raw, checkpoint)
    changed = tables.orders.withColumn("status", F.when(F.col("channel") == "5-LOW", F.lit("X")).otherwise(F.col("status")))
    landing.write_landing(changed, "orders", root, RUN_DATE)
    for _ in range(2):
        ingest.ingest_all(spark, root, raw, checkpoint)
    return raw


@query
def s7_auto_ingest(spark, sf_dir):
    """A date that is landed twice is in RAW once, with its changed rows."""
    return ingest.read_raw(spark, "orders", _ingested(spark, sf_dir)).select(*order_columns())


@query
def s7_ingest_ledger(spark, sf_dir):
    """Per table and run date: rows noted in the ledger and rows in RAW."""
    raw = _ingested(spark, sf_dir)
    held = quality.union_all(
        [
            ingest.read_raw(spark, t, raw).agg(F.count(F.lit(1)).alias("raw_rows")).select(F.lit(t).alias("table_name"), "raw_rows")
            for t in RAW_COLUMNS
        ]
    )
    noted = ingest.ledger(spark, raw).select("table_name", "run_date", F.col("n_rows").alias("ledger_rows"))
    return noted.join(held, "table_name").select("table_name", "run_date", "ledger_rows", "raw_rows")


@query
def s5_publish_contract(spark, sf_dir):
    """Five landed tables: without a store and with one that fails nothing is published, a working store gets all rows."""
    root, store, tables = scratch_dir(spark, "landing"), scratch_dir(spark, "store"), raw_tables(spark, sf_dir)
    targets = {
        "without_store": landing.ObjectStore(),
        "unreachable": landing.ObjectStore("nosuchscheme://bucket/prefix"),
        "published": landing.ObjectStore(store),
    }
    rows = []
    for t in RAW_COLUMNS:
        path = landing.write_landing(tables.table(t), t, root, RUN_DATE)
        done = {name: landing.publish(spark, path, t, RUN_DATE, target) for name, target in targets.items()}
        counted = landing.read_parquet(spark, t, f"{store}/{t}").agg(F.count(F.lit(1)).alias("n_rows"))
        rows.append(counted.select(F.lit(t).alias("table_name"), *[F.lit(v).alias(k) for k, v in done.items()], "n_rows"))
    return quality.union_all(rows)


@query
def s15_document_load(spark, sf_dir):
    """Documents written as files with front matter, one of each hundred with an unusable date, and loaded from them."""
    folder = scratch_dir(spark, "documents")
    day = F.when(F.col("doc_id") % 100 == 7, F.lit("soon")).otherwise(F.lit("2001-08-01"))
    header = F.format_string('---\ntitle: "Text %d"\ncategory: %s\nupdated_at: %s\n---\n', "doc_id", "source", day)
    files = read_table(spark, sf_dir, "documents").select(
        F.format_string("doc-%d", "doc_id").alias("doc_id"), F.concat(header, F.coalesce("text", F.lit(""))).alias("value")
    )
    documents.write_documents(files, folder)
    return documents.load_documents(spark, folder, "*.txt")
