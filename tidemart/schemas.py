"""Declared schemas of the five RAW tables and of the document corpus."""

from __future__ import annotations

from pyspark.sql import types as T

_STR = T.StringType()
_DATE = T.DateType()
_MONEY = T.DecimalType(12, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", _STR),
        ("signup_date", _DATE),
        ("churn_date", _DATE),
        ("is_active", T.BooleanType()),
        ("plan_type", _STR),
        ("region", _STR),
    ),
    "subscriptions": _struct(
        ("subscription_id", _STR),
        ("customer_id", _STR),
        ("plan", _STR),
        ("mrr", _MONEY),
        ("start_date", _DATE),
        ("end_date", _DATE),
        ("status", _STR),
    ),
    "products": _struct(
        ("product_id", _STR),
        ("name", _STR),
        ("category", _STR),
        ("unit_price", _MONEY),
        ("launch_date", _DATE),
    ),
    "orders": _struct(
        ("order_id", _STR),
        ("customer_id", _STR),
        ("order_date", _DATE),
        ("channel", _STR),
        ("region", _STR),
        ("order_amount", _MONEY),
        ("item_count", T.IntegerType()),
        ("status", _STR),
    ),
    "order_items": _struct(
        ("order_item_id", _STR),
        ("order_id", _STR),
        ("product_id", _STR),
        ("quantity", T.IntegerType()),
        ("unit_price", _MONEY),
        ("discount_pct", T.DecimalType(5, 4)),
    ),
}

RAW_COLUMNS = {table: schema.names for table, schema in RAW_SCHEMAS.items()}

# (child table, child column, parent table): the parent column has the same name.
FOREIGN_KEYS = [
    ("subscriptions", "customer_id", "customers"),
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
]

# Parents before children.
LOAD_ORDER = ["customers", "products", "subscriptions", "orders", "order_items"]

DOCUMENT_SCHEMA = _struct(
    ("doc_id", _STR),
    ("title", _STR),
    ("category", _STR),
    ("content", _STR),
    ("updated_at", _DATE),
)
