"""RAW to STAGING: key and value filters, defaults, and full-row de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.schemas import RAW_COLUMNS

# Columns that must be present, and the value rule each row must meet.
REQUIRED = {
    "customers": ["customer_id"],
    "subscriptions": ["subscription_id", "customer_id"],
    "products": ["product_id"],
    "orders": ["order_id", "customer_id"],
    "order_items": ["order_item_id", "order_id"],
}


def value_rule(table: str) -> Column | None:
    return {
        "products": F.col("unit_price") > 0,
        "orders": F.col("order_amount") >= 0,
        "order_items": F.col("quantity") > 0,
    }.get(table)


def with_defaults(customers: DataFrame) -> DataFrame:
    return customers.withColumns(
        {
            "is_active": F.coalesce("is_active", F.col("churn_date").isNull()),
            "plan_type": F.coalesce("plan_type", F.lit("unknown")),
            "region": F.coalesce("region", F.lit("unknown")),
        }
    )


def clean(raw: DataFrame, table: str) -> DataFrame:
    """Filter, default and de-duplicate one RAW table.

    DISTINCT runs over whole rows, so copies of one row collapse map-side before the exchange
    however many there are. Two versions of a key both stay; see :func:`latest_by_key`.
    """
    df = raw.select(*RAW_COLUMNS[table]).na.drop(subset=REQUIRED[table])
    rule = value_rule(table)
    if rule is not None:
        df = df.where(rule)
    if table == "customers":
        df = with_defaults(df)
    return df.distinct()


def latest_by_key(df: DataFrame, key: str, version: str) -> DataFrame:
    """Opt-in for repeated full extracts: keep the newest version of each key.

    ``max_by`` is a partial aggregate, so a key with very many versions never has to fit in
    one window partition.
    """
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, version).alias("row")).select("row.*")


